"""Every registered query beside its SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as entry_module
from biascomp import plans
from tests import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("key", sorted(plans.queries()))
def test_query_matches_sql(spark, con, key):
    ok, note = check.compare(key, spark, con, SF, tol=1.5e-6)
    assert ok, note


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0


def test_sql_keys_are_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"predict_cycle0_draws", "ppc"}
