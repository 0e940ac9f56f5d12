"""Queries over the driver tables, one per operator, each beside its SQL statement."""

from biascomp.plans import registry
from biascomp.plans import analysis as _analysis  # noqa: F401
from biascomp.plans import comparison as _comparison  # noqa: F401
from biascomp.plans import imaging as _imaging  # noqa: F401
from biascomp.plans import model as _model  # noqa: F401
from biascomp.plans import reports as _reports  # noqa: F401
from biascomp.plans import tables as _tables  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
