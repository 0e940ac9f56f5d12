"""Ordered operators against brute force, with one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from biascomp.operators import ordered, stats


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 3000
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    return pd.DataFrame({"g": g, "id": np.arange(n), "v": np.round(rng.normal(size=n), 1)})


@pytest.fixture(autouse=True, scope="module")
def many_slices(spark):
    """Keep adaptive execution from merging the few test rows into one slice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def as_pandas(df, keys):
    return df.toPandas().sort_values(keys).reset_index(drop=True)


def test_row_number(spark, skewed):
    got = as_pandas(ordered.row_number(spark.createDataFrame(skewed), ["g"], ["-v", "id"]), ["id"])
    want = skewed.sort_values(["v", "id"], ascending=[False, True]).groupby("g").cumcount() + 1
    assert got["rank"].tolist() == want.sort_index().tolist()


def test_hot_group_spans_slices(spark, skewed):
    run = ordered.OrderedRows(spark.createDataFrame(skewed), ["g"], ["v", "id"])
    assert run.rows.where("g = 'hot'").select(ordered.SLICE).distinct().count() > 1


def test_quantiles_and_ecdf(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = as_pandas(ordered.quantiles(df, ["g"], "v", {"q1": 0.1, "q2": 0.5, "q3": 0.975}), ["g"])
    want = skewed.groupby("g")["v"].quantile([0.1, 0.5, 0.975]).unstack().sort_index()
    assert np.allclose(got[["q1", "q2", "q3"]], want)
    e = as_pandas(ordered.ecdf(df, ["g"], "v"), ["g", "v"])
    for g, part in skewed.groupby("g"):
        mine = e[e.g == g]
        assert np.allclose(mine["ecdf"], [(part.v <= v).mean() for v in mine.v])


def test_global_quantile_without_groups(spark, skewed):
    row = ordered.quantiles(spark.createDataFrame(skewed), [], "v", {"m": 0.5}).collect()[0]
    assert row["m"] == pytest.approx(skewed.v.median())


@pytest.mark.parametrize("how,backwards", [("sum", False), ("min", True), ("max", False), ("sum", True)])
def test_running(spark, skewed, how, backwards):
    from pyspark.sql import functions as F

    run = ordered.OrderedRows(spark.createDataFrame(skewed), ["g"], ["id"])
    got = as_pandas(run.running(F.col("v"), "out", how, backwards).done(), ["id"])
    side = skewed.sort_values("id", ascending=not backwards).groupby("g")["v"]
    want = {"sum": side.cumsum, "min": side.cummin, "max": side.cummax}[how]().sort_index()
    assert np.allclose(got["out"], want)


def test_fill_down_up(spark, skewed):
    gaps = skewed.assign(v=skewed.v.where(skewed.id % 7 == 3))
    df = spark.createDataFrame(gaps.astype({"v": object}).where(gaps.notna(), None), "g string, id long, v double")
    got = as_pandas(ordered.fill_down_up(df, ["g"], ["id"], "v"), ["id"])
    want = gaps.sort_values("id").groupby("g")["v"].transform(lambda s: s.ffill().bfill()).sort_index()
    assert np.allclose(got["v"], want)


def test_group_middle_takes_upper_of_two(frame):
    df = frame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 9)], "g string, v int")
    assert {(r.g, r.v) for r in ordered.group_middle(df, ["g"], ["v"]).collect()} == {("a", 3), ("b", 9)}


def test_null_groups_stay(frame):
    df = frame([(None, 1), (None, 3), ("a", 2)], "g string, v int")
    got = {(r.g, r.m) for r in ordered.quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {(None, 2.0), ("a", 2.0)}


def test_spearman_with_ties(spark, skewed):
    pdf = skewed.assign(w=(skewed.v * 2 + np.sin(skewed.id)).round(1))
    got = as_pandas(stats.cor_test(spark.createDataFrame(pdf), ["g"], "v", "w", "spearman"), ["g"])
    want = [p.v.rank().corr(p.w.rank()) for _, p in pdf.groupby("g")]
    assert np.allclose(got["r"], want)


def test_p_adjust(frame):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04]
    df = frame([(i, v) for i, v in enumerate(p)], "id int, p double")
    got = as_pandas(stats.p_adjust(df, "p", ["id"]), ["id"])
    assert np.allclose(got["p_bonferroni"], np.minimum(np.array(p) * 6, 1))
    order = np.argsort(p, kind="stable")
    raw = np.array(p)[order] * 6 / np.arange(1, 7)
    want = np.empty(6)
    want[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    assert np.allclose(got["p_bh"], want)
    by_p = got.sort_values("p")["p_bh"]
    assert by_p.is_monotonic_increasing


def test_medians_at_two_levels(spark, skewed):
    """One hot group over many slices, parts of their own, NULL, NaN and repeated rows."""
    df = skewed.assign(part=skewed["id"] % 5)
    df.loc[df["id"] % 11 == 0, "v"] = np.nan
    df = pd.concat([df, df.head(40)])
    frame = spark.createDataFrame(df).withColumn("v", F.expr("if(id % 22 = 0, null, v)"))
    lone = frame.limit(1).selectExpr("'lone' as g", "0L as id", "cast(null as double) as v", "9L as part")
    out = ordered.medians_at_two_levels(frame.unionByName(lone), ["g"], ["part"], "v", ["id"], "mg", "mp").toPandas()
    assert len(out) == len(df) + 1 and out[out.g == "lone"][["mg", "mp"]].isna().all(axis=None)
    out = out[out.g != "lone"]
    assert np.allclose(out.mg, out.g.map(df.groupby("g")["v"].median()))
    want = df.groupby(["g", "part"])["v"].median()
    assert np.allclose(out.mp, want.loc[list(zip(out.g, out.part))])
    whole = ordered.medians_at_two_levels(frame, [], ["g"], "v", ["id"], "mg", "mp").toPandas()
    assert np.allclose(whole.mg, df["v"].median()) and np.allclose(whole.mp, whole.g.map(df.groupby("g")["v"].median()))


def test_line_errors_and_band(spark):
    """Against the normal equations; groups of two pairs and without spread have no band."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=40)
    y = 2 - 0.7 * x + rng.normal(scale=0.3, size=40)
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)] + [("b", 1.0, 2.0), ("b", 2.0, 5.0)]
    rows += [("c", 1.0, float(i)) for i in range(4)] + [("a", None, 1.0), ("a", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    fit = {r.g: r for r in stats.line_errors(df, ["g"], "x", "y").collect()}
    design = np.column_stack([np.ones(40), x])
    beta, left, *_ = np.linalg.lstsq(design, y)
    cov = np.linalg.inv(design.T @ design) * left[0] / 38
    a = fit["a"]
    assert np.allclose([a.intercept, a.slope, a.intercept_se, a.slope_se], [*beta, *np.sqrt(np.diag(cov))])
    assert fit["b"].sigma is None and fit["c"].slope is None and fit["c"].slope_se is None
    points = spark.createDataFrame([("a", 0.5), ("b", 1.5), ("c", 1.0), ("d", 1.0)], "g string, x double")
    band = {r.g: r for r in stats.line_band(df, points, ["g"], "x", "y").collect()}
    at, t = np.array([1, 0.5]), 2.0243941645751367
    assert np.allclose([band["a"].fit, band["a"].high - band["a"].fit], [at @ beta, t * np.sqrt(at @ cov @ at)])
    assert band["b"].fit == 3.5 and band["b"].low is None and band["c"].fit is None and band["d"].fit is None
