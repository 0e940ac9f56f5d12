"""Raw and corrected shares against an independent benchmark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.functions.numeric import asin_sqrt, p_label
from biascomp.operators import ordered, stats
from biascomp.operators.groups import add_group_aggs, join_on
from biascomp.session import checkpoint

#: A method within this part of the benchmark value counts as very close.
CLOSE_PART = 0.05


def join_benchmark(
    benchmark: DataFrame, metric: DataFrame, keys: Sequence[str], drop_sizes: Sequence[str] = (">2",),
    size: str = "size_fraction",
) -> DataFrame:
    """Benchmark rows, without the largest size class, beside the metric of the same sample and size."""
    kept = benchmark.where(~F.col(size).isin(list(drop_sizes)))
    return join_on(kept, metric, keys, null_safe=False).distinct()


def by_axis_score(df: DataFrame, score: str, digits: int = 6) -> DataFrame:
    """Axis score as a whole number of rounding steps, fit to be a join key."""
    return df.withColumn(f"{score}_key", F.round(F.col(score) * 10**digits).cast("long"))


def metric_sums(
    shares: DataFrame, by: Sequence[str], metrics: Sequence[str], where: Column, means: Sequence[str] = ()
) -> DataFrame:
    """Sum of each metric over the chosen categories, and means of the axis columns."""
    return shares.where(where).groupBy(*by).agg(
        *[F.sum(m).alias(m) for m in metrics], *[F.avg(m).alias(m) for m in means]
    )


def cor_grid(
    df: DataFrame, by: str, x_metrics: Sequence[str], y_metrics: Sequence[str], bounded: bool = False
) -> DataFrame:
    """Correlation of every pair of metrics per class, with both test corrections and a label.

    x goes through log10, y through the arcsine square root; pairs outside their domains leave.
    ``bounded`` states that ``by`` has few classes, so that the family of tests fits one window.
    """
    base = [c for c in df.columns if c not in (*x_metrics, *y_metrics)]
    long = df.unpivot([*base, *y_metrics], list(x_metrics), "x_variable", "x_value")
    long = long.unpivot([*base, "x_variable", "x_value"], list(y_metrics), "y_variable", "y_value")
    long = long.where((F.col("x_value") > 0) & (F.col("y_value") >= 0))
    long = long.withColumns({"__x": F.log10("x_value"), "__y": asin_sqrt("y_value")})
    cells = [by, "y_variable", "x_variable"]
    tests = stats.cor_test(long, cells, "__x", "__y")
    adjusted = stats.p_adjust(tests, "p", cells, bounded=bounded)
    label = F.concat(
        F.format_string("r = %.2f", "r"), F.lit("\nP (BH) = "), p_label("p_bh")
    )
    return adjusted.withColumn("label", label)


def publication_table(grid: DataFrame, by: str, names: Mapping[str, str]) -> DataFrame:
    """Renamed and ordered correlation table."""
    cols = [by, "y_variable", "x_variable", "r", "p", "p_bonferroni", "p_bh"]
    ordered_rows = grid.orderBy("y_variable", "x_variable", by).select(*cols)
    return ordered_rows.withColumnsRenamed(dict(names))


def closeness(
    df: DataFrame, by: Sequence[str], benchmark: str, raw: str, corrected: str
) -> DataFrame:
    """Long table of the three metrics with flags on the benchmark row: which method is closer, and
    which one lies within a small part of the benchmark value."""
    methods = [benchmark, raw, corrected]
    value = F.col("metric_value")
    gaps = {"diff_corrected": F.abs(F.col(corrected) - value), "diff_raw": F.abs(F.col(raw) - value)}
    # the chosen rows of the group are columns of the same wide row, so no lookup is needed
    parts = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("metric_value")) for m in methods])
    rest = [c for c in df.columns if c not in (*by, *methods)]
    long = df.select(*by, *rest, raw, corrected, F.inline(parts)).withColumns(gaps).drop(raw, corrected)
    on = F.col("method") == benchmark
    a, b = F.col("diff_corrected"), F.col("diff_raw")
    return long.withColumns(
        {
            "is_closer": F.when(on & (a < b), F.lit("*")).when(on & (a > b), F.lit("x")),
            "closest": F.when(on & (a < CLOSE_PART * value), F.lit("**")),
            "worse": F.when(on & (b < CLOSE_PART * value), F.lit("xx")),
        }
    )


def squared_errors(df: DataFrame, benchmark: str, raw: str, corrected: str) -> DataFrame:
    """Squared error of each method, their mean, the difference and its sign class."""
    sq = {m: F.pow(F.col(benchmark) - F.col(m), F.lit(2.0)) for m in (raw, corrected)}
    out = df.withColumns({"se_raw": sq[raw], "se_corrected": sq[corrected]})
    out = out.withColumns(
        {
            "average_se": (F.col("se_raw") + F.col("se_corrected")) / 2,
            "difference": F.col("se_raw") - F.col("se_corrected"),
        }
    )
    return out.withColumn("winner", F.when(F.col("difference") >= 0, "corrected").otherwise("raw"))


def median_errors(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median squared error of both methods per class."""
    errors = ["se_corrected", "se_raw"]
    long = df.unpivot(list(by), errors, "__error", "__value")
    medians = ordered.median(long, [*by, "__error"], "__value", "__median")
    return medians.groupBy(*by).agg(
        *[F.max(F.when(F.col("__error") == e, F.col("__median"))).alias(f"median_{e}") for e in errors]
    )


def three_way_long(
    a: DataFrame, b: DataFrame, keys: Sequence[str], methods: Sequence[str]
) -> DataFrame:
    """Two markers and the benchmark of the same sample as rows."""
    joined = join_on(a, b, keys, null_safe=False)
    return joined.unpivot(list(keys), list(methods), "method", "proportion")


def hotspots(
    df: DataFrame, rank: Column, category_keys: Sequence[str], site_keys: Sequence[str], value: str
) -> DataFrame:
    """Reads per category and site, their share of the site, and whether the site is the largest.

    Rows are added up per cell first and written; site totals and the overall maximum come from those
    sums, so that the rows are read once.
    """
    cells = checkpoint(df.where(rank).groupBy(*category_keys, *site_keys).agg(F.sum(value).alias("category_reads")))
    sites = add_group_aggs(cells, site_keys, {"site_reads": F.sum("category_reads")})
    shares = sites.withColumn("percent", F.col("category_reads") / F.col("site_reads"))
    return add_group_aggs(shares, [], {"__top": F.max("site_reads")}).withColumn(
        "is_hotspot", F.col("site_reads") == F.col("__top")
    ).drop("__top")


def hierarchy_area(df: DataFrame, group1: str, group2: str, value: str) -> DataFrame:
    """Area table of two levels: sums per pair, without NULL groups and double ``NA`` labels."""
    sums = df.groupBy(group1, group2).agg(F.sum(value).alias(value)).dropna(subset=[group1, group2])
    return sums.where((F.col(group1) != "NA") | (F.col(group2) != "NA"))


def axis_labels(df: DataFrame, sample: str, score: str) -> DataFrame:
    """Distinct samples in the order of their axis score."""
    return df.select(sample, score).distinct().orderBy(score, sample)
