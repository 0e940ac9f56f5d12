"""Abundance filters on long counts. Absent (category, sample) pairs count as zeros.

Zeros are never materialised: the number of zeros of a category is the number of samples of its
group minus the samples in which it was seen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biascomp.functions.numeric import ratio
from biascomp.operators import ordered
from biascomp.operators.groups import join_on, rows_without
from biascomp.session import checkpoint

REST = "other"


def n_samples(
    df: DataFrame, by: Sequence[str], sample: str, value: str, out: str = "n_samples", where: Column | None = None
) -> DataFrame:
    """Samples per group that have a depth: reads are added per sample, then samples are counted.

    Asking for the depth keeps the same columns as the per-category branch, so both read one shuffle.
    """
    reads = F.col(value) if where is None else F.when(where, F.col(value))
    per_sample = df.groupBy(*by, sample).agg(F.sum(reads).alias("__depth"))
    return per_sample.groupBy(*by).agg(F.count("__depth").alias(out))


def presence(
    df: DataFrame, by: Sequence[str], sample: str, category: str, value: str,
    aggs: dict[str, Column], where: Column | None = None,
) -> DataFrame:
    """Per category: samples with reads, samples of the group, and further aggregates.

    ``df`` holds one row per (group, sample, category). ``where`` says which rows count, as a
    condition inside the aggregates, so that several subsets are read in one pass.
    """
    hit = F.col(value) > 0
    seen = F.count(F.when(hit if where is None else where & hit, F.lit(1)))
    per = df.groupBy(*by, category).agg(seen.alias("n_seen"), *[c.alias(n) for n, c in aggs.items()])
    return join_on(per, n_samples(df, by, sample, value, where=where), by)


def _times_above(value: str, least: int, where: Column | None = None) -> Column:
    """Rows above ``least``, among those that count."""
    hit = F.col(value) > least
    return F.count(F.when(hit if where is None else where & hit, F.lit(1)))


def zero_tolerance(
    df: DataFrame, calib: Column, by: Sequence[str], sample: str, category: str, value: str, max_zero: int = 2
) -> DataFrame:
    """Categories with at most ``max_zero`` zeros among the calibration samples.

    A category never seen in calibration has only zeros there.
    """
    p = presence(df, by, sample, category, value, {}, calib)
    zeros = F.col("n_samples") - F.col("n_seen")
    return p.withColumn("n_zero", zeros).where(F.col("n_zero") <= max_zero).select(*by, category, "n_zero")


def experiment_shares(
    df: DataFrame, experiment: str, by: Sequence[str], category: str, value: str
) -> DataFrame:
    """Share of each category in the reads of each experiment; NULL outside the experiments."""
    cells = df.groupBy(*by, experiment, category).agg(F.sum(value).alias("__v"))
    totals = cells.groupBy(*by, experiment).agg(F.sum("__v").alias("__t"))
    return join_on(cells, totals, [*by, experiment]).withColumn(
        "share", F.when(F.col(experiment).isNotNull(), ratio("__v", "__t"))
    ).drop("__v", "__t")


def percent_of_experiment(
    df: DataFrame, experiment: str, by: Sequence[str], category: str, value: str, p: float = 0.01
) -> DataFrame:
    """Categories reaching share ``p`` of the reads in at least one experiment."""
    shares = experiment_shares(df, experiment, by, category, value)
    best = shares.groupBy(*by, category).agg(F.max("share").alias("max_share"))
    return best.where(F.col("max_share") >= p)


def in_all_treatments(
    df: DataFrame, cell: Sequence[str], by: Sequence[str], category: str, value: str
) -> DataFrame:
    """Categories with reads in every treatment cell of the group."""
    cells = df.groupBy(*by, *cell, category).agg(F.sum(value).alias("__v"))
    depths = cells.groupBy(*by, *cell).agg(F.sum("__v").alias("__d"))
    n_cells = depths.groupBy(*by).agg(F.count("__d").alias("n_cells"))
    hit = cells.groupBy(*by, category).agg(F.count(F.when(F.col("__v") > 0, F.lit(1))).alias("n_hit"))
    return join_on(hit, n_cells, by).where(F.col("n_hit") == F.col("n_cells"))


def above_quantile(
    df: DataFrame, calib: Column, by: Sequence[str], sample: str, category: str, value: str, q: float = 0.9
) -> DataFrame:
    """Categories whose total exceeds the q quantile of totals and that no calibration sample lacks.

    The table of totals is written once: the cut-off is computed from it and compared with it.
    """
    totals = checkpoint(presence(df, by, sample, category, value, {"total": F.sum(value)}, calib))
    cut = ordered.quantiles(totals, by, "total", {"cutoff": q})
    kept = join_on(totals, cut, by).where(F.col("total") > F.col("cutoff"))
    return kept.where(F.col("n_seen") == F.col("n_samples")).select(*by, category, "total", "cutoff")


def prevalence(
    df: DataFrame, by: Sequence[str], sample: str, category: str, value: str, min_n: int = 1, share: float = 0.3
) -> DataFrame:
    """Categories counted more than ``min_n`` times in at least ``share`` of the samples."""
    p = presence(df, by, sample, category, value, {"n_often": _times_above(value, min_n)})
    p = p.withColumn("prevalence", ratio("n_often", "n_samples"))
    return p.where(F.col("prevalence") >= share).select(*by, category, "prevalence")


def calibration_complete(
    df: DataFrame, calib: Column, by: Sequence[str], sample: str, category: str, value: str,
    max_field_zero: float | None = None,
) -> DataFrame:
    """Categories with some count above one and no zero in calibration; optionally the same
    presence in field samples with at most ``max_field_zero`` zeros."""
    extra = {"often": _times_above(value, 1, calib)}
    if max_field_zero is not None:
        extra["field_often"] = _times_above(value, 1, ~calib)
        extra["field_seen"] = _times_above(value, 0, ~calib)
    p = presence(df, by, sample, category, value, extra, calib)
    kept = (F.col("often") > 0) & (F.col("n_seen") == F.col("n_samples"))
    if max_field_zero is not None:
        p = join_on(p, n_samples(df, by, sample, value, "field_samples", ~calib), by)
        zeros = ratio(F.col("field_samples") - F.col("field_seen"), "field_samples")
        kept = kept & (F.col("field_often") > 0) & (zeros <= max_field_zero)
    return p.where(kept).select(*by, category)


def lump(
    df: DataFrame, kept: DataFrame, keys: Sequence[str], category: str, by: Sequence[str], value: str,
    label: str = REST, split_by: str | None = None,
) -> DataFrame:
    """Re-label categories outside ``kept`` and add them up, so totals are conserved.

    ``split_by`` names a column: rejected rows with a known value there become
    ``unidentified <value>`` instead of the plain rest label.
    """
    flags = kept.select(*keys).distinct().withColumn("__kept", F.lit(True))
    rest = F.lit(label)
    if split_by:
        s = F.col(split_by)
        known = s.isNotNull() & (F.trim(s) != "") & (s != label)
        rest = F.when(known, F.concat(F.lit("unidentified "), s)).otherwise(rest)
    flagged = join_on(df, flags, keys).withColumn(
        category, F.when(F.col("__kept"), F.col(category)).otherwise(rest)
    )
    return flagged.groupBy(*by, category).agg(F.sum(value).alias(value))


def lump_named(
    df: DataFrame, names: Sequence[str], category: str, by: Sequence[str], value: str, label: str = REST
) -> DataFrame:
    """Add the named categories to the rest."""
    relabel = F.when(F.col(category).isin(list(names)), F.lit(label)).otherwise(F.col(category))
    return df.withColumn(category, relabel).groupBy(*by, category).agg(F.sum(value).alias(value))


def high_rest_samples(
    df: DataFrame, sample: Sequence[str], category: str, value: str, share: float, label: str = REST
) -> DataFrame:
    """Samples in which the rest holds more than ``share`` of the reads."""
    rest = F.sum(F.when(F.col(category) == label, F.col(value)).otherwise(F.lit(0)))
    sums = df.groupBy(*sample).agg(rest.alias("rest"), F.sum(value).alias("depth"))
    return sums.withColumn("rest_share", ratio("rest", "depth")).where(F.col("rest") > F.col("depth") * share)


def drop_high_rest(
    df: DataFrame, sample: Sequence[str], category: str, value: str, share: float = 0.2, label: str = REST
) -> DataFrame:
    """Counts without the samples in which the rest exceeds ``share``."""
    bad = high_rest_samples(df, sample, category, value, share, label)
    return rows_without(df, bad, sample)


def threshold_scan(
    df: DataFrame, experiment: str, by: Sequence[str], category: str, value: str, grid: Sequence[float]
) -> DataFrame:
    """Categories kept per threshold of the grid.

    Each category's best share is put between two thresholds once; what a threshold keeps is the
    count from the top of the grid down to it. The work per category does not depend on the grid.
    """
    points = sorted({float(g) for g in grid})
    best = percent_of_experiment(df, experiment, by, category, value, p=0.0)
    steps = Bucketizer(
        splits=[-math.inf, *points, math.inf], inputCol="max_share", outputCol="__step", handleInvalid="keep"
    ).transform(best)
    cells = steps.groupBy(*by, "__step").agg(F.count(F.lit(1)).alias("__n"))
    # as text the grid is one literal, however long, and doubles come back exactly
    numbers = F.split(F.lit(",".join(map(repr, points))), ",").cast("array<double>")
    marks = cells.select(*by).distinct().select(*by, F.posexplode(numbers).alias("__i", "threshold"))
    marks = marks.select(*by, (F.col("__i") + 1.0).alias("__step"), F.lit(0).cast("long").alias("__n"), "threshold")
    none = F.lit(None).cast("double")
    # at most twice the grid's length per group, whatever the number of categories
    down = Window.partitionBy(*by).orderBy(F.desc("__step")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = cells.withColumn("threshold", none).unionByName(marks).withColumn("n_kept", F.sum("__n").over(down))
    return kept.where(F.col("threshold").isNotNull()).select(*by, "threshold", "n_kept")
