"""Proportions, log-ratios, depth normalisation and raw-versus-corrected tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.functions.numeric import is_finite, log2_ratio, ratio, round_half_even
from biascomp.operators import ordered
from biascomp.operators.groups import add_group_aggs, join_groups, join_on, share
from biascomp.session import checkpoint

#: Added to a proportion before its logarithm is taken.
PSEUDO_COUNT = 1e-5


def closure(df: DataFrame, sample: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Counts to proportions per sample."""
    return share(df, sample, value, out)


def clr(
    df: DataFrame, part: Sequence[str], value: str, out: str = "clr", eps: float = PSEUDO_COUNT,
    size: Column | None = None, bounded: bool = False,
) -> DataFrame:
    """Centred log-ratio per part of the table (the whole table for an empty ``part``).

    Values whose logarithm does not exist stay out of the mean and get the smallest valid
    logarithm. With ``size``, a constant column holding the number of categories of the part,
    rows not present count as zeros without being materialised.
    """
    log = F.ln(F.col(value).cast("double") + F.lit(eps))
    df = df.withColumn("__log", F.when(is_finite(log), log))
    aggs = {"__mean": F.avg("__log"), "__low": F.min("__log")}
    if size is not None:
        absent = F.max(size) - F.count("__log")
        aggs["__mean"] = (F.coalesce(F.sum("__log"), F.lit(0.0)) + absent * F.ln(F.lit(eps))) / F.max(size)
    df = add_group_aggs(df, part, aggs, bounded)
    return df.withColumn(
        out, F.when(F.col("__log").isNotNull(), F.col("__log") - F.col("__mean")).otherwise(F.col("__low"))
    ).drop("__log", "__mean", "__low")


def depth(df: DataFrame, sample: Sequence[str], value: str, out: str = "depth") -> DataFrame:
    """Reads per sample."""
    return df.groupBy(*sample).agg(F.sum(value).alias(out))


def normalise_to_median_depth(
    df: DataFrame, by: Sequence[str], sample: Sequence[str], value: str, out: str = "normalised"
) -> DataFrame:
    """Scale every sample to the median depth of its group, rounded half to even."""
    depths = checkpoint(depth(df, [*by, *sample], value, "__depth"))  # read twice below
    mid = ordered.median(depths, by, "__depth", "__median")
    depths = join_groups(depths, mid, by)
    scaled = ratio(F.col("__median") * F.col(value), "__depth")
    joined = join_on(df, depths, [*by, *sample])
    return joined.withColumn(out, F.coalesce(round_half_even(scaled), F.col(value).cast("double"))).drop(
        "__depth", "__median"
    )


def normalise_to_median_count(
    df: DataFrame, by: Sequence[str], sample: Sequence[str], category: str, value: str,
    drop: str | None = None, out: str = "normalised",
) -> DataFrame:
    """Leave one category out, then bring each sample's median count to the group's median."""
    kept = df.where(F.col(category) != drop) if drop else df
    joined = ordered.medians_at_two_levels(kept, by, sample, value, [category], "__group", "__own")
    scaled = round_half_even(ratio(F.col(value) * F.col("__group"), "__own"))
    return joined.withColumn(out, scaled).drop("__own", "__group")


def mean_share(
    df: DataFrame, by: Sequence[str], sample: str, category: str, value: str,
    how: str = "mean", out: str = "mean_share",
) -> DataFrame:
    """Mean or sum over a group's samples of a category's share, absent categories being zero."""
    per_sample = share(df, [*by, sample], value, "__share")
    sums = per_sample.groupBy(*by, category).agg(F.sum("__share").alias(out))
    if how == "sum":
        return sums
    n = depth(df, [*by, sample], value, "__d").groupBy(*by).agg(F.count("__d").alias("__n"))
    return join_on(sums, n, by).withColumn(out, ratio(out, "__n")).drop("__n")


def log2_bias(df: DataFrame, raw: str, estimate: str, low: str, high: str) -> DataFrame:
    """log2 of raw over corrected share, with the interval; only finite rows stay."""
    out = df.withColumns(
        {
            "log2_bias": log2_ratio(raw, estimate),
            "log2_low": log2_ratio(raw, high),
            "log2_high": log2_ratio(raw, low),
        }
    )
    return out.where(is_finite("log2_bias") & is_finite("log2_low") & is_finite("log2_high"))


def corrected_counts(
    estimates: DataFrame, counts: DataFrame, sample: Sequence[str], share_col: str, value: str,
    out: str = "corrected",
) -> DataFrame:
    """Corrected share times the depth of the sample."""
    d = depth(counts, sample, value, "depth")
    return join_on(estimates, d, sample).withColumn(out, F.col(share_col) * F.col("depth"))


def raw_vs_corrected(df: DataFrame, sample: Sequence[str], category: str, raw: str, corrected: str) -> DataFrame:
    """Long table of both metrics, each brought to one per sample."""
    sums = df.groupBy(*sample, category).agg(
        F.coalesce(F.sum(raw), F.lit(0.0)).alias(raw), F.coalesce(F.sum(corrected), F.lit(0.0)).alias(corrected)
    )
    long = sums.unpivot([*sample, category], [raw, corrected], "metric", "reads")
    return share(long, [*sample, "metric"], "reads", "proportion")
