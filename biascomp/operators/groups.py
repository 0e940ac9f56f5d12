"""Group summaries attached to rows.

A summary is aggregated first (with map-side combine) and joined back, so that a group holding a
third of all rows is never gathered in one task: a small summary is broadcast by Spark's own size
check, a large one goes through a sort-merge join whose skewed partitions are split.

Joins between tables that come from the same source are null-safe: NULL keys form a group like any
other, and as no NOT NULL filter is pushed into one side only, both sides share one shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from biascomp.functions.numeric import ratio


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = True
) -> DataFrame:
    """Equi-join keeping the left keys; ``null_safe`` lets NULL keys meet."""
    if not null_safe:
        return left.join(right, list(keys), how)
    renamed = right.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__key_{k}" for k in keys])


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one key together, over all shuffle partitions.

    Meant ahead of work that is heavy on the processor but small in bytes, which adaptive execution
    would otherwise merge into few tasks. A grouping by the same keys needs no further shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two tables of group summaries; without groups the other one's single row is read as values."""
    if by:
        return join_on(left, right, by)
    return left.withColumns({c: right.select(c).scalar() for c in right.columns})


def rows_without(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the other table does not list (NULL keys compare like any value)."""
    return join_on(left, right.select(*keys), keys, "left_anti")


def add_group_aggs(
    df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column], bounded: bool = False
) -> DataFrame:
    """Every row with the summaries of its group; an empty ``by`` means the whole table.

    ``bounded`` is for already aggregated tables whose groups have a fixed size limit, such as the
    categories of a fixed list within one sample: a window then needs one shuffle and no join.
    """
    if bounded and by:
        return df.withColumns({n: c.over(Window.partitionBy(*by)) for n, c in aggs.items()})
    if not by:
        # one row of values, read once however many there are
        all_ = df.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("__all")).scalar()
        return df.withColumns({n: all_[n] for n in aggs})
    cols = [c.alias(n) for n, c in aggs.items()]
    return join_on(df, df.groupBy(*by).agg(*cols), by)


def share(df: DataFrame, by: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """``value`` over its group total; NULL for a group that sums to zero."""
    total = F.sum(value)
    return (
        add_group_aggs(df, by, {"__total": total})
        .withColumn(out, ratio(value, "__total"))
        .drop("__total")
    )


def group_flag(df: DataFrame, by: Sequence[str], cond: Column, out: str) -> DataFrame:
    """Whether any row of the group meets the condition."""
    return add_group_aggs(df, by, {out: F.coalesce(F.bool_or(cond), F.lit(False))})


def chosen_row_value(df: DataFrame, by: Sequence[str], chosen: Column, value: str, out: str) -> DataFrame:
    """Value of the chosen row of the group on every row."""
    return add_group_aggs(df, by, {out: F.max(F.when(chosen, F.col(value)))})


def rows_at_max(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """All rows that reach the largest value of their group, ties kept."""
    return add_group_aggs(df, by, {"__max": F.max(value)}).where(F.col(value) == F.col("__max")).drop("__max")


def distinct_first(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the stated order, by aggregation rather than sorting."""
    rest = [c for c in df.columns if c not in by]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    out = df.groupBy(*by).agg(first.alias("__row"))
    return out.select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest])


def sum_all_numeric(df: DataFrame, by: Sequence[str], how: str = "sum") -> DataFrame:
    """Sum or mean of every numeric column per group."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in by]
    fn = {"sum": F.sum, "mean": F.avg}[how]
    return df.groupBy(*by).agg(*[fn(n).alias(n) for n in numeric])


def closure_errors(df: DataFrame, by: Sequence[str], value: str, tol: float = 1e-6) -> DataFrame:
    """Groups whose shares do not add up to one."""
    total = df.groupBy(*by).agg(F.sum(value).alias("total"))
    return total.where(F.abs(F.col("total") - 1) > tol)


def conservation(before: DataFrame, after: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Group totals before and after a step, and what was lost; a NULL group is one group.

    One sum over both tables at once: no join, so groups on one side only need no care.
    """
    sides = [
        df.select(*by, F.col(value).alias("__v"), F.lit(here).alias("__before")) for df, here in ((before, True), (after, False))
    ]
    total = {
        name: F.coalesce(F.sum(F.when(F.col("__before") == here, F.col("__v"))), F.lit(0)) for name, here in (("before", True), ("after", False))
    }
    both = sides[0].unionByName(sides[1]).groupBy(*by).agg(*[c.alias(n) for n, c in total.items()])
    return both.withColumn("lost", F.col("before") - F.col("after"))


def as_map(df: DataFrame, by: Sequence[str], key: str, value: str, out: str = "lookup") -> DataFrame:
    """Named lookup per group. Meant for code lists: duplicates go first, one entry per key."""
    pairs = df.groupBy(*by, key).agg(F.min(value).alias("__v"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("__v"))))
    return pairs.groupBy(*by).agg(F.map_from_entries(entries).alias(out))
