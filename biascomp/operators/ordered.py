"""Order-dependent operators that stay parallel inside one huge group.

Rows are range-partitioned by (group, order) and materialised with their slice number, so a hot
group spreads over many slices. A running value is then the value inside the slice combined with
the value carried over from the other slices; the carried table has one row per (group, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from biascomp.functions.numeric import ratio
from biascomp.operators.groups import add_group_aggs, join_on
from biascomp.session import checkpoint

SLICE, POS, ALL = "__slice", "__pos", "__all"


def _sort_key(name: str) -> Column:
    """``"x"`` sorts upwards, ``"-x"`` downwards."""
    return F.col(name[1:]).desc() if name.startswith("-") else F.col(name).asc()


class OrderedRows:
    """Rows in a total order within groups. ``order`` must be unique inside a group."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str]):
        self.by = list(by) or [ALL]
        if not by:
            df = df.withColumn(ALL, F.lit(0))
        keys = [_sort_key(o) for o in order]
        sliced = df.repartitionByRange(*[F.col(b) for b in self.by], *keys).withColumn(
            SLICE, F.spark_partition_id()
        )
        rows = checkpoint(sliced)
        self._within = Window.partitionBy(SLICE, *self.by).orderBy(*keys)
        self.rows = rows.withColumn(POS, F.row_number().over(self._within))

    def running(
        self, value: Column, out: str, how: str = "sum", backwards: bool = False, within: Sequence[str] = ()
    ) -> OrderedRows:
        """Add the running sum, min, max or last known value, in order or against it.

        ``within`` names further columns: the value then runs over each part of the group on its
        own. The parts need no order or exchange of their own, as slices follow each other in order.
        """
        by = [*self.by, *within]
        # against the order the sort is turned round: a frame that grows row by row costs one step
        # per row, a frame open to the end is evaluated anew for every row
        place, slices = self._within, F.col(SLICE).asc()
        if backwards:
            place, slices = Window.partitionBy(SLICE, *by).orderBy(F.desc(POS)), F.col(SLICE).desc()
        elif within:
            place = Window.partitionBy(SLICE, *by).orderBy(POS)
        agg = {
            "sum": F.sum,
            "min": F.min,
            "max": F.max,
            "known": lambda c: F.last(c, ignorenulls=True),
        }[how]
        rows = self.rows.withColumn("__v", value)
        if how == "known":
            pick = F.min_by if backwards else F.max_by
            per_slice = pick("__v", F.when(F.col("__v").isNotNull(), F.col(POS)))
        else:
            per_slice = agg(F.col("__v"))
        carried = rows.groupBy(*by, SLICE).agg(per_slice.alias("__s")).select(
            *by,
            SLICE,
            agg(F.col("__s"))
            .over(Window.partitionBy(*by).orderBy(slices).rowsBetween(Window.unboundedPreceding, -1))
            .alias("__c"),
        )
        here = agg(F.col("__v")).over(place.rowsBetween(Window.unboundedPreceding, 0))
        joined = join_on(rows.withColumn("__h", here), carried, [*by, SLICE])
        merged = {
            "sum": F.coalesce("__h", F.lit(0)) + F.coalesce("__c", F.lit(0)),
            "min": F.least("__h", "__c"),
            "max": F.greatest("__h", "__c"),
            "known": F.coalesce("__h", "__c"),
        }[how]
        return self._with(joined.withColumn(out, merged).drop("__v", "__h", "__c"))

    def _with(self, rows: DataFrame) -> OrderedRows:
        out = object.__new__(OrderedRows)
        out.by, out._within, out.rows = self.by, self._within, rows
        return out

    def done(self) -> DataFrame:
        return self.rows.drop(SLICE, POS, ALL)


def row_number(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """Position of each row in its ordered group."""
    return OrderedRows(df, by, order).running(F.lit(1).cast("long"), out).done()


def group_middle(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """The middle row of each ordered group (the upper one of two) and its position."""
    numbered = add_group_aggs(row_number(df, by, order, out), by, {"__n": F.count(F.lit(1))})
    return numbered.where(F.col(out) == F.floor(F.col("__n") / 2) + 1).drop("__n")


def fill_down_up(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Replace NULLs by the last known value of the group, else by the next one."""
    run = OrderedRows(df, by, order)
    run = run.running(F.col(value), "__down", "known").running(F.col(value), "__up", "known", backwards=True)
    return run.done().withColumn(value, F.coalesce("__down", "__up")).drop("__down", "__up")


def is_known(df: DataFrame, value: str) -> Column:
    """Neither NULL nor NaN: both are missing values."""
    known = F.col(value).isNotNull()
    return known & ~F.isnan(value) if isinstance(df.schema[value].dataType, (DoubleType, FloatType)) else known


def value_counts(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> OrderedRows:
    """Distinct values per group in order, with ``__n`` rows each and ``__upto`` rows so far.

    ``weight`` names a column that says how many rows each row stands for.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(is_known(df, value)).groupBy(*by, value).agg(n.alias("__n"))
    return OrderedRows(counts, by, [value]).running(F.col("__n"), "__upto")


def ecdf(df: DataFrame, by: Sequence[str], value: str, out: str = "ecdf") -> DataFrame:
    """Share of the group's rows at or below each distinct value."""
    counts = value_counts(df, by, value).done()
    full = add_group_aggs(counts, by, {"__all_n": F.sum("__n")})
    return full.withColumn(out, ratio("__upto", "__all_n")).drop("__n", "__upto", "__all_n")


def average_ranks(
    df: DataFrame, by: Sequence[str], value: str, out: str, weight: str | None = None
) -> DataFrame:
    """Rank of each distinct value, ties sharing the mean of their positions."""
    counts = value_counts(df, by, value, weight).done()
    rank = F.col("__upto") - (F.col("__n") - 1) / 2
    return counts.withColumn(out, rank).drop("__n", "__upto")


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], mean: str | None = None,
    count: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``, and on request
    the mean and the number of known values.

    Values are counted first, then located by their running count, so no task ever holds the
    values of a whole group.
    """
    counts = value_counts(df, by, value).done()
    located = add_group_aggs(counts, by, {"__all_n": F.sum("__n")})
    aggs: list[Column] = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("__all_n") - 1)
        low = F.min(F.when(F.col("__upto") > F.floor(pos), F.col(value).cast("double")))
        high = F.min(F.when(F.col("__upto") > F.ceil(pos), F.col(value).cast("double")))
        part = F.first(pos - F.floor(pos))
        aggs.append((low + (high - low) * part).alias(name))
    if mean is not None:
        aggs.append((F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias(mean))
    if count is not None:
        aggs.append(F.first("__all_n").alias(count))
    return located.groupBy(*by).agg(*aggs)


def median(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return quantiles(df, by, value, {out: 0.5})


def medians_at_two_levels(
    df: DataFrame, by: Sequence[str], part: Sequence[str], value: str, tie: Sequence[str], out_group: str, out_part: str
) -> DataFrame:
    """Every row with the median of its group and of its part of the group.

    One ordering serves both levels: rows are sorted by value within the group, and the rows of a
    part are counted on their own along the way. The input is read once and written once. NULL and
    NaN are missing values; a group or part without a known one gets NULL.
    """
    run = OrderedRows(df, by, [value, *part, *tie])
    keys = [*run.by, *part]
    known = is_known(df, value)
    one = known.cast("long")
    places = run.running(one, "__g").running(one, "__p", within=part).rows
    in_part = run.rows.groupBy(*keys).agg(F.sum(one).alias("__np"))
    in_group = in_part.groupBy(*run.by).agg(F.sum("__np").alias("__ng"))
    located = join_on(places, join_on(in_part, in_group, run.by), keys)

    def ends(upto: str, n: str) -> dict[str, Column]:
        middle = (F.col(n) - 1) / 2
        found = F.col(value).cast("double")
        return {
            f"{upto}_low": F.min(F.when(known & (F.col(upto) > F.floor(middle)), found)),
            f"{upto}_high": F.min(F.when(known & (F.col(upto) > F.ceil(middle)), found)),
        }

    def half(upto: str) -> Column:
        return F.col(f"{upto}_low") + (F.col(f"{upto}_high") - F.col(f"{upto}_low")) * 0.5

    both = {**ends("__p", "__np"), **ends("__g", "__ng")}
    parts = located.groupBy(*keys).agg(*[c.alias(n) for n, c in both.items()])
    group = parts.groupBy(*run.by).agg(F.min("__g_low").alias("__g_low"), F.min("__g_high").alias("__g_high"))
    medians = join_on(
        parts.select(*keys, half("__p").alias(out_part)), group.select(*run.by, half("__g").alias(out_group)), run.by
    )
    return join_on(run.rows, medians, keys).drop(SLICE, POS, ALL)


def order_by_mean(
    df: DataFrame, by: Sequence[str], category: str, value: str, out: str = "category_order"
) -> DataFrame:
    """Position of each category by ascending mean, equal means in name order."""
    means = df.groupBy(*by, category).agg(F.avg(value).alias("mean_value"))
    return row_number(means, by, ["mean_value", category], out)


# ------------------------------------------------------------------ top lists


def top_n(df: DataFrame, key: str, value: str, n: int, out: str = "total") -> DataFrame:
    """The n categories with the largest totals; Spark keeps n rows per task, then merges."""
    return df.groupBy(key).agg(F.sum(value).alias(out)).orderBy(F.desc(out), key).limit(n)


def top_page(df: DataFrame, key: str, value: str, skip: int, n: int, out: str = "total") -> DataFrame:
    """The n categories that follow the first ``skip`` ones."""
    totals = df.groupBy(key).agg(F.sum(value).alias(out))
    return totals.orderBy(F.desc(out), key).offset(skip).limit(n)


def lump_outside_top(
    df: DataFrame, key: str, values: Sequence[str], n: int, by: Sequence[str], label: str = "Other"
) -> DataFrame:
    """Re-label categories outside the union of the top-n lists and add them up.

    The input is added up once per cell; the lists and the result both start from those sums. Spark
    keeps n rows per list and task ahead of the shuffle that ranks them.
    """
    sums = [F.sum(v).alias(v) for v in values]
    cells = df.groupBy(*by, key).agg(*sums)
    totals = cells.groupBy(key).agg(*sums).unpivot([key], list(values), "__list", "__total")
    place = F.row_number().over(Window.partitionBy("__list").orderBy(F.desc("__total"), key))
    lists = totals.withColumn("__place", place).where(F.col("__place") <= n)
    kept = lists.select(key).distinct().withColumn("__kept", F.lit(True))
    flagged = join_on(cells, kept, [key]).withColumn(key, F.when(F.col("__kept"), F.col(key)).otherwise(F.lit(label)))
    return flagged.groupBy(*by, key).agg(*sums)


def first_values(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n distinct values of ``key`` in row order."""
    first = F.min(F.struct(*[F.col(o) for o in order]))
    return df.groupBy(key).agg(first.alias("__at")).orderBy("__at", key).limit(n).select(key)
