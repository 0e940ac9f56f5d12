"""Category hierarchies: best rows, merging, back-filling, labels and roll-up."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.operators.groups import join_on, rows_without, share

REST = "other"


def blank(c: Column) -> Column:
    """True for NULL or a blank string."""
    return c.isNull() | (F.trim(c) == "")


def known_ranks(ranks: Sequence[str]) -> Column:
    """How many ranks of a row are filled in."""
    return reduce(lambda a, b: a + b, [F.col(r).isNotNull().cast("int") for r in ranks])


def dedupe_best(df: DataFrame, key: str, ranks: Sequence[str], ties: str = "drop") -> DataFrame:
    """The row with the most known ranks per key.

    ``ties="drop"`` leaves out keys whose best rows tie, ``ties="first"`` keeps the smallest row.
    Rows are merged by (key, score) before they are merged by key, so copies of one key collapse
    on the map side.
    """
    cols = [c for c in df.columns if c != key]
    scored = df.withColumn("__score", known_ranks(ranks))
    per_score = scored.groupBy(key, "__score").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*cols)).alias("row")
    )
    best = per_score.groupBy(key).agg(F.max_by(F.struct("n", "row"), "__score").alias("best"))
    if ties == "drop":
        best = best.where(F.col("best.n") == 1)
    return best.select(key, *[F.col(f"best.row.{c}").alias(c) for c in cols])


def merge(a: DataFrame, b: DataFrame, key: str, ranks: Sequence[str]) -> DataFrame:
    """Full outer merge of two hierarchies; per rank ``a`` wins unless only ``b`` knows it."""
    b = b.select(key, *[F.col(r).alias(f"__b_{r}") for r in ranks])
    both = a.select(key, *ranks).join(b, key, "full")
    return both.select(key, *[F.coalesce(r, f"__b_{r}").alias(r) for r in ranks])


def backfill(df: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Fill a blank rank from its parent, from the top rank down."""
    out = df
    for parent, rank in zip(ranks, ranks[1:]):
        out = out.withColumn(rank, F.when(blank(F.col(rank)), F.col(parent)).otherwise(F.col(rank)))
    return out


def label_unidentified(
    df: DataFrame, rank: str, parent: str, only: Sequence[str] | None = None
) -> DataFrame:
    """NULL takes the parent, blank becomes the rest label, and a rest row under a known parent
    becomes ``unidentified <parent>`` (only under the listed parents, when given)."""
    filled = F.when(F.col(rank).isNull(), F.col(parent)).otherwise(F.col(rank))
    cleaned = F.when(F.trim(filled) == "", F.lit(REST)).otherwise(filled)
    listed = F.col(parent).isin(list(only)) if only else ~blank(F.col(parent)) & (F.col(parent) != REST)
    return df.withColumn(
        rank,
        F.when((cleaned == REST) & listed, F.concat(F.lit("unidentified "), F.col(parent))).otherwise(cleaned),
    )


def label_by_lowest_known(df: DataFrame, ranks: Sequence[str], out: str) -> DataFrame:
    """The lowest rank if known, else ``unidentified`` with the nearest known parent."""
    *parents, lowest = ranks
    known = lambda r: ~blank(F.col(r)) & (F.col(r) != REST)
    label = F.when(known(lowest), F.col(lowest))
    for r in reversed(parents):
        label = label.when(known(r), F.concat(F.lit("unidentified "), F.col(r)))
    return df.withColumn(out, label.otherwise(F.lit("unidentified")))


def rollup(
    counts: DataFrame, taxonomy: DataFrame, key: str, sample: Sequence[str], ranks: Sequence[str],
    value: str, keep_rest: bool = True,
) -> DataFrame:
    """Counts per sample and lineage down to the last of ``ranks``.

    Rows without a taxonomy entry or with a NULL last rank leave the lineage table;
    with ``keep_rest`` their reads come back as one ``other`` row per sample, so sample totals
    are conserved. One join and one aggregation: the rest is grouped in the same pass.
    """
    joined = counts.join(taxonomy.select(key, *ranks), key, "left" if keep_rest else "inner")
    last = F.col(ranks[-1])
    if not keep_rest:
        return joined.where(last.isNotNull()).groupBy(*sample, *ranks).agg(F.sum(value).alias(value))
    lineage = [F.when(last.isNull(), F.lit(REST)).otherwise(F.col(r)).alias(r) for r in ranks]
    return joined.select(*sample, *lineage, value).groupBy(*sample, *ranks).agg(F.sum(value).alias(value))


def rollup_levels(
    counts: DataFrame, taxonomy: DataFrame, key: str, sample: Sequence[str], ranks: Sequence[str],
    value: str, keep_rest: bool = True, level: str = "level",
) -> DataFrame:
    """``rollup`` to every rank at once: ``level`` names the rank, ranks below it are NULL.

    A read joins the taxonomy once and is added to the lineage of every level before the one
    exchange of the sums, so each level keeps the sample's total (with ``keep_rest``).
    """
    joined = counts.join(taxonomy.select(key, *ranks), key, "left" if keep_rest else "inner")
    lineages = []
    for depth, rank in enumerate(ranks, 1):
        last = F.col(rank)
        names = [F.when(last.isNull(), F.lit(REST)).otherwise(F.col(r)).alias(r) for r in ranks[:depth]]
        below = [F.lit(None).cast("string").alias(r) for r in ranks[depth:]]
        lineage = F.struct(F.lit(rank).alias(level), *names, *below)
        lineages.append(lineage if keep_rest else F.when(last.isNotNull(), lineage))
    each = joined.select(*sample, value, F.explode(F.array_compact(F.array(*lineages))).alias("__l"))
    return each.select(*sample, "__l.*", value).groupBy(*sample, level, *ranks).agg(F.sum(value).alias(value))


def lineage_table(df: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Distinct lineages; where the last rank is the rest label, every rank is."""
    last = F.col(ranks[-1])
    cols = [F.when(last == REST, F.lit(REST)).otherwise(F.col(r)).alias(r) for r in ranks]
    return df.select(*cols).distinct()


def exclude_lineages(df: DataFrame, rules: Sequence[dict[str, str]]) -> DataFrame:
    """Leave out rows that match every rank of any rule."""
    out = df
    for rule in rules:
        hit = reduce(lambda a, b: a & b, [F.col(r) == v for r, v in rule.items()])
        out = out.where(~F.coalesce(hit, F.lit(False)))
    return out


def rest_composition(
    rejected: DataFrame, taxonomy: DataFrame, key: str, sample: Sequence[str], rank: str, value: str
) -> DataFrame:
    """What a rejected set is made of: reads and share by rank within each sample."""
    sums = (
        rejected.join(taxonomy.select(key, rank), key, "left")
        .groupBy(*sample, rank)
        .agg(F.sum(value).alias(value))
    )
    return share(sums, sample, value, "share")


def unknown_keys(counts: DataFrame, taxonomy: DataFrame, key: str, sample: Sequence[str], value: str) -> DataFrame:
    """Reads per sample of keys that the taxonomy does not list."""
    return (
        rows_without(counts, taxonomy, [key]).groupBy(*sample).agg(F.sum(value).alias(value))
    )


def assemble_long(
    counts: DataFrame, taxonomy: DataFrame, meta: DataFrame, key: str, sample: str, value: str
) -> DataFrame:
    """Taxonomy ⋈ non-zero counts ⋈ sample metadata; entries never seen stay with NULL counts."""
    seen = counts.where(F.col(value).isNotNull() & (F.col(value) != 0))
    return join_on(taxonomy.join(seen, key, "left"), meta, [sample], null_safe=False)


def attach_label(df: DataFrame, labels: DataFrame, key: str, label: str, missing: str = REST) -> DataFrame:
    """Label of each key, ``missing`` where the label table has none."""
    return join_on(df, labels.select(key, label), [key], null_safe=False).na.fill(missing, [label])
