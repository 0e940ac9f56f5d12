"""Mixing sources to target weights by repeating documents.

Word counts are added up per source. A source's target is its weight's share of all words, at most
``limit`` times its own; what is cut off is shared out again by weight until no target is above its
limit. A document is then taken floor(rate) times, plus once more with probability equal to the
rest, decided by a seeded hash of its id (of its text where the id is null): the choice needs no
state, so a rerun or a retried task agrees.

Defined cases: a null text has size 0; sources order by code point, null last, and null is a source
of its own; repeated rows share the fate of their id, equal texts without an id that of their text; a source without words has
target 0; an empty table gives no rows; other columns pass through ``mixed`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biascomp.llm.common import fresh, whole_text, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = 17


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources are few against documents (one row each), so they are numbered by one window; the
    totals of each round are sums over that table and only two numbers reach the driver.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = written(per_source.withColumn("weight", weight.cast("long")), "sources")
    top = F.col("source_size") * limit
    total = table.agg(F.sum("source_size")).first()[0] or 0
    left, open_weight = total, table.agg(F.sum("weight")).first()[0] or 1
    while True:
        capped = top * open_weight < F.col("weight") * F.lit(left)
        over = table.agg(
            F.sum(F.when(capped, top)).alias("words"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")
        ).first()
        rest = total - (over["words"] or 0), over["weight"] or 1
        if rest == (left, open_weight):
            break
        left, open_weight = rest
    shared = F.col("weight").cast("double") * F.lit(left).cast("double") / F.lit(open_weight).cast("double")
    return table.select("source", "source_size", F.when(capped, top.cast("double")).otherwise(shared).alias("target"))


def draw_key(doc_id: str, text: str) -> Column:
    """What the draw of a document hashes: its id, or the digest of its text where the id is null."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null:"), F.md5(whole_text(text))))


def copies(rate: Column, key: Column, seed: int = SEED) -> Column:
    """floor(rate), plus one if the key's seeded hash, as a number below 1, is below the rest."""
    text = F.concat_ws(":", F.lit(str(seed)), key)
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    sized = written(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"),
                    draw_key(doc_id, text).alias("key")), "sizes"
    )
    targets = source_targets(sized, weights, limit)
    joined = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    taken = F.col("size") * copies(_rate(limit), F.col("key"), seed)
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _rate(limit: int) -> Column:
    rate = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    return F.coalesce(F.least(rate, F.lit(float(limit))), F.lit(0.0))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    sized = docs.select(F.col(source).alias("source"), n_words(text).alias("size"))
    targets = source_targets(sized, weights, limit)
    n, key = fresh(docs, "n_copies"), fresh(docs, "mix_source")
    rates = targets.select(F.col("source").alias(key), _rate(limit).alias(n))
    repeated = docs.join(rates, docs[source].eqNullSafe(rates[key]))
    again = F.explode(F.sequence(F.lit(1), F.col(n)))
    return (
        repeated.withColumn(n, copies(F.col(n), draw_key(doc_id, text), seed))
        .where(F.col(n) > 0)
        .select(*[F.col(f"`{c}`") for c in docs.columns], again.alias(n))
        .drop(n)
    )
