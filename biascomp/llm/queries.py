"""The queries of this subpackage over the driver tables, and the SQL beside those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biascomp.llm import chunks, cuckoo, decontaminate, langid, mixing, periodic, pii, quality, simhash, spelling, suffixes, superminhash, tokenshards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return register


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op2_benchmark_decontamination",
    r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null),
iw as (
  select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[k:k + 9], ' ') as win
  from (select item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as k from i where len(ws) > 0)),
lens as (select distinct n from iw),
dw as (
  select doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') as win
  from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as k from w), lens where k + n - 1 <= len(ws)),
hit as (select distinct doc_id, k, dw.n, item_id from dw join iw using (win) where dw.n = iw.n),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hit) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items
          from (select distinct doc_id, cast(item_id as varchar) as s from hit where item_id is not null) group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from w left join covered using (doc_id) left join named using (doc_id)
""",
)
def op2(spark, sf_dir):
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op9_source_mixing",
    r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, ''))) as key from documents),
s as (
  select source, cast(sum(size) as hugeint) as s,
         cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as hugeint) as w
  from d group by source),
o as (
  select *, sum(s) over () as total, sum(w) over () as all_w,
         coalesce(sum(s) over (order by s / w, source rows between unbounded preceding and 1 preceding), 0) as s_before,
         coalesce(sum(w) over (order by s / w, source rows between unbounded preceding and 1 preceding), 0) as w_before
  from s),
c as (select *, w * (total - 3 * s_before) > 3 * s * (all_w - w_before) as capped from o),
l as (select max(total) - coalesce(sum(3 * s) filter (capped), 0) as num, sum(w) filter (not capped) as den from c),
t as (
  select source, cast(s as bigint) as source_size,
         case when capped then cast(3 * s as double) else cast(w as double) * cast(num as double) / cast(den as double) end as target
  from c, l),
r as (
  select doc_id, size, source_size, target,
         case when source_size = 0 then 0.0 else least(target / cast(source_size as double), 3.0) end as rate,
         cast(('0x' || substr(md5('17:' || key), 1, 8)) as bigint) / 4294967296.0::double as u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken
from r
""",
)
def op9(spark, sf_dir):
    return mixing.mix_plan(read(spark, sf_dir, "documents"))


@query(
    "op10_exact_dedup",
    r"""
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from d
""",
)
def op10(spark, sf_dir):
    return cuckoo.exact_dedup(read(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_language_id")
def op6(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


@query("op7_simhash_near_dedup")
def op7(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_substring_dedup")
def op5(spark, sf_dir):
    found = chunks.substring_dedup(read(spark, sf_dir, "documents"))
    return found.drop("kept")


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


@query("op8_pii_weak_supervision")
def op8(spark, sf_dir):
    found = pii.find(read(spark, sf_dir, "documents"))
    order = F.array(*[F.lit(k) for k in pii.KINDS])
    by_kind = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(F.array_position(order, s.kind).alias("place"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")),
    )
    kinds = F.transform("base", lambda s: s.kind)
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed(F.array_sort(by_kind)).alias("spans"))


@query("op3_suffix_array_dedup")
def op3(spark, sf_dir):
    return suffixes.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


@query("op1_token_shards")
def op1(spark, sf_dir):
    return tokenshards.sequences(read(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    found = periodic.periodic_runs(periodic.with_planted_runs(read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", periodic.strongest("runs"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.spelling_variants(read(spark, sf_dir, "documents"), edit=spelling.planted_deletion)


@query("op11_superminhash_near_dedup")
def op11(spark, sf_dir):
    return superminhash.near_duplicates(read(spark, sf_dir, "documents"))
