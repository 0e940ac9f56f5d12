"""Scans, projections, predicates, joins, set operations, reshaping and plain aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from biascomp.functions import numeric as num
from biascomp.functions import text
from biascomp.operators import composition, groups, ordered, reshape, taxonomy
from biascomp.plans.bindings import RANKS
from biascomp.plans.registry import DIGITS, query, r
from biascomp.session import shared_folder
from biascomp.sources import files, snapshots

SIZES = ["S1", "S2", "S3"]
SC = "size_class"


# ------------------------------------------------------------------ sources


@query(
    "scan_matrix_long",
    sql="""select o_orderkey as row_key, unnest(['o_totalprice','o_custkey']) as metric,
           round(unnest([o_totalprice, cast(o_custkey as double)]),6) as metric_value from orders""",
)
def scan_matrix_long(t):
    wide = t.read("orders").select(
        F.col("o_orderkey").alias("row_key"), "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey")
    )
    long = reshape.to_long(wide, ["row_key"], "metric", "metric_value")
    return long.withColumn("metric_value", r("metric_value"))


_NAMED = r"""named as (select *, regexp_extract(file_name,'^predicted_og_([^_]+)_',1) as primer,
  cast(strptime(regexp_extract(file_name,'(\d{2}_\d{2}_\d{4})',1),'%m_%d_%Y') as date) as snapshot_date,
  regexp_extract(file_name,'_(s\d)_phy',1) as suffix, contains(file_name,'_nocollodaria') as variant from snapshots)"""


@query(
    "latest_snapshot",
    "snapshots",
    f"""with {_NAMED} select row_id, file_name, value, primer, snapshot_date, suffix, variant
        from (select *, max(snapshot_date) over (partition by primer, suffix, variant) as m from named)
        where snapshot_date=m""",
)
def latest_snapshot(t):
    return snapshots.latest(snapshots.name_parts(t.snapshots), ["primer", "suffix", "variant"])


@query(
    "snapshot_state",
    "snapshots",
    f"""with {_NAMED} select row_id, file_name, value, primer, snapshot_date, suffix, variant,
        case when snapshot_date=m then 'current' else 'past' end as snapshot_state
        from (select *, max(snapshot_date) over (partition by primer, suffix, variant) as m from named)""",
)
def snapshot_state(t):
    return snapshots.snapshot_state(snapshots.name_parts(t.snapshots), ["primer", "suffix", "variant"])


@query(
    "newest_files",
    "snapshots",
    f"""with {_NAMED} select row_id, primer, suffix, case when primer='18s' then 2 else 1 end as take,
        round(case when primer='18s' then value*2 else value end,2) as value from named""",
)
def newest_files(t):
    """Result files of two takes, the later one of one marker only; the newest take per marker and size is read."""
    root = f"{shared_folder(t.spark)}/takes-{uuid.uuid4().hex}"
    named = snapshots.name_parts(t.snapshots).select("row_id", "value", "primer", "suffix")
    later = named.where("primer = '18s'").withColumn("value", F.col("value") * 2)
    for take, rows in ((1, named), (2, later)):
        rows.hint("rebalance", "primer", "suffix").write.partitionBy("primer", "suffix").parquet(f"{root}/take={take}")
    newest = snapshots.read_newest(t.spark, root, ["primer", "suffix"], ["take"])
    return newest.select("row_id", "primer", "suffix", "take", r("value", 2).alias("value"))


@query(
    "published_snapshots",
    "snapshots",
    f"""with {_NAMED} select row_id, primer, suffix, case when primer='18s' then 2 else 1 end as take,
        round(case when primer='18s' then value*2 else value end,2) as value,
        case when primer='18s' then (select count(distinct suffix) from named where primer='18s') end as archived from named""",
)
def published_snapshots(t):
    """Two takes are published, the later one of one marker only: the live rows, and a marker's archived folders."""
    root = f"{shared_folder(t.spark)}/published-{uuid.uuid4().hex}"
    named = snapshots.name_parts(t.snapshots).select("row_id", "value", "primer", "suffix")
    later = named.where("primer = '18s'").withColumn("value", F.col("value") * 2)
    for take, rows in ((1, named), (2, later)):
        snapshots.publish(rows.withColumn("take", F.lit(take)), root, ["primer", "suffix"])
    past = snapshots.archived_files(t.spark, root).withColumn("primer", text.extract("folder", "primer=([^/]+)"))
    archived = past.groupBy("primer").agg(F.count_distinct("folder").alias("archived"))
    live = snapshots.read_live(t.spark, root).select("row_id", "primer", "suffix", "take", r("value", 2).alias("value"))
    return groups.join_on(live, archived, ["primer"])


@query(
    "sink_roundtrip",
    "snapshots",
    f"""with {_NAMED} select primer, strftime(snapshot_date,'%Y-01-01') as snapshot_date, suffix,
        count(*) as n_rows, round(sum(value),2) as total from named group by all""",
)
def sink_roundtrip(t):
    """Dated parquet snapshots and a CSV of their summary, both written and read back."""
    root = f"{shared_folder(t.spark)}/sink-{uuid.uuid4().hex}"
    named = snapshots.name_parts(t.snapshots)
    files.write_stamped(named.drop("snapshot_date"), f"{root}/dated", F.trunc(text.snapshot_date("file_name"), "year"), ["primer"])
    schema = "file_name string, value double, suffix string, snapshot_date string, primer string"
    back = t.spark.read.schema(schema).parquet(f"{root}/dated")
    sums = back.groupBy("primer", "snapshot_date", "suffix").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total")
    )
    files.write_delimited(sums, f"{root}/summary", ["primer"])
    out = files.read_delimited(
        t.spark, f"{root}/summary", "snapshot_date string, suffix string, n_rows bigint, total double, primer string"
    )
    return out.withColumn("total", r("total", 2))


# ------------------------------------------------------------------ projections and predicates


@query(
    "select_samples_by_pattern",
    "obs",
    "select * from obs where regexp_matches(sample_name,'All|A1') or sample_name like '%S1%'",
)
def select_samples_by_pattern(t):
    return reshape.select_like(t.obs, "sample_name", "All|A1|S1")


@query(
    "drop_zero_taxa",
    "hashed",
    """select size_class, sample_name, hash, n_reads from
       (select *, sum(n_reads) over (partition by size_class, hash) as s from hashed) where s<>0""",
)
def drop_zero_taxa(t):
    return reshape.drop_zero_categories(t.hashed, [SC], "hash", "n_reads").select(
        SC, "sample_name", "hash", "n_reads"
    )


@query(
    "particles_valid",
    "particles",
    """select object_id, sample_id, category, feret_px from particles
       where status='validated' and not contains(lower(hierarchy),'not-living')""",
)
def particles_valid(t):
    from biascomp.operators import particles

    return particles.valid(t.particles).select("object_id", "sample_id", "category", "feret_px")


@query(
    "apply_corrections",
    "particles",
    """select object_id, case sample_id when 'C1.T1' then 'C1.T2' when 'C1.T7' then 'C1.T70' else sample_id end
         as sample_id,
       case when sample_id='C1.T3' then 279.0::double when sample_id='C1.T4' then 278.0::double else tot_vol end
         as tot_vol from particles""",
)
def apply_corrections(t):
    volumes = F.create_map(F.lit("C1.T3"), F.lit(279.0), F.lit("C1.T4"), F.lit(278.0))
    fixed = t.particles.withColumn("tot_vol", F.coalesce(volumes[F.col("sample_id")], "tot_vol"))
    fixed = reshape.apply_corrections(fixed, "sample_id", {"C1.T1": "C1.T2", "C1.T7": "C1.T70"})
    return fixed.select("object_id", "sample_id", "tot_vol")


_POOL_KEY = """keys as (select distinct
    case when sample_name like 'C1%' then 'AllandSub' when contains(sample_name,'All') then 'All'
         when contains(sample_name,'A1') then 'A1' when contains(sample_name,'B3') then 'B3' else 'C5' end
    || '_' || size_class || '_' || case run when '1' then '18S' else 'COI' end as pool from reads)"""


def pool_keys(t):
    n = F.col("sample_name")
    kind = (
        F.when(n.startswith("C1"), "AllandSub").when(n.contains("All"), "All").when(n.contains("A1"), "A1")
        .when(n.contains("B3"), "B3").otherwise("C5")
    )
    primer = F.when(F.col("run") == "1", "18S").otherwise("COI")
    return t.reads.select(F.concat_ws("_", kind, SC, primer).alias("pool")).distinct()


@query(
    "parse_pool_key",
    "reads",
    f"""with {_POOL_KEY} select *, case size when 'S1' then 0.2::double when 'S2' then 0.5 when 'S3' then 1 end
          as size_fraction,
        case pool_type when 'All' then 1 when 'A1' then 2 when 'B3' then 3 when 'C5' then 4 when 'AllandSub' then 5 end
          as rank_pool
        from (select pool, regexp_extract(pool,'^([^_]+)',1) as pool_type,
              regexp_extract(pool,'(S1|S2|S3)',1) as size, regexp_extract(pool,'([^_]+)$',1) as primer from keys)""",
)
def parse_pool_key(t):
    return reshape.parse_pool_key(pool_keys(t))


@query(
    "fill_missing",
    "taxonomy",
    """select hash, class_rank, coalesce(order_rank,'other') as order_rank,
       coalesce(family_rank,'other') as family_rank, coalesce(genus_rank,'other') as genus_rank from taxonomy""",
)
def fill_missing(t):
    return reshape.fill_missing(t.taxonomy)


# ------------------------------------------------------------------ joins


@query(
    "join_left_meta",
    "design meta",
    """select size_class, sample_name, taxon, n_reads, pc1, zone, cycle from design
       left join meta on split_part(sample_id,'_',1)=station""",
)
def join_left_meta(t):
    d = t.design.withColumn("station", F.substring_index("sample_id", "_", 1))
    return groups.join_on(d, t.meta, ["station"], null_safe=False).select(
        SC, "sample_name", "taxon", "n_reads", "pc1", "zone", "cycle"
    )


@query(
    "join_left_multi",
    "obs",
    """with depth as (select size_class, sample_name, cast(sum(n_reads) as bigint) as depth from obs group by all),
       total as (select size_class, taxon, cast(sum(n_reads) as bigint) as taxon_total from obs group by all)
       select o.size_class, o.sample_name, o.taxon, o.n_reads, d.depth, k.taxon_total from obs o
       left join depth d on o.size_class=d.size_class and o.sample_name=d.sample_name
       left join total k on o.size_class=k.size_class and o.taxon=k.taxon""",
)
def join_left_multi(t):
    o = t.obs
    depth = composition.depth(o, [SC, "sample_name"], "n_reads")
    total = o.groupBy(SC, "taxon").agg(F.sum("n_reads").alias("taxon_total"))
    return groups.join_on(groups.join_on(o, depth, [SC, "sample_name"]), total, [SC, "taxon"])


@query(
    "merge_size_tables",
    "hashed",
    """select hash, cast(coalesce(sum(n_reads) filter (size_class='S1'),0) as bigint) as "S1",
       cast(coalesce(sum(n_reads) filter (size_class='S2'),0) as bigint) as "S2",
       cast(coalesce(sum(n_reads) filter (size_class='S3'),0) as bigint) as "S3" from hashed group by hash""",
)
def merge_size_tables(t):
    # all sizes live in one long table, so the outer merge with zero fill is one pivot over one scan
    return reshape.to_wide(t.reads, ["hash"], SC, "n_reads", SIZES)


_KEPT = """kept as (select size_class, taxon from (select *, max(share) over (partition by size_class, taxon) as ms
  from (select size_class, experiment, taxon, sum(n_reads)/sum(sum(n_reads)) over (partition by size_class, experiment)
   as share from (select *, nullif(regexp_extract(sample_name,'C_(AllPool|Pooled\\.[A-C][0-9]\\.[A-C][0-9])\\.',1),'')
     as experiment from obs) where experiment is not null group by size_class, experiment, taxon))
  where ms>=0.045 group by all)"""


def kept_taxa(t):
    from biascomp.operators import filters

    o = t.obs.withColumn("experiment", reshape.experiment_of(F.col("sample_name")))
    return filters.percent_of_experiment(o, "experiment", [SC], "taxon", "n_reads", 0.045)


@query(
    "anti_rest",
    "obs",
    f"""with {_KEPT} select o.* from obs o anti join kept k on o.size_class=k.size_class and o.taxon=k.taxon""",
)
def anti_rest(t):
    return groups.rows_without(t.obs, kept_taxa(t), [SC, "taxon"])


@query(
    "semi_in_samples",
    "design meta",
    """select size_class, sample_name, taxon, n_reads from design
       where split_part(sample_id,'_',1) in (select station from meta where zone='onshore')""",
)
def semi_in_samples(t):
    d = t.design.withColumn("station", F.substring_index("sample_id", "_", 1))
    onshore = t.meta.where(F.col("zone") == "onshore")
    return d.join(onshore, "station", "left_semi").select(SC, "sample_name", "taxon", "n_reads")


@query(
    "unidentified_counts",
    "hashed taxonomy_b",
    """select size_class, sample_name, cast(sum(n_reads) as bigint) as n_reads from hashed
       where hash not in (select hash from taxonomy_b) group by all""",
)
def unidentified_counts(t):
    return taxonomy.unknown_keys(t.hashed, t.taxonomy_b, "hash", [SC, "sample_name"], "n_reads")


@query(
    "assemble_long",
    "hashed taxonomy meta",
    """select t.hash, t.class_rank, t.order_rank, t.family_rank, t.genus_rank, h.size_class, h.sample_name, h.n_reads,
       m.pc1, m.zone from taxonomy t left join (select * from hashed where n_reads<>0) h on t.hash=h.hash
       left join meta m on split_part(h.sample_name,'_',1)=m.station""",
)
def assemble_long(t):
    h = t.hashed.withColumn("station", F.substring_index("sample_name", "_", 1))
    out = taxonomy.assemble_long(h, t.taxonomy, t.meta, "hash", "station", "n_reads")
    return out.select("hash", *RANKS, SC, "sample_name", "n_reads", "pc1", "zone")


# ------------------------------------------------------------------ aggregates


@query(
    "agg_sum",
    "obs",
    "select size_class, taxon, cast(sum(n_reads) as bigint) as n_reads from obs group by all",
)
def agg_sum(t):
    # added up per hash first: only those sums meet the brands
    sums = t.reads.groupBy(SC, "hash").agg(F.sum("n_reads").alias("n_reads"))
    return sums.join(t.brands, "hash").groupBy(SC, "taxon").agg(F.sum("n_reads").alias("n_reads"))


@query(
    "agg_interval_envelope",
    "obs",
    """select size_class, taxon, cast(sum(n_reads) as bigint) as total, min(n_reads) as low, max(n_reads) as high
       from obs group by all""",
)
def agg_interval_envelope(t):
    return t.obs.groupBy(SC, "taxon").agg(
        F.sum("n_reads").alias("total"), F.min("n_reads").alias("low"), F.max("n_reads").alias("high")
    )


@query(
    "agg_mean",
    "obs",
    "select size_class, taxon, round(avg(n_reads),6) as mean_reads from obs group by all",
)
def agg_mean(t):
    return t.obs.groupBy(SC, "taxon").agg(r(F.avg("n_reads")).alias("mean_reads"))


@query(
    "agg_median",
    "obs",
    "select size_class, taxon, round(quantile_cont(n_reads,0.5),6) as median_reads from obs group by all",
)
def agg_median(t):
    return ordered.median(t.obs, [SC, "taxon"], "n_reads", "median_reads").withColumn(
        "median_reads", r("median_reads")
    )


@query(
    "agg_all_numeric",
    "",
    """select l_returnflag, l_linestatus, round(sum(l_quantity),2) as l_quantity,
       round(sum(l_discount),2) as l_discount, round(sum(l_tax),2) as l_tax,
       cast(sum(l_linenumber) as bigint) as l_linenumber from lineitem group by all""",
)
def agg_all_numeric(t):
    df = t.read("lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_linenumber"
    )
    out = groups.sum_all_numeric(df, ["l_returnflag", "l_linestatus"])
    return out.withColumns({c: r(c, 2) for c in ["l_quantity", "l_discount", "l_tax"]})


@query("distinct_rows", "reads", "select distinct size_class, sample_name, run from reads")
def distinct_rows(t):
    return t.reads.select(SC, "sample_name", "run").distinct()


@query(
    "distinct_first",
    "reads",
    """select sample_name, size_class, hash, n_reads from (select *, row_number() over (partition by sample_name
         order by hash, n_reads, size_class, run) as rn from reads) where rn=1""",
)
def distinct_first(t):
    df = t.reads.select("sample_name", SC, "hash", "n_reads", "run")
    return groups.distinct_first(df, ["sample_name"], ["hash", "n_reads", SC, "run"]).drop("run")


@query(
    "group_flag",
    "obs",
    """select size_class, taxon, n_reads, sample_name, flag,
       case when flag and size_class='S2' then taxon when not flag and size_class='S3' then taxon else ' ' end as x_label
       from (select *, coalesce(bool_or(size_class='S2' and n_reads>150) over (partition by taxon),false) as flag
             from obs)""",
)
def group_flag(t):
    cond = (F.col(SC) == "S2") & (F.col("n_reads") > 150)
    out = groups.group_flag(t.obs, ["taxon"], cond, "flag")
    label = F.when(F.col("flag") & (F.col(SC) == "S2"), F.col("taxon")).when(
        ~F.col("flag") & (F.col(SC) == "S3"), F.col("taxon")
    )
    return out.withColumn("x_label", label.otherwise(F.lit(" ")))


@query(
    "check_closure",
    "particles",
    """select sample_id, round(sum(share),6)+0.0 as total from (select sample_id, category,
         case when category='Calanoida' then 0.9 else 1 end * count(*) / sum(count(*)) over (partition by sample_id)
           as share
         from particles group by sample_id, category) group by sample_id having abs(sum(share)-1)>1e-6""",
)
def check_closure(t):
    counts = t.particles.groupBy("sample_id", "category").agg(F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("category") == "Calanoida", 0.9).otherwise(1.0)
    shares = groups.share(counts, ["sample_id"], "n").withColumn("share", F.col("share") * weight)
    return groups.closure_errors(shares, ["sample_id"], "share").withColumn("total", r("total"))


# ------------------------------------------------------------------ set operations and reshaping


@query(
    "union_runs",
    "reads",
    """select size_class, sample_name, hash, n_reads, null::varchar as run from reads where run='1'
       union all select size_class, sample_name, hash, n_reads, run from reads where run='2'""",
)
def union_runs(t):
    one, two = t.reads.where("run = '1'").drop("run"), t.reads.where("run = '2'")
    return reshape.union_all([one, two])


@query(
    "pivot_longer",
    "",
    """select p_partkey, 'p_size' as metric, cast(p_size as double) as metric_value from part where p_size<>0
       union all select p_partkey, 'p_retailprice', p_retailprice from part where p_retailprice<>0""",
)
def pivot_longer(t):
    wide = t.read("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return reshape.to_long(wide, ["p_partkey"], "metric", "metric_value", drop_zero=True)


@query(
    "array_long",
    "",
    """select vec_id, cast(idx as integer) as idx, round(cast(embedding[idx] as double),6)+0.0 as val
       from (select vec_id, embedding, unnest(range(1, len(embedding)+1)) as idx from embeddings)""",
)
def array_long(t):
    long = reshape.gather_array(t.read("embeddings"), ["vec_id"], "embedding")
    return long.withColumn("val", r("val"))


@query(
    "pivot_wider",
    "obs",
    """select sample_name, taxon, cast(coalesce(sum(n_reads) filter (size_class='S1'),0) as bigint) as "S1",
       cast(coalesce(sum(n_reads) filter (size_class='S2'),0) as bigint) as "S2",
       cast(coalesce(sum(n_reads) filter (size_class='S3'),0) as bigint) as "S3" from obs group by all""",
)
def pivot_wider(t):
    return reshape.to_wide(t.obs, ["sample_name", "taxon"], SC, "n_reads", SIZES)


@query(
    "as_map",
    "",
    """with c as (select r_name, n_name, n_nationkey, count(*) as k from supplier
         join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by all)
       select r_name as region, array_to_string(list_sort(list(n_name || '=' || cast(k as varchar))),';') as lookup
       from c group by r_name""",
)
def as_map(t):
    s, n, reg = t.read("supplier"), t.read("nation"), t.read("region")
    counts = (
        s.join(n, s.s_nationkey == n.n_nationkey).join(reg, n.n_regionkey == reg.r_regionkey)
        .groupBy(F.col("r_name").alias("region"), "n_name").agg(F.count(F.lit(1)).alias("k"))
    )
    mapped = groups.as_map(counts, ["region"], "n_name", "k")
    pairs = F.transform(F.map_entries("lookup"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return mapped.select("region", F.array_join(F.array_sort(pairs), ";").alias("lookup"))


@query(
    "design_matrix",
    "design",
    """select sample_name, max(cycle_num) as cycle_num, max(cast(sample_num='Calibration' as integer)) as "Calibration",
       max(cast(sample_num='C1.T1_S1' as integer)) as "C1.T1_S1", max(cast(sample_num='C1.T2_S2' as integer)) as "C1.T2_S2"
       from design group by sample_name""",
)
def design_matrix(t):
    return reshape.design_matrix(
        t.design, "sample_name", "sample_num", ["Calibration", "C1.T1_S1", "C1.T2_S2"], "cycle_num"
    )


@query(
    "calibration_grid",
    "reads",
    """select t.treatment, e.experiment, p.replicate, t.treatment||'_'||e.experiment||'.'||p.replicate as sample_name
       from (select unnest(['20C','24C','28C']) as treatment) t,
       (select unnest(['AllPool','Pooled.A1.A3','Pooled.B3.B5','Pooled.C5.C7']) as experiment) e,
       (select unnest(['1','2','3']) as replicate) p
       where t.treatment||'_'||e.experiment||'.'||p.replicate in (select sample_name from reads)""",
)
def calibration_grid(t):
    return reshape.calibration_grid(t.reads)


# ------------------------------------------------------------------ sample operators


@query(
    "collapse_replicates",
    "obs",
    r"""select size_class, sample_id, taxon, cast(sum(n_reads) as bigint) as n_reads from
        (select *, regexp_extract(sample_name,'^(.*)\.[^.]+$',1) as sample_id from obs)
        where not contains(sample_id,'All') group by all""",
)
def collapse_replicates(t):
    return reshape.collapse_replicates(t.obs, [SC], "sample_name", "taxon", "n_reads")


@query(
    "sample_design",
    "design",
    "select distinct size_class, sample_name, cycle_num, pool, sample_id, sample_num from design",
)
def sample_design(t):
    names = t.reads.select(SC, "sample_name").distinct()
    return reshape.sample_design(names, "sample_name")


@query(
    "subset_pool",
    "obs",
    """select * from obs where contains(sample_name,'A1') or contains(sample_name,'A3') or contains(sample_name,'_S2')""",
)
def subset_pool(t):
    return reshape.pool_subset(t.obs, "sample_name", ["A1", "A3"], "_S2")


@query(
    "assign_run",
    "reads",
    r"""select distinct sample_name, case when contains(sample_name,'Pool') then '2'
        when regexp_matches(sample_name,'\.1|\.2') then '1' when regexp_matches(sample_name,'\.3') then '2'
        when regexp_matches(sample_name,'\.4') then '2' end as run from reads""",
)
def assign_run(t):
    names = t.reads.select("sample_name").distinct()
    return reshape.assign_run(names, "sample_name", reshape.RUN_RULES)


# ------------------------------------------------------------------ scalar functions


@query(
    "string_parsers",
    "snapshots",
    r"""select row_id, regexp_extract(file_name,'^(.*)\.[^.]+$',1) as stem, regexp_extract(file_name,'([^_]+)$',1) as tail,
        regexp_extract(file_name,'^([^_-]+)',1) as head, lower(replace(file_name,'_','-')) as dashed,
        regexp_replace(file_name,'^predicted_','') as no_prefix,
        cast(strptime(regexp_extract(file_name,'(\d{2}_\d{2}_\d{4})',1),'%m_%d_%Y') as date) as day,
        regexp_extract('predicted '||file_name,'predicted (\S+)',1) as predicted_name,
        regexp_replace(file_name||' ASV 12','\sASV\s\d+$','') as plain, printf('h%02d', row_id % 100) as code,
        coalesce(try_cast(substring(file_name,1,2) as integer),30) as lead_num
        from snapshots""",
)
def string_parsers(t):
    n = F.col("file_name")
    return t.snapshots.select(
        "row_id",
        text.drop_last_token(n).alias("stem"),
        text.last_token(n).alias("tail"),
        text.leading_token(n).alias("head"),
        text.normal_id(F.replace(n, F.lit("_"), F.lit("-"))).alias("dashed_raw"),
        text.strip_prefix(n, "predicted_").alias("no_prefix"),
        text.snapshot_date(n).alias("day"),
        text.predicted_id(F.concat(F.lit("predicted "), n)).alias("predicted_name"),
        text.strip_variant(F.concat(n, F.lit(" ASV 12"))).alias("plain"),
        F.format_string("h%02d", F.col("row_id") % 100).alias("code"),
        text.leading_number(n, 2, 30).alias("lead_num"),
    ).withColumn("dashed", F.replace("dashed_raw", F.lit("_"), F.lit("-"))).drop("dashed_raw")


@query(
    "math_transforms",
    "",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(log10(l_extendedprice),6) as lg10,
       round(asin(sqrt(l_discount)),6) as asin_sqrt_share, round(log2(l_extendedprice/nullif(l_tax,0)),6) as log2_q,
       round_even(l_quantity/4,0) as half_even, round(exp(l_tax),6) as exp_tax, floor(l_extendedprice) as low_price,
       ceil(l_extendedprice) as high_price, abs(l_discount-l_tax) >0.05 as wide_gap, least(l_quantity*5,100) as capped
       from lineitem""",
)
def math_transforms(t):
    li = t.read("lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.log10("l_extendedprice").alias("lg10"),
        num.asin_sqrt("l_discount").alias("asin_sqrt_share"),
        num.log2_ratio("l_extendedprice", "l_tax").alias("log2_q"),
        num.round_half_even(F.col("l_quantity") / 4).alias("half_even"),
        F.exp("l_tax").alias("exp_tax"),
        F.floor("l_extendedprice").cast("double").alias("low_price"),
        F.ceil("l_extendedprice").cast("double").alias("high_price"),
        (F.abs(F.col("l_discount") - F.col("l_tax")) > 0.05).alias("wide_gap"),
        F.least(F.col("l_quantity") * 5, F.lit(100.0)).alias("capped"),
    ).withColumns({c: num.round_half_up(c, DIGITS) + F.lit(0.0) for c in ("lg10", "asin_sqrt_share", "log2_q", "exp_tax")})
