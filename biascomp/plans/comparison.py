"""Method comparison against the particle benchmark, and area tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from biascomp.operators import compare, composition, groups, reshape, taxonomy
from biascomp.plans.imaging import SQL_BIOMASS, biomass_table
from biascomp.plans.model import FIT, RAW, raw_and_corrected
from biascomp.plans.registry import query, r
from biascomp.plans.tables import SC

#: Benchmark taxon, and the sequence categories that belong to it.
TAXON = "Calanoida"
MEMBERS = ["Brand#3", "Brand#5", "Brand#7"]
_MEMBERS_SQL = "('Brand#3','Brand#5','Brand#7')"
X_METRICS = ["biomass_share", "carbon_mg_m2", "relative_abundance", "abundance_m2"]
Y_METRICS = ["raw", "corrected"]
KEYS = ["sample_id", "size_code"]
_SIZE_CODES = {"S1": 0.2, "S2": 0.5, "S3": 1.0}

_JOINED = f"""{FIT}, {RAW}, {SQL_BIOMASS},
 mem as (select split_part(sample,'_',1) as sample_id, case size_class when 'S1' then 0.2::double when 'S2' then 0.5
   else 1 end as size_code, coalesce(sum(raw),0) as raw, sum(corrected) as corrected from rc where taxon in {_MEMBERS_SQL}
   group by sample, size_class),
 bench as (select distinct b.sample_id, b.size_fraction, b.size_code, b.biomass_share, b.carbon_mg_m2, b.relative_abundance,
   b.abundance_m2, raw, corrected from bio b left join mem m on b.sample_id=m.sample_id and b.size_code=m.size_code
   where category='{TAXON}' and size_fraction<>'>2')"""


def members(t):
    """Summed raw and corrected share of the benchmark taxon's categories per station and size."""
    both = raw_and_corrected(t).withColumn("sample_id", F.substring_index("sample", "_", 1))
    codes = F.create_map(*[F.lit(v) for kv in _SIZE_CODES.items() for v in kv])
    both = both.withColumns({"size_code": codes[F.col(SC)], "raw": F.coalesce("raw", F.lit(0.0))})
    return compare.metric_sums(both, KEYS, Y_METRICS, F.col("taxon").isin(MEMBERS))


def benchmark(t):
    bio = biomass_table(t).where(F.col("category") == TAXON)
    return compare.join_benchmark(bio.select(*KEYS, "size_fraction", *X_METRICS), members(t), KEYS)


def rounded(df, cols):
    return df.withColumns({c: r(c) for c in cols})


@query(
    "join_benchmark",
    "design particles",
    f"""with {_JOINED} select sample_id, size_fraction, size_code, round(biomass_share,6) as biomass_share,
        round(carbon_mg_m2,6) as carbon_mg_m2, round(relative_abundance,6) as relative_abundance,
        round(abundance_m2,6) as abundance_m2, round(raw,6) as raw, round(corrected,6) as corrected from bench""",
)
def join_benchmark(t):
    return rounded(benchmark(t), [*X_METRICS, *Y_METRICS])


def grid_sql() -> str:
    from biascomp.plans.analysis import sql_t_p

    stacks = " union all ".join(
        f"select size_fraction, '{y}' as y_variable, '{x}' as x_variable, {x} as x_value, {y} as y_value from bench"
        for x in X_METRICS for y in Y_METRICS
    )
    return f"""with {_JOINED}, l as ({stacks}),
      c as (select size_fraction, y_variable, x_variable, corr(log10(x_value), asin(sqrt(y_value))) as r, count(*) as n,
        cast(count(*)-2 as double) as df from l where x_value>0 and y_value>=0 group by 1,2,3),
      p as (select *, {sql_t_p('r*sqrt(df/(1-r*r))', 'df')} as p from c),
      k as (select *, row_number() over (order by p, size_fraction, y_variable, x_variable) as i, count(*) over () as m from p),
      q as (select *, least(p*m,1) as p_bonferroni, least(min(p*m/i) over (order by i rows between current row and
        unbounded following),1) as p_bh from k)
      select size_fraction, y_variable, x_variable, round(r,6)+0.0 as r, n, round(p,6) as p,
        round(p_bonferroni,6) as p_bonferroni, round(p_bh,6) as p_bh,
        printf('r = %.2f', r) || chr(10) || 'P (BH) = ' || case when p_bh<0.001 then '<0.001' else printf('%.2f', p_bh) end
          as label from q"""


@query("cor_grid", "design particles", grid_sql())
def cor_grid(t):
    grid = compare.cor_grid(benchmark(t), "size_fraction", X_METRICS, Y_METRICS, bounded=True)
    return rounded(grid, ["r", "p", "p_bonferroni", "p_bh"]).drop("t", "df")


@query(
    "closeness_flags",
    "design particles",
    f"""with {_JOINED}, l as (
          select sample_id, size_fraction, raw, corrected, 'biomass_share' as method, biomass_share as v from bench
          union all select sample_id, size_fraction, raw, corrected, 'raw', raw from bench
          union all select sample_id, size_fraction, raw, corrected, 'corrected', corrected from bench),
        d as (select *, abs(corrected-v) as a, abs(raw-v) as b from l)
        select sample_id, size_fraction, method, round(v,6) as metric_value, round(a,6) as diff_corrected,
          round(b,6) as diff_raw,
          case when method='biomass_share' and a<b then '*' when method='biomass_share' and a>b then 'x' end as is_closer,
          case when method='biomass_share' and a<0.05*v then '**' end as closest,
          case when method='biomass_share' and b<0.05*v then 'xx' end as worse from d""",
)
def closeness_flags(t):
    wide = benchmark(t).select("sample_id", "size_fraction", "biomass_share", *Y_METRICS)
    out = compare.closeness(wide, ["sample_id", "size_fraction"], "biomass_share", "raw", "corrected")
    return rounded(out, ["metric_value", "diff_corrected", "diff_raw"])


@query(
    "mse_compare",
    "design particles",
    f"""with {_JOINED}, e as (select *, pow(biomass_share-corrected,2) as sc, pow(biomass_share-raw,2) as sr from bench)
        select size_fraction, round(quantile_cont(sc,0.5),6) as median_se_corrected, round(quantile_cont(sr,0.5),6)
          as median_se_raw, count(*) filter (sr-sc>=0) as n_corrected_better from e group by size_fraction""",
)
def mse_compare(t):
    from biascomp.session import checkpoint

    errors = checkpoint(compare.squared_errors(benchmark(t), "biomass_share", "raw", "corrected"))
    better = errors.groupBy("size_fraction").agg(
        F.count(F.when(F.col("difference") >= 0, F.lit(1))).alias("n_corrected_better")
    )
    out = groups.join_on(compare.median_errors(errors, ["size_fraction"]), better, ["size_fraction"])
    return rounded(out, ["median_se_corrected", "median_se_raw"])


_RUN_SHARE = """rs as (select *, split_part(sample_name,'_',1) as sample_id, n_reads/sum(n_reads)
   over (partition by size_class, sample_name, run) as share from obs_run where sample_name like 'C1%'),
 m1 as (select sample_id, case size_class when 'S1' then 0.2::double when 'S2' then 0.5 else 1 end as size_code,
   avg(s) as share, run from (select sample_id, size_class, sample_name, run, sum(share) filter (taxon in {0}) as s from rs
   group by all) group by all)"""


@query(
    "three_way_long",
    "obs_run particles",
    f"""with {SQL_BIOMASS}, {_RUN_SHARE.format(_MEMBERS_SQL)},
        b as (select sample_id, size_code, biomass_share from bio where category='{TAXON}'),
        j as (select a.sample_id, a.size_code, a.share as raw_18s, c.share as raw_coi, b.biomass_share
          from (select * from m1 where run='1') a left join (select * from m1 where run='2') c
            on a.sample_id=c.sample_id and a.size_code=c.size_code
          left join b on a.sample_id=b.sample_id and a.size_code=b.size_code)
        select sample_id, size_code, 'raw_18s' as method, round(raw_18s,6) as proportion from j
        union all select sample_id, size_code, 'raw_coi', round(raw_coi,6) from j
        union all select sample_id, size_code, 'biomass_share', round(biomass_share,6) from j""",
)
def three_way_long(t):
    shares = composition.closure(t.obs_run, [SC, "sample_name", "run"], "n_reads")
    station = F.substring_index("sample_name", "_", 1)
    codes = F.create_map(*[F.lit(v) for kv in _SIZE_CODES.items() for v in kv])
    member = F.when(F.col("taxon").isin(MEMBERS), F.col("share"))
    sums = shares.groupBy(SC, "sample_name", "run").agg(F.sum(member).alias("share"))
    sums = sums.where(F.col("sample_name").startswith("C1")).select(
        station.alias("sample_id"), codes[F.col(SC)].alias("size_code"), "run", "share"
    )
    # both markers in one pass: a conditional mean per run instead of a self-join
    of_run = lambda run: F.avg(F.when(F.col("run") == run, F.col("share")))
    markers = sums.groupBy(*KEYS).agg(
        of_run("1").alias("raw_18s"), of_run("2").alias("raw_coi"), F.bool_or(F.col("run") == "1").alias("has_18s")
    )
    bench = biomass_table(t).where(F.col("category") == TAXON).select(*KEYS, "biomass_share")
    out = compare.three_way_long(
        markers.where("has_18s").drop("has_18s"), bench, KEYS, ["raw_18s", "raw_coi", "biomass_share"]
    )
    return rounded(out, ["proportion"])


@query(
    "hotspots",
    "hashed taxonomy meta",
    """with c as (select cycle, h.size_class, m.station, t.order_rank, cast(sum(n_reads) as bigint) as category_reads
         from hashed h join taxonomy t on h.hash=t.hash join meta m on split_part(h.sample_name,'_',1)=m.station
         where t.class_rank='PROMO' group by all),
       s as (select *, cast(sum(category_reads) over (partition by station, size_class) as bigint) as site_reads from c)
       select cycle, size_class, station, order_rank, category_reads, site_reads,
         round(category_reads/site_reads,6) as percent, site_reads=max(site_reads) over () as is_hotspot from s""",
)
def hotspots(t):
    h = t.hashed.withColumn("station", F.substring_index("sample_name", "_", 1))
    h = h.join(t.taxonomy, "hash").join(t.meta, "station")
    out = compare.hotspots(
        h, F.col("class_rank") == "PROMO", ["cycle", "order_rank"], ["station", SC], "n_reads"
    )
    return rounded(out, ["percent"])


@query(
    "hierarchy_area",
    "hashed taxonomy",
    """select order_rank, family_rank, cast(sum(n_reads) as bigint) as n_reads from hashed h join taxonomy t on h.hash=t.hash
       where order_rank is not null and family_rank is not null and (order_rank<>'NA' or family_rank<>'NA')
       group by all""",
)
def hierarchy_area(t):
    return compare.hierarchy_area(t.reads.join(t.taxonomy, "hash"), "order_rank", "family_rank", "n_reads")


@query(
    "axis_lookup",
    "meta",
    "select distinct station, pc1 from meta",
)
def axis_lookup(t):
    return compare.axis_labels(t.meta, "station", "pc1")
