"""Files written and read back, lookups by chosen rows, imaging checks and report tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from biascomp.operators import compare, composition, groups, ordered, particles, reshape, stats, taxonomy
from biascomp.plans.analysis import sql_t_p
from biascomp.plans.bindings import RANKS
from biascomp.plans.comparison import X_METRICS, Y_METRICS, benchmark, grid_sql
from biascomp.plans.imaging import SQL_GEO, measured, with_carbon
from biascomp.plans.registry import query, r
from biascomp.plans.tables import SC
from biascomp.session import shared_folder
from biascomp.sources import files

# ------------------------------------------------------------------ files


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query(
    "scan_csv_matrix",
    "hashed",
    """select hash, size_class as sample_name, cast(sum(n_reads) as bigint) as n_reads from hashed group by all
       having sum(n_reads)<>0""",
)
def scan_csv_matrix(t):
    """A wide gzip CSV matrix, hashes by size classes, read back as long counts."""
    path = _folder(t)
    wide = reshape.to_wide(t.hashed, ["hash"], SC, "n_reads", ["S1", "S2", "S3"])
    files.write_delimited(wide, path, compression="gzip")
    schema = "hash bigint, S1 bigint, S2 bigint, S3 bigint"
    return files.read_count_matrix(t.spark, path, "hash", schema=schema)


@query(
    "scan_tsv_latin1",
    "taxonomy",
    """select hash, class_rank || ' é' as class_rank, case when family_rank is null then null else 'ü ' || family_rank end
       as family_rank from taxonomy""",
)
def scan_tsv_latin1(t):
    """A Latin-1 TSV with accents and missing values, written and read back."""
    path = _folder(t)
    out = t.taxonomy.select(
        "hash", F.concat("class_rank", F.lit(" é")).alias("class_rank"), F.concat(F.lit("ü "), "family_rank").alias("family_rank")
    )
    files.write_delimited(out, path, sep="\t", encoding="ISO-8859-1")
    return files.read_tsv_latin1(t.spark, path, out.schema)


@query(
    "category_subset_sink",
    "particles",
    """select object_id, sample_id, round(feret_px,6) as feret_px from particles where category='Calanoida'""",
)
def category_subset_sink(t):
    """The objects of one category, saved and read back from their own folder."""
    path = _folder(t)
    cols = t.particles.select("category", "object_id", "sample_id", "feret_px")
    files.write_delimited(cols, path, ["category"])
    schema = "object_id bigint, sample_id string, feret_px double, category string"
    back = files.read_delimited(t.spark, path, schema).where(F.col("category") == "Calanoida")
    return back.select("object_id", "sample_id", r("feret_px").alias("feret_px"))


# ------------------------------------------------------------------ lookups, keys and checks


@query(
    "rows_at_max",
    "hashed",
    """select size_class, sample_name, hash, n_reads from
       (select *, max(n_reads) over (partition by size_class, sample_name) as m from hashed) where n_reads=m""",
)
def rows_at_max(t):
    return groups.rows_at_max(t.hashed, [SC, "sample_name"], "n_reads")


@query(
    "chosen_row_value",
    "obs",
    """select size_class, sample_name, taxon, n_reads, max(case when taxon='Brand#3' then n_reads end)
       over (partition by size_class, sample_name) as reference_reads from obs""",
)
def chosen_row_value(t):
    return groups.chosen_row_value(t.obs, [SC, "sample_name"], F.col("taxon") == "Brand#3", "n_reads", "reference_reads")


@query(
    "group_key_order",
    "meta",
    """select zone, cycle, printf('h%02d', row_number() over (order by zone, cycle)) as group_key, n_stations
       from (select zone, cycle, count(*) as n_stations from meta group by zone, cycle)""",
)
def group_key_order(t):
    pairs = t.meta.groupBy("zone", "cycle").agg(F.count(F.lit(1)).alias("n_stations"))
    numbered = ordered.row_number(pairs, [], ["zone", "cycle"], "__i")
    return numbered.withColumn("group_key", F.format_string("h%02d", "__i")).drop("__i")


@query(
    "first_values",
    "design",
    "select sample_num from design group by sample_num order by min(sample_name), sample_num limit 3",
)
def first_values(t):
    return ordered.first_values(t.design, "sample_num", ["sample_name"], 3)


@query(
    "conservation",
    "hashed taxonomy",
    """with a as (select size_class, cast(sum(n_reads) as bigint) as before from hashed group by all),
       b as (select size_class, cast(sum(n_reads) as bigint) as after from hashed h join taxonomy t on h.hash=t.hash
         where trim(coalesce(order_rank,''))<>'' group by all)
       select size_class, before, coalesce(after,0) as after, before-coalesce(after,0) as lost from a left join b using (size_class)""",
)
def conservation(t):
    """Reads per size class before and after the hashes without an order leave."""
    ranked = t.taxonomy.where(~taxonomy.blank(F.col("order_rank")))
    return groups.conservation(t.hashed, t.hashed.join(ranked, "hash", "left_semi"), [SC], "n_reads")


@query(
    "dedupe_best_first",
    "taxonomy taxonomy_b",
    """with u as (select * from taxonomy union all select * from taxonomy_b),
       s as (select *, (class_rank is not null)::int+(order_rank is not null)::int+(family_rank is not null)::int
             +(genus_rank is not null)::int as score from u),
       m as (select *, row_number() over (partition by hash order by score desc, class_rank nulls first,
             order_rank nulls first, family_rank nulls first, genus_rank nulls first) as i from s)
       select hash, class_rank, order_rank, family_rank, genus_rank from m where i=1""",
)
def dedupe_best_first(t):
    return taxonomy.dedupe_best(reshape.union_all([t.taxonomy, t.taxonomy_b]), "hash", RANKS, ties="first")


@query(
    "share_sums",
    "obs",
    """select size_class, taxon, round(sum(share),6) as share_sum from (select *, n_reads/sum(n_reads)
         over (partition by size_class, sample_name) as share from obs) group by all""",
)
def share_sums(t):
    out = composition.mean_share(t.obs, [SC], "sample_name", "taxon", "n_reads", "sum", "share_sum")
    return out.withColumn("share_sum", r("share_sum"))


@query(
    "design_matrix_long",
    "design",
    """with o as (select distinct size_class, sample_name, sample_num, cycle_num from design)
       select size_class, sample_name, sample_num as design_column, 1.0::double as design_value from o
       union all select size_class, sample_name, 'cycle_num', cast(cycle_num as double) from o""",
)
def design_matrix_long(t):
    return reshape.design_long(t.design, [SC, "sample_name"], "sample_num", "cycle_num")


# ------------------------------------------------------------------ imaging


_PIXEL = "(case when sub_part%2=0 then 0.0106::double else 0.0053 end)"


@query(
    "particle_geometry_pixel",
    "particles",
    f"""select object_id, round(feret_px*{_PIXEL},6) as feret_mm, round(area_px*pow({_PIXEL},2),6) as area_mm2,
        round(2*sqrt(area_px*pow({_PIXEL},2)/pi()),6) as esd_mm from particles
        where status='validated' and not contains(lower(hierarchy),'not-living')""",
)
def particle_geometry_pixel(t):
    """Geometry with each object's own pixel size."""
    scanned = particles.valid(t.particles).withColumn("pixel_mm", F.when(F.col("sub_part") % 2 == 0, 0.0106).otherwise(0.0053))
    return particles.geometry(scanned, "pixel_mm").select("object_id", *[r(c).alias(c) for c in ("feret_mm", "area_mm2", "esd_mm")])


_CATEGORIES = sorted(particles.FERET_RELATIONS) + ["Unknown"]
_COPEPOD = "case when e/1.2::double>{0} then 10**(-6.76::double+2.512*log10((e/1.2::double-{0})*1000)) end"
# fixed values: the conversions in plain form, l feret length and e equivalent diameter in mm
_FERET_SQL = {
    "Copepoda<Maxillopoda": _COPEPOD.format("0.031"), "Harpacticoida": _COPEPOD.format("0.031"),
    "Poecilostomatoida": _COPEPOD.format("0.031"), "Eucalanidae": _COPEPOD.format("0.031"),
    "Calanoida": _COPEPOD.format("0.038"), "Oithonidae": "10**(-6.76::double+2.512*log10(640*l))",
    "Euphausiacea": "10**(-0.473::double+3.174*log10(1.04*l))", "Eumalacostraca": "10**(-0.473::double+3.174*log10(1.04*l))",
    "Hydrozoa": "20.47::double*l**0.834", "Polychaeta": "7.58::double*l**1.3848",
    "Ostracoda": "17.072::double*l**2.545*0.398", "tetrazoid": "111::double*l**1.9*0.113",
    "Salpida": "1.49::double*(1.001*l)**2", "Hyperiidea": "10**(2.314::double+2.957*log10(l))*365",
    "Pteropoda": "10**(1.469::double+3.102*log10(l))", "Doliolida": "0.51::double*(0.963*l)**2.28",
    "Chaetognatha": "0.0956::double*l**2.9093", "Oikopleuridae": "0.49::double*(38.8*(0.262*l)**2.574)**1.12",
}
_ESD_SQL = {
    **{c: _COPEPOD.format("0.031") for c in ("Calanoida", "Oithonidae", "Harpacticoida", "Poecilostomatoida", "Eucalanidae")},
    "Copepoda<Maxillopoda": "10**(-6.76::double+2.512*log10(670*e))",
    "Eumalacostraca": "case when e/1.7::double>0.064 then 133::double*(e/1.7-0.064)**2.44 end",
    "Hyperiidea": "case when e/1.5::double>0.17 then 10**(2.314::double+2.957*log10(e/1.5-0.17))*365 end",
    "Chaetognatha": "case when e/4.2::double>0.25 then 0.0956::double*(e/4.2-0.25)**2.9093 end",
    **{
        c: re.sub(r"\bl\b", "e", _FERET_SQL[c])
        for c in ("Euphausiacea", "Hydrozoa", "Polychaeta", "Ostracoda", "tetrazoid", "Salpida", "Pteropoda", "Doliolida")
    },
}
_MODE_SQL = {"feret": _FERET_SQL, "esd": _ESD_SQL, "default": {**_FERET_SQL, "Eumalacostraca": "133::double*l**2.44"}}


def _case(formulas: dict[str, str]) -> str:
    return "case category " + " ".join(f"when '{c}' then {f}" for c, f in formulas.items()) + " end"


@query(
    "length_to_carbon_all",
    "particles",
    f"""with c as (select object_id, list_extract({_CATEGORIES!r}, cast(object_id%{len(_CATEGORIES)} as integer)+1) as category,
          feret_px*0.0106::double as l, 2*sqrt(area_px*pow(0.0106::double,2)/pi()) as e from particles
          where status='validated' and not contains(lower(hierarchy),'not-living') and feret_px>0)
        select object_id, category, {", ".join(f"round(log10({_case(f)}),6)+0.0 as log10_{m}" for m, f in _MODE_SQL.items())} from c""",
)
def length_to_carbon_all(t):
    """Every category of the conversion table and one outside it, in all three modes."""
    names = F.array(*[F.lit(c) for c in _CATEGORIES])
    named = particles.valid(t.particles).where(F.col("feret_px") > 0).withColumn(
        "category", F.get(names, (F.col("object_id") % len(_CATEGORIES)).cast("int"))
    )
    out = particles.geometry(named)
    for mode in _MODE_SQL:
        out = particles.length_to_carbon(out, mode, out=mode)
    return out.select("object_id", "category", *[r(F.log10(m)).alias(f"log10_{m}") for m in _MODE_SQL])


@query(
    "biomass_areal_column",
    "weights volumes depths",
    """select weight_id, w.station_key, round(case when biomass_dry>=0 then biomass_dry*8/3 end/nullif(volume_m3,0)
       *coalesce(depth_m,210.0),6) as biomass_mg_m2
       from weights w left join volumes v on w.station_key=v.station_key left join depths d on w.station_key=d.station_key""",
)
def biomass_areal_column(t):
    out = particles.biomass_areal(t.weights, t.volumes, t.depths, "station_key", depth="column")
    return out.select("weight_id", "station_key", r("biomass_mg_m2").alias("biomass_mg_m2"))


@query(
    "diversity_meta",
    "particles meta",
    """with c as (select sample_id, category, count(*) as n from particles group by all),
       s as (select sample_id, -sum(n/t*ln(n/t)) as shannon from (select *, sum(n) over (partition by sample_id) as t from c)
         group by sample_id)
       select distinct sample_id, round(shannon,6)+0.0 as shannon, pc1, zone, cycle from s left join meta on sample_id=station""",
)
def diversity_meta(t):
    per_sample = stats.shannon(t.particles, ["sample_id"], "category").withColumn("shannon", r("shannon"))
    return groups.join_on(per_sample, t.meta.withColumnRenamed("station", "sample_id"), ["sample_id"], null_safe=False).distinct()


@query(
    "volume_biomass_check",
    "particles",
    f"""with {SQL_GEO}, s as (select sample_id, size_fraction, sum(carbon_ug) as c, avg(tot_vol) as volume from carbon group by all),
        k as (select size_fraction,
          rank() over (partition by size_fraction order by round(log10(c),9))
            + (count(*) over (partition by size_fraction, round(log10(c),9))-1)/2.0::double as a,
          rank() over (partition by size_fraction order by round(volume,9))
            + (count(*) over (partition by size_fraction, round(volume,9))-1)/2.0::double as b from s where c>0),
        rc as (select size_fraction, corr(a,b) as r, count(*) as n, cast(count(*)-2 as double) as df from k group by size_fraction)
        select size_fraction, n, round(r,6)+0.0 as r, round({sql_t_p('r*sqrt(df/(1-r*r))', 'df')},6) as p from rc""",
)
def volume_biomass_check(t):
    """Rank correlation of log biomass and sampled volume per size class; stops below three samples."""
    sums = with_carbon(t).groupBy("sample_id", "size_fraction").agg(
        F.round(F.log10(F.sum("carbon_ug")), 9).alias("log_biomass"), F.round(F.avg("tot_vol"), 9).alias("volume")
    )
    finite = stats.require_pairs(sums.where(F.col("log_biomass").isNotNull()))
    out = stats.cor_test(finite, ["size_fraction"], "log_biomass", "volume", "spearman")
    return out.select("size_fraction", "n", r("r").alias("r"), r("p").alias("p"))


# ------------------------------------------------------------------ comparison


_SIZE_FRACTIONS = {"S1": "0.2-0.5", "S2": "0.5-1", "S3": "1-2"}


@query(
    "join_axis_score",
    "shares particles",
    f"""with {SQL_GEO},
        b as (select cast(round(pc1*1000000) as bigint) as pc1_key, size_fraction, count(*) as n_objects
          from geo join meta on sample_id=station where size_fraction<>'>2' group by all),
        m as (select cast(round(pc1*1000000) as bigint) as pc1_key, case size_class when 'S1' then '0.2-0.5'
          when 'S2' then '0.5-1' else '1-2' end as size_fraction, cast(sum(n_reads) as bigint) as n_reads from shares
          where pc1 is not null group by all)
        select b.pc1_key, b.size_fraction, n_objects, n_reads from b left join m on b.pc1_key=m.pc1_key
          and b.size_fraction=m.size_fraction""",
)
def join_axis_score(t):
    """Objects beside reads of the same axis score and size class."""
    keys = ["pc1_key", "size_fraction"]
    objects = measured(t).join(t.meta.withColumnRenamed("station", "sample_id"), "sample_id")
    objects = compare.by_axis_score(objects, "pc1").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_objects"))
    sizes = F.create_map(*[F.lit(v) for kv in _SIZE_FRACTIONS.items() for v in kv])
    reads = compare.by_axis_score(t.shares.where(F.col("pc1").isNotNull()), "pc1").withColumn("size_fraction", sizes[F.col(SC)])
    return compare.join_benchmark(objects, reads.groupBy(*keys).agg(F.sum("n_reads").alias("n_reads")), keys)


_HEADINGS = {"size_fraction": "size", "y_variable": "method", "x_variable": "benchmark_metric", "p_bonferroni": "p_bonf"}


@query(
    "publication_table",
    "design particles",
    f"""select size_fraction as size, y_variable as method, x_variable as benchmark_metric, r, p, p_bonferroni as p_bonf, p_bh
        from ({grid_sql()})""",
)
def publication_table(t):
    grid = compare.cor_grid(benchmark(t), "size_fraction", X_METRICS, Y_METRICS, bounded=True)
    out = compare.publication_table(grid, "size_fraction", _HEADINGS)
    return out.withColumns({c: r(c) for c in ("r", "p", "p_bonf", "p_bh")})
