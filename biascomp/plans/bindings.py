"""Roles of the driver tables: reads, taxonomy, sample metadata, particles, weights, snapshots.

Each role exists twice, as DataFrame calls and as SQL, and both must say the same.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biascomp.operators.groups import join_on, share
from biascomp.operators.reshape import collapse_replicates, sample_design

RANKS = ["class_rank", "order_rank", "family_rank", "genus_rank"]
CALIBRATION_YEAR = 1995


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def reads(self) -> DataFrame:
        """One row per line item: size class, sample name, run, hash and reads."""
        ship, line = F.col("l_shipdate"), F.col("l_linenumber")
        size = F.when(F.col("l_returnflag") == "A", "S1").when(F.col("l_returnflag") == "N", "S2").otherwise("S3")
        quarter = F.quarter(ship)
        experiment = (
            F.when(quarter == 1, "AllPool")
            .when(quarter == 2, "Pooled.A1.A3")
            .when(quarter == 3, "Pooled.B3.B5")
            .otherwise("Pooled.C5.C7")
        )
        cycles = F.when(line <= 2, "20").when(line <= 4, "24").otherwise("28")
        month = (F.month(ship) - 3 * (quarter - 1)).cast("string")
        replicate = F.when(line <= 2, "1").when(line <= 4, "2").otherwise("3")
        calibration = F.concat(cycles, F.lit("C_"), experiment, F.lit("."), month)
        field = F.concat(F.lit("C1.T"), F.col("l_suppkey").cast("string"), F.lit("_"), size, F.lit("."), replicate)
        return self.read("lineitem").select(
            size.alias("size_class"),
            F.when(F.year(ship) == CALIBRATION_YEAR, calibration).otherwise(field).alias("sample_name"),
            F.when(F.col("l_linestatus") == "F", "1").otherwise("2").alias("run"),
            F.col("l_partkey").alias("hash"),
            F.col("l_quantity").cast("long").alias("n_reads"),
        )

    @cached_property
    def hashed(self) -> DataFrame:
        """Counts per size class, sample and hash."""
        return self.reads.groupBy("size_class", "sample_name", "hash").agg(F.sum("n_reads").alias("n_reads"))

    @cached_property
    def obs_run(self) -> DataFrame:
        """Counts per size class, sample, run and taxon."""
        return (
            self.reads.join(self.brands, "hash")
            .groupBy("size_class", "sample_name", "run", "taxon")
            .agg(F.sum("n_reads").alias("n_reads"))
        )

    @cached_property
    def obs(self) -> DataFrame:
        """Counts per size class, sample and taxon."""
        return (
            self.reads.join(self.brands, "hash")
            .groupBy("size_class", "sample_name", "taxon")
            .agg(F.sum("n_reads").alias("n_reads"))
        )

    @cached_property
    def design(self) -> DataFrame:
        """Counts with cycle number, pool, sample id and sample factor."""
        return sample_design(self.obs, "sample_name")

    @cached_property
    def brands(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("hash"), F.col("p_brand").alias("taxon"))

    @cached_property
    def taxonomy(self) -> DataFrame:
        """Ranks per hash with NULL, blank and rest sentinels."""
        size = F.col("p_size")
        order = F.when(size <= 7, F.lit(None)).when(size <= 12, "").otherwise(F.split("p_name", " ")[1])
        family = (
            F.when(size.between(10, 20), F.lit(None))
            .when(size.between(21, 24), "other")
            .otherwise(F.split("p_name", " ")[0])
        )
        genus = F.when(size > 33, F.lit(None)).otherwise(F.col("p_brand"))
        return self.read("part").select(
            F.col("p_partkey").alias("hash"),
            F.col("p_type").alias("class_rank"),
            order.alias("order_rank"),
            family.alias("family_rank"),
            genus.alias("genus_rank"),
        )

    @cached_property
    def taxonomy_b(self) -> DataFrame:
        """A second taxonomy of the same hashes with other gaps; parts of the top class are absent."""
        size = F.col("p_size")
        return (
            self.read("part")
            .where(F.col("p_type") != "PROMO")
            .select(
                F.col("p_partkey").alias("hash"),
                F.col("p_type").alias("class_rank"),
                F.when(size > 25, F.lit(None)).otherwise(F.split("p_name", " ")[1]).alias("order_rank"),
                F.when(size > 30, F.lit(None)).otherwise(F.split("p_name", " ")[0]).alias("family_rank"),
                F.col("p_brand").alias("genus_rank"),
            )
        )

    @cached_property
    def meta(self) -> DataFrame:
        """Station, axis score, zone and cycle."""
        s, n, reg = self.read("supplier"), self.read("nation"), self.read("region")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey)
            .join(reg, n.n_regionkey == reg.r_regionkey)
            .select(
                F.concat(F.lit("C1.T"), F.col("s_suppkey").cast("string")).alias("station"),
                F.col("s_acctbal").alias("pc1"),
                F.when(F.col("s_acctbal") < 4500, "offshore").otherwise("onshore").alias("zone"),
                F.col("r_name").alias("cycle"),
            )
        )

    @cached_property
    def shares(self) -> DataFrame:
        """Share of each taxon at each station and size class, with the station's axis score."""
        field = self.obs.where(F.col("sample_name").startswith("C1"))
        field = collapse_replicates(field, ["size_class"], "sample_name", "taxon", "n_reads", drop_like=None)
        shares = share(field, ["size_class", "sample_id"], "n_reads")
        return join_on(shares.withColumn("station", F.substring_index("sample_id", "_", 1)), self.meta, ["station"], null_safe=False)

    @cached_property
    def particles(self) -> DataFrame:
        """One row per imaged object, pixel geometry included."""
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        category = (
            F.when(F.col("event_type") == "click", "Calanoida")
            .when(F.col("event_type") == "view", "Oithonidae")
            .when(F.col("event_type") == "purchase", "Euphausiacea")
            .when(F.col("event_type") == "signup", "Chaetognatha")
            .otherwise("Oikopleuridae")
        )
        v = F.col("value")
        return self.read("events").select(
            F.col("event_id").alias("object_id"),
            F.concat(F.lit("C1.T"), F.col("user_id").cast("string")).alias("sample_id"),
            category.alias("category"),
            F.when(k >= 10, "validated").otherwise("predicted").alias("status"),
            F.concat(F.when(k >= 95, "Not-Living>").otherwise("living>"), category).alias("hierarchy"),
            v.alias("feret_px"),
            (v * v * 0.6).alias("area_px"),
            (v * v * 0.5).alias("area_exc_px"),
            (v * 1.1).alias("major_px"),
            (v * 0.7).alias("minor_px"),
            (k % 8 + 1).cast("double").alias("sub_part"),
            (k + 200).cast("double").alias("tot_vol"),
            F.lit(210.0).alias("depth_max"),
            F.col("ts").alias("taken_at"),
        )

    @cached_property
    def weights(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").alias("weight_id"),
            F.col("c_nationkey").alias("station_key"),
            F.col("c_acctbal").alias("biomass_dry"),
        )

    @cached_property
    def volumes(self) -> DataFrame:
        return self.read("nation").select(
            F.col("n_nationkey").alias("station_key"), (F.col("n_nationkey") * 10.0).alias("volume_m3")
        )

    @cached_property
    def depths(self) -> DataFrame:
        nation = self.read("nation")
        return nation.where(F.col("n_regionkey") > 0).select(
            F.col("n_nationkey").alias("station_key"), (F.col("n_regionkey") * 50.0 + 100).alias("depth_m")
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """One row per result file: its name carries marker, date, size class and variant."""
        marker = F.when(F.col("o_orderstatus") == "F", "18s").otherwise("coi")
        size = F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1))
        variant = F.when(F.col("o_orderstatus") == "P", "_nocollodaria").otherwise("")
        name = F.concat(
            F.lit("predicted_og_"), marker, F.lit("_"), F.date_format("o_orderdate", "MM_dd_yyyy"),
            F.lit("_"), size, F.lit("_phy"), variant, F.lit(".csv"),
        )
        return self.read("orders").select(
            F.col("o_orderkey").alias("row_id"), name.alias("file_name"), F.col("o_totalprice").alias("value")
        )


_SIZE = "case l_returnflag when 'A' then 'S1' when 'N' then 'S2' else 'S3' end"
_THIRD = "case when l_linenumber<=2 then {} when l_linenumber<=4 then {} else {} end"

#: view name -> (views it needs, SELECT text)
SQL_VIEWS: dict[str, tuple[str, str]] = {
    "reads": (
        "",
        f"""select {_SIZE} as size_class,
          case when year(l_shipdate)={CALIBRATION_YEAR} then
            {_THIRD.format("'20'", "'24'", "'28'")} || 'C_' ||
            case quarter(l_shipdate) when 1 then 'AllPool' when 2 then 'Pooled.A1.A3'
                 when 3 then 'Pooled.B3.B5' else 'Pooled.C5.C7' end
            || '.' || cast(month(l_shipdate)-3*(quarter(l_shipdate)-1) as varchar)
          else 'C1.T' || cast(l_suppkey as varchar) || '_' || {_SIZE} || '.' || {_THIRD.format("'1'", "'2'", "'3'")}
          end as sample_name,
          case l_linestatus when 'F' then '1' else '2' end as run,
          l_partkey as hash, cast(l_quantity as bigint) as n_reads from lineitem""",
    ),
    "hashed": (
        "reads",
        "select size_class, sample_name, hash, cast(sum(n_reads) as bigint) as n_reads from reads group by all",
    ),
    "obs_run": (
        "reads",
        """select size_class, sample_name, run, p_brand as taxon, cast(sum(n_reads) as bigint) as n_reads
           from reads join part on hash=p_partkey group by all""",
    ),
    "obs": (
        "reads",
        """select size_class, sample_name, p_brand as taxon, cast(sum(n_reads) as bigint) as n_reads
           from reads join part on hash=p_partkey group by all""",
    ),
    "design": (
        "obs",
        r"""select *, coalesce(try_cast(substring(sample_name,1,2) as integer),30) as cycle_num,
            right(sample_name,1) as pool, regexp_extract(sample_name,'^(.*)\.[^.]+$',1) as sample_id,
            case when starts_with(sample_name,'C') then regexp_extract(sample_name,'^(.*)\.[^.]+$',1)
                 else 'Calibration' end as sample_num from obs""",
    ),
    "taxonomy": (
        "",
        """select p_partkey as hash, p_type as class_rank,
           case when p_size<=7 then null when p_size<=12 then '' else split_part(p_name,' ',2) end as order_rank,
           case when p_size between 10 and 20 then null when p_size between 21 and 24 then 'other'
                else split_part(p_name,' ',1) end as family_rank,
           case when p_size>33 then null else p_brand end as genus_rank from part""",
    ),
    "taxonomy_b": (
        "",
        """select p_partkey as hash, p_type as class_rank,
           case when p_size>25 then null else split_part(p_name,' ',2) end as order_rank,
           case when p_size>30 then null else split_part(p_name,' ',1) end as family_rank,
           p_brand as genus_rank from part where p_type<>'PROMO'""",
    ),
    "meta": (
        "",
        """select 'C1.T' || cast(s_suppkey as varchar) as station, s_acctbal as pc1,
           case when s_acctbal<4500 then 'offshore' else 'onshore' end as zone, r_name as cycle
           from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    ),
    "shares": (
        "design meta",
        """select d.*, n_reads/sum(n_reads) over (partition by size_class, sample_id) as share, pc1, zone, cycle
           from (select size_class, sample_id, split_part(sample_id,'_',1) as station, taxon,
                 cast(sum(n_reads) as bigint) as n_reads from design where sample_num<>'Calibration' group by all) d
           left join meta m on d.station=m.station""",
    ),
    "particles": (
        "",
        """select object_id, sample_id, category, case when k>=10 then 'validated' else 'predicted' end as status,
           (case when k>=95 then 'Not-Living>' else 'living>' end) || category as hierarchy,
           value as feret_px, value*value*0.6::double as area_px, value*value*0.5::double as area_exc_px,
           value*1.1::double as major_px, value*0.7::double as minor_px,
           cast(k%8+1 as double) as sub_part, cast(k+200 as double) as tot_vol, 210.0::double as depth_max,
           ts as taken_at
           from (select event_id as object_id, 'C1.T' || cast(user_id as varchar) as sample_id,
             case event_type when 'click' then 'Calanoida' when 'view' then 'Oithonidae'
                  when 'purchase' then 'Euphausiacea' when 'signup' then 'Chaetognatha'
                  else 'Oikopleuridae' end as category,
             cast(regexp_extract(props,'([0-9]+)',1) as integer) as k, value, ts from events)""",
    ),
    "weights": ("", "select c_custkey as weight_id, c_nationkey as station_key, c_acctbal as biomass_dry from customer"),
    "volumes": ("", "select n_nationkey as station_key, n_nationkey*10.0::double as volume_m3 from nation"),
    "depths": (
        "",
        """select n_nationkey as station_key, n_regionkey*50.0::double+100 as depth_m
           from nation where n_regionkey>0""",
    ),
    "snapshots": (
        "",
        """select o_orderkey as row_id, 'predicted_og_' || (case o_orderstatus when 'F' then '18s' else 'coi' end)
           || '_' || strftime(o_orderdate,'%m_%d_%Y') || '_s' || substring(o_orderpriority,1,1) || '_phy'
           || (case o_orderstatus when 'P' then '_nocollodaria' else '' end) || '.csv' as file_name,
           o_totalprice as value from orders""",
    ),
}
