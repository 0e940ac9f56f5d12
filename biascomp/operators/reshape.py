"""Wide and long forms, sample names, replicates, pools and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.functions import text
from biascomp.operators.groups import add_group_aggs

# The calibration design and its name parts.
CALIBRATION = "Calibration"
FIELD_PREFIX = "C"
FIELD_CYCLES = 30
EXPERIMENTS = ["AllPool", "Pooled.A1.A3", "Pooled.B3.B5", "Pooled.C5.C7"]
TREATMENTS = ["20C", "24C", "28C"]
REPLICATES = ["1", "2", "3"]


def to_long(
    df: DataFrame, ids: Sequence[str], name: str, value: str, values: Sequence[str] | None = None,
    drop_zero: bool = False,
) -> DataFrame:
    """Columns to rows; optionally without NULL and zero cells."""
    values = values or [c for c in df.columns if c not in ids]
    quoted = [F.col(f"`{c}`") for c in values]
    out = df.unpivot([F.col(f"`{c}`") for c in ids], quoted, name, value)
    return out.where(F.col(value).isNotNull() & (F.col(value) != 0)) if drop_zero else out


def to_wide(
    df: DataFrame, keys: Sequence[str], name: str, value: str, values: Sequence[str], fill: int | None = 0
) -> DataFrame:
    """Rows to columns, repeated cells added up; the column list is stated, not discovered."""
    out = df.groupBy(*keys).pivot(name, list(values)).agg(F.sum(value))
    return out if fill is None else out.na.fill(fill, list(values))


def gather_array(df: DataFrame, ids: Sequence[str], array: str, index: str = "idx", value: str = "val") -> DataFrame:
    """Array elements to rows with their position, counted from one."""
    at = F.posexplode(array).alias("__pos", value)
    return df.select(*ids, at).select(*ids, (F.col("__pos") + 1).alias(index), value)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; columns missing from one are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_counts(frames: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Outer merge of count tables in long form: stacked, then added up once per key."""
    return union_all(frames).groupBy(*keys).agg(F.sum(value).alias(value))


def select_like(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Rows whose sample name matches the pattern (column selection in long form)."""
    return df.where(F.col(name).rlike(pattern))


def drop_zero_categories(df: DataFrame, by: Sequence[str], category: str, value: str) -> DataFrame:
    """Rows of categories with any reads in the group."""
    total = add_group_aggs(df, [*by, category], {"__t": F.sum(value)})
    return total.where(F.col("__t") != 0).drop("__t")


def collapse_replicates(
    df: DataFrame, by: Sequence[str], sample: str, category: str, value: str,
    out: str = "sample_id", drop_like: str | None = "All",
) -> DataFrame:
    """Add up technical replicates, named by a last dot token, and leave out pooled samples."""
    short = df.withColumn(out, text.drop_last_token(sample))
    if drop_like:
        short = short.where(~F.col(out).contains(drop_like))
    return short.groupBy(*by, out, category).agg(F.sum(value).alias(value))


def sample_design(df: DataFrame, name: str, default_cycles: int = FIELD_CYCLES) -> DataFrame:
    """Cycle number, pool, sample id and sample factor read from the sample name."""
    n = F.col(name)
    sample_id = text.drop_last_token(n)
    return df.withColumns(
        {
            "cycle_num": text.leading_number(n, 2, default_cycles),
            "pool": F.substring(n, -1, 1),
            "sample_id": sample_id,
            "sample_num": F.when(n.startswith(FIELD_PREFIX), sample_id).otherwise(F.lit(CALIBRATION)),
        }
    )


def experiment_of(name: Column | str) -> Column:
    """Calibration experiment in a sample name, NULL for field samples."""
    return text.extract(name, r"C_(AllPool|Pooled\.[A-C]\d\.[A-C]\d)\.")


def treatment_of(name: Column | str) -> Column:
    """Calibration treatment in a sample name, NULL for field samples."""
    return text.extract(name, r"^(\d{2}C)_")


def calibration_names(df: DataFrame) -> DataFrame:
    """Treatment × experiment × replicate names, as rows made from the design constants."""
    spark = df.sparkSession
    design = spark.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in TREATMENTS])).alias("treatment")
    )
    design = design.withColumn("experiment", F.explode(F.array(*[F.lit(e) for e in EXPERIMENTS])))
    design = design.withColumn("replicate", F.explode(F.array(*[F.lit(r) for r in REPLICATES])))
    name = F.concat(F.col("treatment"), F.lit("_"), F.col("experiment"), F.lit("."), F.col("replicate"))
    return design.withColumn("sample_name", name)


def calibration_grid(df: DataFrame, name: str = "sample_name") -> DataFrame:
    """The design names that occur in the data."""
    present = df.select(F.col(name).alias("sample_name")).distinct()
    return calibration_names(df).join(present, "sample_name", "left_semi")


def pool_subset(df: DataFrame, name: str, pools: Sequence[str], size_token: str | None = None) -> DataFrame:
    """Rows of the named pools, plus field samples of one size class when asked for."""
    keep = reduce(lambda a, b: a | b, [F.col(name).contains(p) for p in pools])
    if size_token:
        keep = keep | F.col(name).contains(size_token)
    return df.where(keep)


def assign_run(df: DataFrame, name: str, rules: Sequence[tuple[str, str]], out: str = "run") -> DataFrame:
    """First matching rule decides the sequencing run; NULL when none matches."""
    rule: Column | None = None
    for pattern, run in rules:
        hit = F.col(name).rlike(pattern)
        rule = F.when(hit, F.lit(run)) if rule is None else rule.when(hit, F.lit(run))
    return df.withColumn(out, rule)


# Pooled samples and third/fourth replicates belong to the second run.
RUN_RULES = [("Pool", "2"), (r"\.1|\.2", "1"), (r"\.3", "2"), (r"\.4", "2")]


def parse_pool_key(df: DataFrame, key: str = "pool") -> DataFrame:
    """Pool type, size class, marker, numeric size and pool rank of a pool key."""
    return df.withColumns(
        {
            "pool_type": text.extract(key, r"^([^_]+)"),
            "size": text.extract(key, text.SIZE_TOKEN),
            "primer": text.last_token(key),
        }
    ).withColumns(
        {
            "size_fraction": text.code("size", text.SIZE_CODES),
            "rank_pool": text.code("pool_type", text.POOL_RANKS),
        }
    )


def design_matrix(df: DataFrame, obs: str, sample: str, levels: Sequence[str], cycle: str) -> DataFrame:
    """Cycle number and one indicator column per sample level, one row per observation."""
    one = [F.max((F.col(sample) == lv).cast("int")).alias(lv) for lv in levels]
    return df.groupBy(obs).agg(F.max(cycle).alias(cycle), *one)


def design_long(df: DataFrame, obs: Sequence[str], sample: str, cycle: str) -> DataFrame:
    """Entries of the design that are not zero, for any number of sample levels: one row per
    observation for its sample level and one for its cycle number."""
    entries = F.array(
        F.struct(F.col(sample).alias("design_column"), F.lit(1.0).alias("design_value")),
        F.struct(F.lit(cycle).alias("design_column"), F.col(cycle).cast("double").alias("design_value")),
    )
    return df.select(*obs, sample, cycle).distinct().select(*obs, F.inline(entries))


def apply_corrections(df: DataFrame, column: str, fixes: Mapping[object, object]) -> DataFrame:
    """Replace listed wrong values, keep all others."""
    return df.replace(dict(fixes), subset=[column])


def fill_missing(df: DataFrame, text_value: str = "other", number: int = 0) -> DataFrame:
    """Every missing string becomes ``text_value``, every missing number ``number``."""
    return df.na.fill(text_value).na.fill(number)
