"""Delimited files in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biascomp.operators.reshape import to_long


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
    sep: str = ",", encoding: str = "UTF-8", drop: Sequence[str] = (),
) -> DataFrame:
    """Header-led CSV or TSV (gzip included), ``NA`` read as NULL, index columns left out.

    Pass a schema for data of any size; without one, types are inferred by a second pass.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    reader = reader.option("nullValue", "NA").option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path).drop(*drop)


def read_tsv_latin1(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    return read_delimited(spark, path, schema, sep="\t", encoding="ISO-8859-1")


def read_count_matrix(
    spark: SparkSession, path: str | list[str], key: str, sample: str = "sample_name", value: str = "n_reads",
    index: Sequence[str] = ("_c0",), drop_zero: bool = True, schema: T.StructType | str | None = None,
) -> DataFrame:
    """Wide count matrix (category rows, sample columns) as long counts.

    Sample columns keep their raw names. The key may stand in any column; index columns go. Without
    a schema every cell is read as text and the counts go through double, so that 1e3 is a count.
    """
    reader = spark.read.option("header", True).option("nullValue", "NA")
    wide = (reader if schema is None else reader.schema(schema)).csv(path)
    wide = wide.drop(*[c for c in index if c in wide.columns and c != key])
    long = to_long(wide, [key], sample, value)
    if schema is None:
        long = long.withColumn(value, F.col(value).cast("double").cast("long"))
    return long.where(F.col(value).isNotNull() & (F.col(value) != 0)) if drop_zero else long


def file_table(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Folder columns, path, name, change time and length of every file below ``path``.

    Made from the listing alone: no file is opened. ``pattern`` is a glob on file names.
    """
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).drop("content")
    files = files.withColumnRenamed("modificationTime", "changed_at")
    return files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))


def with_file_name(df: DataFrame, out: str = "file_name") -> DataFrame:
    """Name of the source file of every row."""
    return df.withColumn(out, F.col("_metadata.file_name"))


def with_change_time(df: DataFrame, out: str = "changed_at") -> DataFrame:
    """Change time of the source file of every row."""
    return df.withColumn(out, F.col("_metadata.file_modification_time"))


def write_delimited(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists", sep: str = ",",
    encoding: str = "UTF-8", compression: str = "none",
) -> None:
    """CSV or TSV sink; one file per task, folders per partition column."""
    writer = df.write.mode(mode).option("header", True).option("nullValue", "NA").option("sep", sep)
    writer = writer.option("encoding", encoding).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_stamped(
    df: DataFrame, path: str, stamp: Column | None = None, partition_by: Sequence[str] = (), fmt: str = "parquet",
) -> None:
    """Write a dated snapshot: the stamp is a partition column, so older ones stay readable.

    Folders that this write fills are replaced, so a second run of the same day leaves no row twice.
    """
    day = F.date_format(stamp if stamp is not None else F.current_date(), "yyyy-MM-dd")
    keys = ["snapshot_date", *partition_by]
    # rows of one folder meet before the write, and AQE splits folders that are too large for one file
    out = df.withColumn("snapshot_date", day).hint("rebalance", *keys)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
    writer.partitionBy(*keys).format(fmt).save(path)
