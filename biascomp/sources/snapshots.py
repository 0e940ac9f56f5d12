"""Snapshots: the latest per key by the date in a name, by change time or as published, and what is superseded."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biascomp.functions import text
from biascomp.operators.groups import add_group_aggs, join_on
from biascomp.sources.files import file_table


def name_parts(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Marker, snapshot date, size suffix and variant flag carried by a result file name."""
    return df.withColumns(
        {
            "primer": text.extract(name, r"^predicted_og_([^_]+)_"),
            "snapshot_date": text.snapshot_date(name),
            "suffix": text.extract(name, r"_(s\d)_phy"),
            "variant": F.col(name).contains("_nocollodaria"),
        }
    )


def latest(df: DataFrame, keys: Sequence[str], when: str = "snapshot_date") -> DataFrame:
    """Rows of the latest snapshot of each key. Rows without a date are never the latest.

    The newest date per key is aggregated and joined back, so rows are not sorted.
    """
    top = add_group_aggs(df, keys, {"__latest": F.max(when)})
    return top.where(F.col(when) == F.col("__latest")).drop("__latest")


def newest_files(
    files: DataFrame, keys: Sequence[str], version: Sequence[str], when: str = "changed_at"
) -> DataFrame:
    """Files of the newest version per key.

    Files that share ``version`` belong together, and a version is as new as its newest file. Of
    versions equally new the one that sorts last is taken; files without a time are never the newest.
    """
    ages = files.where(F.col(when).isNotNull()).groupBy(*keys, *version).agg(F.max(when).alias("__at"))
    top = ages.groupBy(*keys).agg(F.max(F.struct("__at", *version)).alias("__top"))
    chosen = top.select(*keys, *[F.col(f"__top.{v}").alias(v) for v in version])
    return join_on(files, chosen, [*keys, *version], "left_semi")


def read_newest(
    spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str], when: str = "changed_at",
    fmt: str = "parquet", schema: str | None = None, pattern: str | None = None,
    named: Callable[[DataFrame], DataFrame] | None = None, header: bool = True,
) -> DataFrame:
    """Rows of the newest version per key; no other file is opened.

    The first step lists the files, the second reads the chosen ones. ``named`` may add columns to
    the list, such as the date in a file name. Only paths of chosen files reach the driver, where
    Spark keeps the paths of every scan anyway.
    """
    files = file_table(spark, path, pattern)
    chosen = newest_files(named(files) if named else files, keys, version, when).select("path")
    paths = sorted(row.path for row in chosen.toLocalIterator())
    if not paths:
        raise FileNotFoundError(f"no file below {path}")
    reader = spark.read.format(fmt).option("basePath", path)
    if fmt == "csv":
        reader = reader.option("header", header).option("nullValue", "NA").option("escape", '"')
    return (reader.schema(schema) if schema else reader).load(paths)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Stop when nothing matches, as a missing input must not look like an empty result."""
    if df.isEmpty():
        raise FileNotFoundError(f"no rows for {what}")
    return df


def snapshot_state(df: DataFrame, keys: Sequence[str], when: str = "snapshot_date") -> DataFrame:
    """Mark every row ``current`` or ``past``; write with ``partitionBy("snapshot_state")``."""
    top = add_group_aggs(df, keys, {"__latest": F.max(when)})
    state = F.when(F.col(when) == F.col("__latest"), F.lit("current")).otherwise(F.lit("past"))
    return top.withColumn("snapshot_state", state).drop("__latest")


def _files_below(spark: SparkSession, path: str) -> DataFrame | None:
    """The file table, or None where nothing has been written yet."""
    try:
        return file_table(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _published_files(spark: SparkSession, path: str) -> DataFrame | None:
    """Path, run and folder (the key values as folder names) of every data file of every run."""
    found = _files_below(spark, f"{path}/data")
    if found is None:
        return None
    place = r"/data/run=([0-9a-f]{32})/(?:(.*)/)?[^/]+$"
    return found.select("path", *[F.regexp_extract("path", place, i).alias(c) for i, c in ((1, "run"), (2, "folder"))])


def live_folders(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(number, rows (folder, run)) of the newest manifest; number 0 and no rows before the first."""
    found = _files_below(spark, f"{path}/live")
    number = F.regexp_extract("path", r"/version=(\d+)/[^/]+$", 1).cast("long")
    newest = None if found is None else found.agg(F.max(number)).first()[0]
    if newest is None:
        return 0, spark.createDataFrame([], "folder string, run string")
    return newest, spark.read.schema("folder string, run string").parquet(f"{path}/live/version={newest}")


def switch(spark: SparkSession, path: str, run: str) -> None:
    """Make the folders of a written run the live ones; folders that it does not fill stay as they were.

    The manifest has a row per live folder and is one file, so it appears to readers by one rename.
    """
    newest, old = live_folders(spark, path)
    new = _published_files(spark, path).where(F.col("run") == run).select("folder", "run").distinct()
    kept = join_on(old, new.select("folder"), ["folder"], "left_anti")
    # append: a run that died while it wrote this version left no file, only an unfinished folder
    kept.unionByName(new).coalesce(1).write.mode("append").parquet(f"{path}/live/version={newest + 1}")


def publish(df: DataFrame, path: str, keys: Sequence[str]) -> str:
    """Write the rows as a new run and make its folders the live ones; older ones stay as the archive.

    Nothing is moved or overwritten: until the manifest is there, and for good if the run dies,
    readers see the state before. One writer at a time; the keys of a path never change.
    """
    run = uuid.uuid4().hex
    rows = df.hint("rebalance", *keys) if keys else df
    rows.write.partitionBy(*keys).parquet(f"{path}/data/run={run}")
    switch(df.sparkSession, path, run)
    return run


def read_live(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of the live folders with their ``run``; no other file is opened."""
    _, rows = live_folders(spark, path)
    files = _published_files(spark, path)
    paths = [] if files is None else [r.path for r in join_on(files, rows, ["folder", "run"], "left_semi").toLocalIterator()]
    if not paths:
        raise FileNotFoundError(f"nothing published below {path}")
    reader = spark.read.option("basePath", f"{path}/data")
    return (reader.schema(schema) if schema else reader).parquet(*sorted(paths))


def archived_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, run and folder of every data file that is not live: superseded, or of a run that died."""
    files = _published_files(spark, path)
    if files is None:
        raise FileNotFoundError(f"nothing published below {path}")
    return join_on(files, live_folders(spark, path)[1], ["folder", "run"], "left_anti")
