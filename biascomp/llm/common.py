"""Shared helpers: intermediate tables in the shared folder, text columns, group counts."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.session import shared_folder

#: Text bytes that one grouped Python task is meant to hold at a time.
PART_BYTES = 4 << 20


def new_folder(df: DataFrame, what: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: read again, never computed again."""
    path = new_folder(df, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parts_for(total: int, each: int) -> int:
    """Groups needed so that each holds about ``each`` units."""
    return max(1, -(-int(total or 0) // each))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(whole_text(text)))).first()[0] or 0


def with_parts(docs: DataFrame, parts: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, doc_id, text): documents dealt over ``parts`` groups by a hash of id and text.

    Repeated rows share a part; null ids and texts are dealt like any other.
    """
    key = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(parts)).cast("int")
    return docs.select(key.alias("part"), F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))


def table(columns: dict[str, tuple[object, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, type=t) for k, (v, t) in columns.items()})


def batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    arrays = [pa.array(v, type=t) for v, t in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))
