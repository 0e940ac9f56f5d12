"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where the hash's top bits are zero, within
MIN_CHUNK and MAX_CHUNK bytes. A cut depends on the bytes before it only, so an insertion moves no
cut but the near ones. Equal chunks have equal digests; of each, the first by (doc_id, start) stays.
The others are removed where they stand in a stretch of repeated chunks that has at least MIN_RUN
bytes or is the whole text, so that single words and phrases common in prose stay. A passage inside
other text loses its whole chunks only: up to its first common cut and after its last one it stays,
and a short passage may hold no whole chunk.

Digests are counted with map-side sums and only repeated ones are looked at again; the repeated
chunks meet their first place in a join that Spark may split, so a chunk in a third of all rows is
no task of its own. Chunks are cut where the rows are read; a row is known by a 64-bit hash of its id
and text, and rows that share both meet in one part, where all but the first lose every chunk.

Defined cases: null and empty texts have no chunks; a text shorter than MIN_CHUNK is one chunk;
null ids come before all others; repeated rows count as copies of each other, the first read stays;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import batch, parts_for, table, text_bytes, whole_text, written, PART_BYTES

#: Bytes of a chunk: least, most, and the bits that must be zero at a cut (about 2**CUT_BITS between cuts).
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 16, 512, 5
#: Least bytes of a stretch of repeated chunks that is removed, unless it is the whole text.
MIN_RUN = 56


def gear_table() -> np.ndarray:
    """256 random 32-bit numbers from a multiplicative mix of their index."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over the last 32 bytes, in five doublings."""
    h, width = GEAR[data], 1
    while width < 32:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def chunk_ends(text: bytes) -> list[int]:
    """Where the chunks of a text end."""
    n, ends, start = len(text), [], 0
    if not n:
        return []
    cuts = np.flatnonzero(gear_hash(np.frombuffer(text, np.uint8)) >> np.uint32(32 - CUT_BITS) == 0) + 1
    for cut in cuts.tolist():
        while cut - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if cut - start >= MIN_CHUNK:
            ends.append(cut)
            start = cut
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    return [*ends, n] if start < n else ends


CHUNK_SCHEMA = "doc_id long, key long, start int, digest binary"
#: Bytes of a digest: among 10**9 different chunks two are alike with a chance of 6e-12.
DIGEST = 12
#: Chunks of one output batch.
BATCH = 200_000


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, doc_id, text); rows of one id and text share the key."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def _chunk_rows(batches):
    def flush():
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return batch({x.split()[0]: (v, t) for x, v, t in zip(CHUNK_SCHEMA.split(", "), held, kinds)})

    held = [], [], [], []
    for b in batches:
        for key, i, t in zip(*(b.column(c) for c in range(3))):
            key, i, t, start = key.as_py(), i.as_py(), t.as_py().encode(), 0
            for end in chunk_ends(t):
                for column, x in zip(held, (i, key, start, hashlib.blake2b(t[start:end], digest_size=DIGEST).digest())):
                    column.append(x)
                start = end
                if len(held[0]) >= BATCH:
                    yield flush()
                    held = [], [], [], []
    yield flush()


def repeated_chunks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents in parts, chunks (part, key, start, first_doc) that occur in an earlier row or earlier in their own)."""
    rows, parts = _keyed(docs, doc_id, text), parts_for(text_bytes(docs, text), PART_BYTES)
    part = F.pmod(F.col("key"), F.lit(parts)).cast("int").alias("part")
    chunks = written(rows.mapInArrow(_chunk_rows, CHUNK_SCHEMA), "chunks")
    place = F.struct("doc_id", "key", "start")
    firsts = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = chunks.join(firsts.drop("n"), "digest").where(~F.struct("doc_id", "key", "start").eqNullSafe(F.col("first")))
    return rows.select(part, "*"), later.select(part, "key", "start", F.col("first.doc_id").alias("first_doc"))


RESULT_SCHEMA = (
    "doc_id long, n_bytes long, n_chunks long, n_dup_chunks long, n_removed long, kept_sha256 string,"
    " first_docs array<long>, kept string"
)


def long_runs(ends: list[int], repeated: list[bool], least: int = MIN_RUN) -> list[bool]:
    """Which chunks lie in a stretch of repeated ones of ``least`` bytes, or that is the whole text."""
    out = [False] * len(ends)
    first = 0
    for i in range(len(ends) + 1):
        if i == len(ends) or not repeated[i]:
            begin = ends[first - 1] if first else 0
            size = (ends[i - 1] if i else 0) - begin
            if first < i and (size >= least or size == ends[-1]):
                out[first:i] = [True] * (i - first)
            first = i + 1
    return out


def _removed(key, docs: pa.Table, later: pa.Table) -> pa.Table:
    docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    drop: dict[tuple[int, int], int | None] = {}
    for k, s, f in zip(*(later.column(c).to_pylist() for c in ("key", "start", "first_doc"))):
        drop[k, s] = f
    out: list[tuple] = []
    before = None
    for k, i, t in zip(*(docs.column(c).to_pylist() for c in ("key", "doc_id", "text"))):
        again, before = (i, t) == before, (i, t)  # a repeated row: the first of them has all of its chunks
        t, start, kept, dups, first = t.encode(), 0, [], 0, set()
        ends = chunk_ends(t)
        repeated = [again or (k, s) in drop for s in [0, *ends][: len(ends)]]
        for end, gone in zip(ends, long_runs(ends, repeated)):
            if gone:
                dups += 1
                first.add(drop.get((k, start), i))
            else:
                kept.append(t[start:end])
            start = end
        rest = b"".join(kept)
        first = sorted(x for x in first if x is not None)
        out.append((i, len(t), len(ends), dups, len(t) - len(rest), hashlib.sha256(rest).hexdigest(), first, rest.decode(errors="replace")))
    kinds = (pa.int64(),) * 5 + (pa.string(), pa.list_(pa.int64()), pa.string())
    names = [x.split()[0] for x in RESULT_SCHEMA.split(", ")]
    return table({n: (list(v), t) for n, v, t in zip(names, zip(*out), kinds)}) if out else table({n: ([], t) for n, t in zip(names, kinds)})


def substring_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: sizes, the digest of what is kept, the documents whose chunks it repeats, the kept text."""
    parted, later = repeated_chunks(docs, doc_id=doc_id, text=text)
    return parted.groupBy("part").cogroup(later.groupBy("part")).applyInArrow(_removed, RESULT_SCHEMA)
