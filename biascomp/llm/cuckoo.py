"""Exact deduplication through a sharded cuckoo-filter index of live text digests.

Each shard of the index is one row: a cuckoo filter (16-bit fingerprints, four slots a bucket) and
the stored digests it stands for, kept in buckets. A digest that the filter does not know is new;
a hit is verified against the digests stored in its bucket, so a false hit costs one comparison.
When an insertion finds no place, the filter is made twice as large and filled from the stored keys.
Digests can be inserted and deleted later; an update reads the index, never the old texts.

Defined cases: a null text is the empty text; a null doc_id is smaller than any other; of repeated
rows (same id and text) one stays; an empty table gives an empty index and no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import parts_for, table, whole_text, written

SLOTS, MAX_KICKS = 4, 200
#: Rows of the input per shard of the index.
SHARD_ROWS = 50_000

INDEX_SCHEMA = (
    "shard int, n_buckets int, slots binary, digests array<string>, keep_id array<long>, keep_row array<long>,"
    " group_size array<long>"
)


class CuckooFilter:
    """Fingerprints in two possible buckets each; a kicked fingerprint moves to its other bucket."""

    def __init__(self, n_buckets: int, slots: bytes | None = None):
        self.n = n_buckets
        self.slots = array("H", slots if slots is not None else bytes(2 * SLOTS * n_buckets))

    def places(self, digest: str) -> tuple[int, int, int]:
        h = int(digest[:16], 16)
        fp = (h & 0xFFFF) or 1
        first = (h >> 16) & (self.n - 1)
        return fp, first, self.other(first, fp)

    def other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & (self.n - 1)

    def find(self, fp: int, bucket: int) -> int:
        for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if self.slots[at] == fp:
                return at
        return -1

    def __contains__(self, digest: str) -> bool:
        fp, a, b = self.places(digest)
        return self.find(fp, a) >= 0 or self.find(fp, b) >= 0

    def insert(self, digest: str) -> bool:
        """False if the filter is too full; it then has lost one fingerprint and must be rebuilt."""
        fp, a, b = self.places(digest)
        for bucket in (a, b):
            if (at := self.find(0, bucket)) >= 0:
                self.slots[at] = fp
                return True
        bucket = b
        for kick in range(MAX_KICKS):
            at = SLOTS * bucket + (kick + fp) % SLOTS
            fp, self.slots[at] = self.slots[at], fp
            bucket = self.other(bucket, fp)
            if (free := self.find(0, bucket)) >= 0:
                self.slots[free] = fp
                return True
        return False

    def delete(self, digest: str) -> None:
        fp, a, b = self.places(digest)
        for bucket in (a, b):
            if (at := self.find(fp, bucket)) >= 0:
                self.slots[at] = 0
                return


class Shard:
    """A filter and the live digests it stands for, with what is known of each."""

    def __init__(self, row: dict | None = None):
        self.live: dict[str, list] = {}  # digest -> [(known, doc_id, row), rows]
        self.filter = CuckooFilter(4)
        self.content: dict[int, set[str]] = {}
        if row:
            for d, k, r, n in zip(row["digests"], row["keep_id"], row["keep_row"], row["group_size"]):
                self.live[d] = [(k is not None, k or 0, r), n]
            self.filter = CuckooFilter(row["n_buckets"], row["slots"])
            self._fill_content()

    def _fill_content(self) -> None:
        self.content = {}
        for d in self.live:
            self.content.setdefault(self.filter.places(d)[1], set()).add(d)

    def has(self, digest: str) -> bool:
        """A hit of the filter, verified against the stored digests of the bucket."""
        if digest not in self.filter:
            return False
        return digest in self.content.get(self.filter.places(digest)[1], ())

    def insert(self, digest: str, keep: tuple[bool, int, int], n: int) -> None:
        if self.has(digest):
            known = self.live[digest]
            known[0] = max(known[0], keep)
            known[1] += n
            return
        self.live[digest] = [keep, n]
        if self.filter.insert(digest):
            self.content.setdefault(self.filter.places(digest)[1], set()).add(digest)
        else:
            self._resize()

    def _resize(self) -> None:
        size, done = self.filter.n, False
        while not done:
            size *= 2
            self.filter = CuckooFilter(size)
            done = all(self.filter.insert(d) for d in self.live)
        self._fill_content()

    def delete(self, digest: str) -> None:
        if self.has(digest):
            self.content[self.filter.places(digest)[1]].discard(digest)
            self.filter.delete(digest)
            del self.live[digest]

    def row(self, shard: int) -> pa.Table:
        kept = [v[0] for v in self.live.values()]
        ids, longs = [k[1] if k[0] else None for k in kept], pa.list_(pa.int64())
        return table(
            {
                "shard": ([shard], pa.int32()),
                "n_buckets": ([self.filter.n], pa.int32()),
                "slots": ([self.filter.slots.tobytes()], pa.binary()),
                "digests": ([list(self.live)], pa.list_(pa.string())),
                "keep_id": ([ids], longs),
                "keep_row": ([[k[2] for k in kept]], longs),
                "group_size": ([[v[1] for v in self.live.values()]], longs),
            }
        )


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, text_sha256) of every row, written once; ``row`` tells repeated rows apart."""
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).cast("long").alias("doc_id"),
            F.sha2(whole_text(text), 256).alias("text_sha256"),
        ),
        "digests",
    )


def _combined(batches):
    """Copies inside one task become one row, so that a hot text reaches its shard once per task."""
    best: dict[str, list] = {}
    for b in batches:
        for d, i, r, n in zip(*(b.column(k).to_pylist() for k in ("text_sha256", "doc_id", "row", "n"))):
            keep = (i is not None, i or 0, r)
            if (known := best.get(d)) is None:
                best[d] = [keep, n]
            else:
                known[0] = max(known[0], keep)
                known[1] += n
        if len(best) >= SHARD_ROWS:
            yield _partial(best)
            best = {}
    if best:
        yield _partial(best)


def _partial(best: dict[str, list]) -> pa.RecordBatch:
    kept = [v[0] for v in best.values()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(best), pa.string()),
            pa.array([k[1] if k[0] else None for k in kept], pa.int64()),
            pa.array([k[2] for k in kept], pa.int64()),
            pa.array([v[1] for v in best.values()], pa.int64()),
        ],
        names=["text_sha256", "doc_id", "row", "n"],
    )


def _shard_of(n_shards: int):
    return F.pmod(F.xxhash64("text_sha256"), F.lit(n_shards)).cast("int")


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], INDEX_SCHEMA)


def update(index: DataFrame, n_shards: int, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """The index after inserting rows (row, doc_id, text_sha256) and then deleting digests (text_sha256).

    Every shard with an entry in either is rewritten by one task; ``n_shards`` must stay the same
    for the life of an index.
    """
    schema = "text_sha256 string, doc_id long, row long, n long"
    spark = index.sparkSession
    changes = spark.createDataFrame([], schema)
    if inserts is not None:
        rows = inserts.select("text_sha256", "doc_id", "row", F.lit(1).cast("long").alias("n"))
        changes = changes.unionByName(rows.mapInArrow(_combined, schema))
    if deletes is not None:  # n = 0 marks a deletion
        gone = deletes.select("text_sha256").distinct()
        none = F.lit(None).cast("long")
        changes = changes.unionByName(gone.withColumns({"doc_id": none, "row": F.lit(-1).cast("long"), "n": F.lit(0).cast("long")}))
    changes = changes.withColumn("shard", _shard_of(n_shards))

    def change(key, old: pa.Table, new: pa.Table) -> pa.Table:
        shard = Shard(old.to_pylist()[0] if old.num_rows else None)
        rows = list(zip(*(new.column(k).to_pylist() for k in ("text_sha256", "doc_id", "row", "n"))))
        for d, i, r, n in rows:
            if n:
                shard.insert(d, (i is not None, i or 0, r), n)
        for d, _, _, n in rows:
            if not n:
                shard.delete(d)
        return shard.row(key[0].as_py())

    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(change, INDEX_SCHEMA)


def entries(index: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, keep_row, group_size) of every live digest."""
    zipped = F.arrays_zip("digests", "keep_id", "keep_row", "group_size")
    return index.select(F.explode(zipped).alias("e")).select(
        F.col("e.digests").alias("text_sha256"), "e.keep_id", "e.keep_row", "e.group_size"
    )


def exact_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; the largest id of a group stays."""
    keyed = digests(docs, doc_id=doc_id, text=text)
    n_shards = parts_for(keyed.count(), SHARD_ROWS)
    index = written(update(empty_index(docs.sparkSession), n_shards, keyed), "cuckoo-index")
    return keyed.join(entries(index), "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
