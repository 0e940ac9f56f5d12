"""Token ids of all documents in training order, as binary shards with a fixed stride.

The documents of an input partition are tokenised, each closed by an end token, and laid end to end;
the stream is cut into sequences of ``seq_len`` ids (the partition's last one is padded with end
tokens). Sequences are numbered through all partitions, and a keyed Feistel permutation with cycle
walking turns every number below n into another number below n: its global slot. A shard holds
``shard_sequences`` consecutive slots, sorted, every record of the same size, so training reads
shards from front to back and a restart seeks to slot * stride.

Two passes tokenise: the first only counts (one small row a document), the second writes records
straight into the shuffle, so ids are never stored twice. The second checks its counts against the
first. Shards are written by Spark's own writer with its commit protocol: a lost task leaves nothing.

A record is ``seq_len`` ids of 2 bytes (4 if the vocabulary needs it), little endian, and one line
feed, which the writer adds. The order depends on the key, the files and how Spark splits them.

Defined cases: null and empty texts are one end token; documents longer than a sequence go on in the
next; repeated rows and null ids are kept as they come; an empty table gives no sequences and no
shards; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biascomp.llm.common import batch, new_folder, whole_text, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split of texts into words that the vocabulary was made for
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQ_LEN, SHARD_SEQUENCES, KEY, ROUNDS = 1024, 8192, 2024, 6
#: Ends a pattern whose stretches of white space need a look ahead.
_BLANKS = r"\s+(?!\S)|\s+"
_TWO_BLANKS = re.compile(r"\s\s")


class Tokenizer:
    """Byte-pair ids of texts.

    Where no two blanks are neighbours, every stretch of white space is one character: such texts are
    split by a pattern without look ahead, which gives the same words in a fraction of the time.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.end = max(ranks.values()) + 1
        self.type = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self._encode = self._apart = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        if pattern.endswith(f"|{_BLANKS}"):
            plain = pattern.removesuffix(_BLANKS) + r"\s"
            self._apart = tiktoken.Encoding("apart", pat_str=plain, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.closing = self.pack([self.end])

    def pack(self, ids: list[int]) -> bytes:
        ids = array("H" if self.type.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ids(self, text: str) -> list[int]:
        return self._encode(text) if _TWO_BLANKS.search(text) else self._apart(text)

    def document(self, text: str) -> bytes:
        """The ids of a text and the end token, packed."""
        return self.pack(self.ids(text)) + self.closing


@lru_cache(2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n-1 that the key picks; walks on while a value lies beyond n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93 + 1) & (1 << 64) - 1) for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for k in keys:
            h = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(31)) & low)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(x).astype(np.uint64))
    while (beyond := out >= n).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


@dataclass
class Layout:
    """What a reader needs to know of the shards in ``folder``."""

    folder: str
    n_sequences: int
    seq_len: int
    shard_sequences: int
    id_bytes: int
    end_id: int
    key: int

    @property
    def stride(self) -> int:
        return self.seq_len * self.id_bytes + 1

    @property
    def n_shards(self) -> int:
        return -(-self.n_sequences // self.shard_sequences)


def _counts(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(part, doc_id, start, n_tokens): where each document lies in its partition's stream."""

    def scan(batches):
        t, part, at = tokenizer(vocabulary, pattern), TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.array([len(t.ids(x)) + 1 for x in b.column(1).to_pylist()], np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield batch({"part": ([part] * len(n), pa.int32()), "doc_id": (b.column(0), pa.int64()), "start": (start, pa.int64()), "n_tokens": (n, pa.int64())})

    return written(rows.mapInArrow(scan, "part int, doc_id long, start long, n_tokens long"), "token-counts")


def _records(rows: DataFrame, layout: Layout, parts: dict[int, tuple[int, int]], vocabulary: str, pattern: str) -> DataFrame:
    """(slot, record) of every sequence. parts: first sequence and ids of each partition."""
    sent = rows.sparkSession.sparkContext.broadcast(parts)

    def scan(batches):
        t, part = tokenizer(vocabulary, pattern), TaskContext.get().partitionId()
        number, total = sent.value.get(part, (0, 0))
        size, rest, done = layout.seq_len * t.type.itemsize, b"", 0

        def cut(stream: bytes):
            nonlocal number
            n = len(stream) // size
            slots = feistel(np.arange(number, number + n), layout.n_sequences, layout.key)
            number += n
            return batch({"slot": (slots, pa.int64()), "record": ([stream[k * size : (k + 1) * size] for k in range(n)], pa.binary())})

        for b in batches:
            stream = [rest]
            for text in b.column(1).to_pylist():
                stream.append(t.document(text))
                done += len(stream[-1]) // t.type.itemsize
                if done > total:
                    raise RuntimeError(f"partition {part} has changed since its ids were counted")
            stream = b"".join(stream)
            rest = stream[len(stream) // size * size :]
            yield cut(stream)
        if done != total:
            raise RuntimeError(f"partition {part} has changed since its ids were counted")
        if rest:
            yield cut(rest + t.closing * ((size - len(rest)) // t.type.itemsize))

    return rows.mapInArrow(scan, "slot long, record binary")


def _slots(counts: DataFrame, layout: Layout, parts: dict[int, tuple[int, int]]) -> DataFrame:
    """(slot, n_tokens, doc_ids): the documents of every sequence, in id order."""
    sent = counts.sparkSession.sparkContext.broadcast({p: first for p, (first, _) in parts.items()})
    length = layout.seq_len

    def spread(batches):
        for b in batches:
            part, start, n = (b.column(c).to_numpy() for c in ("part", "start", "n_tokens"))
            first, last = start // length, (start + n - 1) // length
            times = last - first + 1
            row = np.repeat(np.arange(len(part)), times)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            held = np.minimum((start + n)[row], (seq + 1) * length) - np.maximum(start[row], seq * length)
            base = np.array([sent.value[p] for p in part.tolist()], np.int64)
            slot = feistel(base[row] + seq, layout.n_sequences, layout.key) if len(row) else row
            yield batch({"slot": (slot, pa.int64()), "doc_id": (b.column("doc_id").take(pa.array(row)), pa.int64()), "held": (held, pa.int64())})

    rows = counts.mapInArrow(spread, "slot long, doc_id long, held long")
    return rows.groupBy("slot").agg(F.sum("held").alias("n_tokens"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def write_shards(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, seq_len: int = SEQ_LEN,
                 shard_sequences: int = SHARD_SEQUENCES, key: int = KEY, vocabulary: str = VOCABULARY,
                 pattern: str = PATTERN) -> tuple[Layout, DataFrame]:
    """Write the shards; returns their layout and (slot, n_tokens, doc_ids) of every sequence.

    The layout is also written beside the shards, as JSON in ``<folder>/layout``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    counts = _counts(rows, vocabulary, pattern)
    parts, number = {}, 0
    # one number per input partition
    for part, n in sorted(counts.groupBy("part").agg(F.sum("n_tokens")).collect()):
        parts[part] = (number, n)
        number += -(-n // seq_len)
    t = tokenizer(vocabulary, pattern)
    layout = Layout(folder or new_folder(docs, "shards"), number, seq_len, shard_sequences, t.type.itemsize, t.end, key)
    if number:
        records = _records(rows, layout, parts, vocabulary, pattern)
        shard = F.expr(f"cast(slot div {shard_sequences} as int)")
        ordered = records.repartitionById(layout.n_shards, shard).sortWithinPartitions("slot")
        ordered.select(F.col("record").cast("string")).write.text(f"{layout.folder}/shards")
    spark.createDataFrame([asdict(layout)]).coalesce(1).write.json(f"{layout.folder}/layout")
    return layout, _slots(counts, layout, parts)


_SHARD = re.compile(r"part-(\d+)")


def read_back(spark: SparkSession, layout: Layout, first: int = 0, stop: int | None = None) -> DataFrame:
    """(slot, shard, byte_offset, record) of the slots from ``first`` up to ``stop``, from the files.

    Only the shards that hold these slots are opened.
    """
    stop = layout.n_sequences if stop is None else min(stop, layout.n_sequences)
    schema = "slot long, shard int, byte_offset long, record binary"
    if first >= stop:
        return spark.createDataFrame([], schema)
    wanted = range(first // layout.shard_sequences, (stop - 1) // layout.shard_sequences + 1)
    files = spark.read.format("binaryFile")
    if len(wanted) <= 100:
        files = files.option("pathGlobFilter", "part-{" + ",".join(f"{k:05d}" for k in wanted) + "}-*")
    size, stride, per_shard = layout.seq_len * layout.id_bytes, layout.stride, layout.shard_sequences

    def scan(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                shard, data = int(_SHARD.search(path.rsplit("/", 1)[-1])[1]), content.as_buffer()
                at = np.arange(data.size // stride)
                at = at[(at + shard * per_shard >= first) & (at + shard * per_shard < stop)]
                view = memoryview(data)
                yield batch(
                    {
                        "slot": (at + shard * per_shard, pa.int64()), "shard": ([shard] * len(at), pa.int32()),
                        "byte_offset": (at * stride, pa.int64()), "record": ([bytes(view[k : k + size]) for k in (at * stride).tolist()], pa.binary()),
                    }
                )

    return files.load(f"{layout.folder}/shards").select("path", "content").mapInArrow(scan, schema)


def sequences(docs: DataFrame, **settings) -> DataFrame:
    """(slot, shard, byte_offset, n_tokens, doc_ids, ids_sha256) of every sequence, read back from the shards."""
    layout, held = write_shards(docs, **settings)
    found = read_back(docs.sparkSession, layout).select("slot", "shard", "byte_offset", F.sha2("record", 256).alias("ids_sha256"))
    return found.join(held, "slot").select("slot", "shard", "byte_offset", "n_tokens", "doc_ids", "ids_sha256")
