"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a run of whole documents inside one task. Its words become numbers of the benchmark's
vocabulary (0 for a word no item has), and the shard's suffix array holds every suffix that starts
inside a run of benchmark words long enough for the shortest window: no other suffix can begin
with one. Every benchmark suffix is binary-searched in every shard; the interval of suffixes that
start with a window gives its occurrences, the neighbours of the insertion point the longest match.
Nothing is shuffled: the benchmark goes to the shards in blocks of bounded size, one pass a block.

Defined cases: null and empty texts have no words; an item without words is no item; items with
equal ids count once; a null item id is left out of the lists of items; repeated rows, null doc ids
and ties are reported row by row; an empty benchmark hits nothing; other columns pass untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import batch, fresh, whole_text

WINDOW = 10
#: Text bytes of one shard, and benchmark text bytes of one broadcast block.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 16 << 20

#: Words in lower-cased UTF-8: digits, a-z and every byte of a character beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

HIT_SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>"
MATCH_SCHEMA = "item_id string, item_pos int, doc_id long, doc_pos int, n_words int"


def words(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


def suffix_array(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of the suffixes of ``ids``; a suffix ends at its first 0.

    Prefix doubling over all positions: the rank of twice the length is the rank of (rank here,
    rank one length on), and 0 stays 0.
    """
    rank, n = ids.astype(np.int64), len(ids)
    run = _run_lengths(ids)
    step, distinct = 1, 0
    while True:
        ahead = np.zeros(n, np.int64)
        if step < n:
            ahead[:-step] = rank[step:]
        ahead[run < step] = 0  # a run that ends inside this length compares no further
        seen, new = np.unique(rank * (ahead.max(initial=0) + 1) + ahead, return_inverse=True)
        rank, step = new + (0 if seen[0] == 0 else 1), 2 * step
        if len(seen) == distinct or step >= n:
            break
        distinct = len(seen)
    return starts[np.argsort(rank[starts], kind="stable")]


def _run_lengths(ids: np.ndarray) -> np.ndarray:
    """Non-zero words from each position on."""
    n = len(ids)
    stop = np.where(ids == 0, np.arange(n), n)
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


class Benchmark:
    """A block of items: its words as numbers, every suffix, and the windows to look for."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        text: list[int] = []
        self.suffixes: list[tuple[str | None, int, int]] = []  # item, place in it, place in text
        windows: dict[tuple[int, ...], set] = {}
        for item, body in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(body)]
            self.suffixes += [(item, i, len(text) + i) for i in range(len(ids))]
            text += [*ids, 0]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.text = np.array(text + [0], np.int32)
        self.windows = list(windows)
        self.items = [sorted(x for x in s if x is not None) for s in windows.values()]
        self.shortest = min(map(len, self.windows), default=0)


class ShardIndex:
    """The suffix array of some documents' words against one block of the benchmark."""

    def __init__(self, texts: list[bytes | None], bench: Benchmark):
        get = bench.vocabulary.get
        lists = [[get(w, 0) for w in words(t)] for t in texts]
        self.n_words = np.array([len(x) for x in lists], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words + 1)]).astype(np.int64)
        ids = np.zeros(int(self.first[-1]) + 1, np.int32)
        for at, x in zip(self.first, lists):
            ids[at : at + len(x)] = x
        keep = _run_lengths(ids) >= max(1, bench.shortest)
        if bench.shortest:
            # the rest of a run that holds a kept suffix is part of that suffix
            held = np.zeros(len(ids) + 1, np.int64)
            at = np.flatnonzero(keep)
            np.add.at(held, at, 1)
            np.add.at(held, np.minimum(at + bench.shortest, len(ids)), -1)
            inside = np.cumsum(held[:-1]) > 0
        else:
            inside = np.zeros(len(ids), bool)
        self.place = np.flatnonzero(inside | np.concatenate([[False], inside[:-1]]))  # runs, each with its end
        self.ids = np.where(inside, ids, 0)[self.place] if len(self.place) else np.zeros(0, np.int32)
        self.ids = np.append(self.ids, 0).astype(np.int32)
        starts = np.flatnonzero(keep[self.place]) if len(self.place) else np.zeros(0, np.int64)
        self.sa = suffix_array(self.ids, starts) if len(starts) else starts

    def _compare(self, at: np.ndarray, text: np.ndarray, q: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of shard suffixes against query suffixes over ``length`` words, and the words shared."""
        order, shared = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
        live, k = np.flatnonzero(length > 0), 0
        while len(live):
            a = self.ids[np.minimum(at[live] + k, len(self.ids) - 1)]
            b = text[np.minimum(q[live] + k, len(text) - 1)]
            order[live] = np.sign(a.astype(np.int64) - b)
            same = (a == b) & (a != 0)
            k += 1
            shared[live[same]] = k
            live = live[same & (length[live] > k)]
        return order, shared

    def search(self, text: np.ndarray, q: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of all queries at once: how many suffixes are below (or not above) each."""
        low, high = np.zeros(len(q), np.int64), np.full(len(q), len(self.sa), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            order, _ = self._compare(self.sa[mid], text, q[open_], length[open_])
            right = order <= 0 if upper else order < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


def _mark(index: ShardIndex, bench: Benchmark, items: list[set]) -> np.ndarray:
    """Which words of the shard lie inside an occurrence; adds the items that occur to ``items``."""
    cover = np.zeros(int(index.first[-1]) + 1, np.int64)
    if bench.windows and len(index.sa):
        length = np.array([len(w) for w in bench.windows])
        at = np.concatenate([[0], np.cumsum(length)[:-1]])
        text = np.array([x for w in bench.windows for x in w], np.int32)
        low, high = (index.search(text, at, length, upper) for upper in (False, True))
        for w in np.flatnonzero(high > low):
            places = index.place[index.sa[low[w] : high[w]]]
            np.add.at(cover, places, 1)
            np.add.at(cover, places + length[w], -1)
            for d in np.unique(index.doc_of(places)):
                items[d].update(bench.items[w])
    return np.cumsum(cover)[:-1] > 0


def _longest(index: ShardIndex, bench: Benchmark, ids: list):
    """For every benchmark suffix, the document place that shares most words with it, if any does."""
    if not bench.suffixes or not len(index.sa):
        return
    q = np.array([s[2] for s in bench.suffixes])
    length = _run_lengths(bench.text)[q]
    above = index.search(bench.text, q, length, upper=False)
    best, where = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    for near in (above - 1, above):
        near = np.clip(near, 0, len(index.sa) - 1)
        _, shared = index._compare(index.sa[near], bench.text, q, length)
        better = shared > best
        best[better], where[better] = shared[better], index.place[index.sa[near[better]]]
    doc = index.doc_of(where)
    for k in np.flatnonzero(best):
        item, pos, _ = bench.suffixes[k]
        yield item, pos, ids[doc[k]], int(where[k] - index.first[doc[k]]), int(best[k])


def _shards(batches):
    """Documents in runs of bounded size, as (ids, texts)."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= SHARD_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list:
    """The benchmark, broadcast in blocks of at most BLOCK_BYTES (or one item)."""
    send = benchmark.sparkSession.sparkContext.broadcast
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("binary")).where(F.col(text).isNotNull())
    blocks, block, size = [], [], 0
    for item, body in rows.toLocalIterator():
        block.append((item, bytes(body)))
        size += len(body)
        if size >= BLOCK_BYTES:
            blocks.append(send(block))
            block, size = [], 0
    return [*blocks, send(block)] if block or not blocks else blocks


def _scan(docs: DataFrame, doc_id: str, text: str, fn, schema: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long"), whole_text(text).cast("binary")).mapInArrow(fn, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids) of every document row, in one pass without a shuffle."""
    blocks = _blocks(benchmark, item_id, item_text)

    def scan(batches):
        for ids, texts in _shards(batches):
            hit, found = False, [set() for _ in texts]
            for block in blocks:
                bench = Benchmark(block.value, window)
                index = ShardIndex(texts, bench)
                hit = hit | _mark(index, bench, found)
            total = np.concatenate([[0], np.cumsum(hit)])
            yield batch(
                {
                    "doc_id": (ids, pa.int64()),
                    "n_words": (index.n_words, pa.int64()),
                    "n_hit": (total[index.first[1:]] - total[index.first[:-1]], pa.int64()),
                    "item_ids": ([sorted(x) for x in found], pa.list_(pa.string())),
                }
            )

    return _scan(docs, doc_id, text, scan, HIT_SCHEMA)


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, shortest: int = WINDOW, doc_id: str = "doc_id",
                    text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, item_pos, doc_id, doc_pos, n_words): the longest verbatim match of every benchmark suffix.

    One row per suffix that shares at least ``shortest`` words with some document; of equally long
    matches the one with the smallest (doc_id, doc_pos).
    """
    blocks = _blocks(benchmark, item_id, item_text)

    def scan(batches):
        for ids, texts in _shards(batches):
            for block in blocks:
                bench = Benchmark(block.value, shortest)
                bench.shortest = shortest
                rows = list(_longest(ShardIndex(texts, bench), bench, ids))
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                    names = ("item_id", "item_pos", "doc_id", "doc_pos", "n_words")
                    yield batch({n: (list(v), k) for n, v, k in zip(names, zip(*rows), kinds)})

    found = _scan(docs, doc_id, text, scan, MATCH_SCHEMA).where(F.col("n_words") >= shortest)
    best = F.min(F.struct(-F.col("n_words"), "doc_id", "doc_pos")).alias("m")
    return found.groupBy("item_id", "item_pos").agg(best).select(
        "item_id", "item_pos", "m.doc_id", "m.doc_pos", (-F.col("m.col1")).alias("n_words")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text",
                   item_text: str = "text") -> DataFrame:
    """The documents without any hit word, all columns kept; decided row by row inside the scan."""
    blocks = _blocks(benchmark, "item_id", item_text)
    names, key = docs.columns, fresh(docs, "bench_text")

    def scan(batches):
        for b in batches:
            texts, clean = b.column(len(names)).to_pylist(), []
            for _, run in _shards([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), b.column(len(names))], names=["i", "t"])]):
                hit = False
                for block in blocks:
                    bench = Benchmark(block.value, window)
                    index = ShardIndex(run, bench)
                    hit = hit | _mark(index, bench, [set() for _ in run])
                total = np.concatenate([[0], np.cumsum(hit)])
                clean += (total[index.first[1:]] == total[index.first[:-1]]).tolist()
            yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names).filter(pa.array(clean, pa.bool_()))

    return docs.withColumn(key, whole_text(text).cast("binary")).mapInArrow(scan, docs.schema)
