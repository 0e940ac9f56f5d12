"""Periodic runs of words by maximal-pair enumeration over the LCP-interval tree of every text.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at
least max(LEAST, POWER * q) words long, that no neighbouring word extends keeping the period. Its
start s and s + q begin the same words for (length - q) words and differ before and after: a
maximal pair. Every text is taken on its own:

* two equal stretches of a run are at least LEAST - LEAST // POWER words long, so only words that
  begin a repeated stretch of that many words (a polynomial hash finds them; a collision only adds
  work) are sorted; each piece ends with a mark of its own, which no comparison passes;
* prefix doubling sorts their suffixes and Kasai's scan gives the common lengths (LCP);
* the LCP intervals are walked bottom-up. A node of l common words keeps the places of its subtree
  sorted, each with its left word as its class; the smaller child is merged into the larger, and a
  place asks for its neighbours in the other child. If their distance p has (POWER - 1) * p <= l and
  l + p >= LEAST and their classes differ, the pair is maximal and therefore a run. Nothing is
  extended. Only neighbours matter: occurrences so close lie a period apart, and all but the first of
  such a chain have the same left word;
* pairs at a multiple of the period share their run's start and end, so of those the least distance stays.

Places move only from smaller to larger sets, so a text takes O(n log n) steps however periodic it
is. Texts need no shuffle and share nothing: a lost task is computed again by itself.

Defined cases: a null text has no words; empty texts and texts without runs have no runs and keep
all words; repeated rows and ids are taken row by row; ties of the exponent are broken by the
smaller start, then period; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import whole_text

POWER, LEAST = 4, 6
#: Places of one block of a sorted set.
BLOCK = 512
#: Text bytes of one output batch.
BATCH_BYTES = 8 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


class Places:
    """A sorted set of places in blocks, for neighbours and insertion in the root of its size."""

    __slots__ = ("blocks", "tops", "n")

    def __init__(self, first: int):
        self.blocks, self.tops, self.n = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int, int]:
        """The nearest places below and above x (which is not a member); -1 where there is none."""
        k = bisect_left(self.tops, x)
        if k == len(self.tops):
            return self.tops[-1], -1
        block = self.blocks[k]
        at = bisect_left(block, x)
        return (block[at - 1] if at else self.tops[k - 1] if k else -1), block[at]

    def add(self, x: int) -> None:
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[k]
        block.insert(bisect_left(block, x), x)
        self.tops[k] = block[-1]
        self.n += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops[k : k + 1] = [block[BLOCK - 1], block[-1]]


def repeated_starts(ids: np.ndarray, width: int) -> np.ndarray:
    """Places whose next ``width`` words begin at another place too (by hash: perhaps some more)."""
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + x[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.flatnonzero(again)


def pieces(ids: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, place of each) of the stretches that repeated starts cover; every stretch ends with a mark of its own."""
    first = starts[np.flatnonzero(np.diff(starts, prepend=-2) > 1)]
    last = starts[np.flatnonzero(np.diff(starts, append=len(ids) + 2) > 1)] + width
    sizes = last - first + 1
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
    words = ids[np.minimum(place, len(ids) - 1)].astype(np.int64) + len(first)
    words[ends - 1] = np.arange(len(first))
    return words, place


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, rank of each); the words end with a mark that occurs once."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if rank[order[-1]] == n - 1:
            return order, rank
        step *= 2


def common_lengths(words: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """Words that a suffix shares with the one before it in order (Kasai); 0 for the first."""
    n = len(words)
    before = np.where(rank > 0, order[rank - 1], -1).tolist()
    w, out, at, h = words.tolist(), [0] * n, rank.tolist(), 0
    for i in range(n):
        j = before[i]
        if j < 0:
            h = 0
            continue
        while w[i + h] == w[j + h]:  # a mark that occurs once ends every suffix
            h += 1
        out[at[i]] = h
        if h:
            h -= 1
    return out


def _merge(a: Places, b: Places, l: int, left: list[int], power: int, least: int, found: dict) -> Places:
    """The union of two children of a node of ``l`` common words; maximal pairs between them go to ``found``."""
    if a.n < b.n:
        a, b = b, a
    for x in b:
        for y in a.around(x):
            i, p = (x, y - x) if y > x else (y, x - y)
            if y >= 0 and (power - 1) * p <= l and l + p >= least and left[x] != left[y]:
                end = i + l + p
                if p < found.get((i, end), p + 1):
                    found[i, end] = p
    for x in b:
        a.add(x)
    return a


def find_runs(ids: np.ndarray, power: int = POWER, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text given as word numbers, by start, then period."""
    # period q leaves length - q common words, at least the larger of least - q and (power - 1) * q
    width = max(1, min(max(least - q, (power - 1) * q) for q in range(1, least + 1)))
    starts = repeated_starts(ids, width)
    if not len(starts):
        return []
    words, place = pieces(ids, starts, width)
    order, rank = suffix_order(words)
    lcp = common_lengths(words, order, rank)
    left = np.concatenate([[-1], ids]).tolist()  # class of a place: the word before it
    at, found = place[order].tolist(), {}
    stack: list[tuple[int, Places]] = []  # (common words with the next in order, places)
    for k, p in enumerate(at):
        own, l = Places(p), lcp[k + 1] if k + 1 < len(at) else 0
        while stack and stack[-1][0] > l:
            h, node = stack.pop()
            own = _merge(node, own, h, left, power, least, found)
        if l < width:
            continue  # nothing below this node is long enough; its places are let go
        if stack and stack[-1][0] == l:
            own = _merge(stack.pop()[1], own, l, left, power, least, found)
        stack.append((l, own))
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that follow the first period of a run."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        change[s + p] += 1
        change[s + n] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


def number_words(words: list) -> np.ndarray:
    """Numbers of the words; equal words have equal numbers."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", power: int = POWER, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all runs in order, and the text of the words kept, one space apart."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(held):
        ids, n, runs, texts = zip(*held)
        listed = [[{"start": s, "length": k, "period": p} for s, k, p in r] for r in runs]
        arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(listed, kind), pa.array(texts, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])

    def scan(batches):
        held, size = [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                words = t.as_py().split()
                runs = find_runs(number_words(words), power, least)
                held.append((i.as_py(), len(words), runs, b" ".join(collapsed(words, runs))))
                size += len(held[-1][3]) + 64 * len(runs)
                if size >= BATCH_BYTES:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("text"))
    return chosen.mapInArrow(scan, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, a tenth of them (by hash of the id) with a tail that repeats a few of its words.

    With h the CRC32 of the decimal id and g = h // 10, where 10 divides h and the text has n > 0
    words, each word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) // (3 + g % 8).
    Null ids have no decimal and stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = (h - h % 10) / 10
    words = F.regexp_extract_all(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    spread = F.transform(F.array(words), lambda w: _repeat_tail(w, g.cast("long")))  # the words are split once
    return docs.withColumn(text, F.when(h % 10 == 0, F.array_join(F.element_at(spread, 1), " ")).otherwise(F.col(text)))


def _repeat_tail(words: Column, g: Column) -> Column:
    n = F.size(words).cast("long")

    def word(x, i):
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.when(i < a, x).otherwise(F.element_at(words, (a + (i - a) % p + 1).cast("int")))

    return F.transform(words, word)


def strongest(runs: str = "runs") -> Column:
    """The run of the largest length to period (exact), ties by start, then period; null without runs."""

    def better(best, r):
        ahead = r["length"] * best["period"] > best["length"] * r["period"]  # runs come by start, then period
        return F.when(best.isNull() | ahead, r).otherwise(best)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(F.col(runs), none, better)
