"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are cut into bins; every tree is grown level by level from sums of
gradients per (node, feature, bin). The trees are kept as flat arrays (feature, threshold, left,
right, value) and a batch of documents walks through all of them with numpy indexing. Labels come
from a bounded sample: the TRAIN_ROWS labelled rows with the smallest hash of their id, so the same
rows whatever the cluster. Everything else reads all documents; ids, sources, languages and labels
are not features.

Defined cases: a null text counts as empty and empty texts get a score too; null and repeated ids
are scored row by row; rows with null labels or ids are not learned from; without labelled rows
every score is 1, with one class every score is its smoothed share; an empty table gives no rows;
other columns are ignored, or pass untouched through ``accepted``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import fresh, whole_text

#: Labelled rows to learn from at most.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, L2, LEAF_ROWS = 150, 5, 64, 0.1, 1.0, 10

_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_HIGH = np.arange(256) >= 128
_PUNCT = ~(_SPACE | _UPPER | _LOWER | _DIGIT | _HIGH)

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "longest_word", "upper", "digits", "punctuation", "beyond_ascii",
    "white_space", "line_ends", "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "words_per_line",
    "symbol_ends", "stop_ends", "alone_symbols", "capitalised", "all_capitals", "compressed", "byte_entropy", "top_symbol",
    "commas", "short_words", "longest_line", "with_digit",
)


def statistics(text: bytes) -> list[float]:
    """FEATURES of one whole text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / n
    words = text.split()
    m = max(1, len(words))
    lengths = np.array([len(w) for w in words] or [0], np.float64)
    top = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    last = np.bincount(np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8), minlength=256)
    first = np.bincount(np.frombuffer(b"".join([w[:1] for w in words]), np.uint8), minlength=256)
    stops = last[46] + last[33] + last[63]
    used = share[share > 0]
    pairs = len(set(zip(words, words[1:])))
    packed = len(zlib.compress(text[:], 1))
    return [
        np.log1p(n), np.log1p(len(words)), lengths.mean(), lengths.std(), lengths.max(), share[_UPPER].sum(), share[_DIGIT].sum(),
        share[_PUNCT].sum(), share[_HIGH].sum(), share[_SPACE].sum(), share[10], len(top) / m, max(top.values(), default=0) / m,
        1 - pairs / max(1, len(words) - 1), 1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
        (last[_PUNCT].sum() - stops - last[44]) / m, stops / m, sum(c for w, c in top.items() if len(w) == 1 and _PUNCT[w[0]]) / m,
        first[_UPPER].sum() / m, sum(c for w, c in top.items() if len(w) > 1 and w.isupper()) / m, packed / n,
        float(-(used * np.log2(used)).sum()), counts[_PUNCT].max() / n, share[44], float((lengths <= 2).mean()),
        np.log1p(max(map(len, lines), default=0)), sum(c for w, c in top.items() if not w.isalpha() and any(48 <= x <= 57 for x in w)) / m,
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for rows of statistics, all trees walked at once."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        z = np.log(self.base / (1 - self.base)) + self.value[at].sum(1)
        return 1 / (1 + np.exp(-z))


def _bin_edges(column: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log-odds of y (0/1)."""
    n, empty = len(y), np.zeros(0, np.int64)
    base = (y.sum() + 1) / (n + 1) if not y.any() or y.all() else y.mean()
    if not n or not y.any() or y.all():
        base = base if y.any() or not n else 1 / (n + 1)
        return Trees(float(base), empty, empty, empty.astype(float), empty, empty, empty.astype(float), 0)
    edges = [_bin_edges(c) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, z = [], np.full(n, np.log(base / (1 - base)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, 0, 0.0])
        at, level = np.full(n, roots[-1]), [roots[-1]]
        for _ in range(DEPTH):
            level = _split(level, at, binned, edges, g, h, nodes)
            if not level:
                break
        for leaf in np.unique(at):
            own = at == leaf
            nodes[leaf] = [0, 0.0, leaf, leaf, RATE * g[own].sum() / (h[own].sum() + L2)]
        z += np.array([v[4] for v in nodes])[at]
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return Trees(float(base), np.array(roots), feature.astype(np.int64), threshold, left.astype(np.int64), right.astype(np.int64), value, DEPTH)


def _split(level, at, binned, edges, g, h, nodes) -> list[int]:
    """Split the nodes of a level where that gains; moves rows in ``at``, returns the new nodes."""
    place = {node: k for k, node in enumerate(level)}
    k = np.array([place.get(a, -1) for a in range(max(level) + 1)])[np.minimum(at, max(level))]
    rows = np.flatnonzero((k >= 0) & (at <= max(level)))
    best = [(1e-6, None)] * len(level)
    for f, e in enumerate(edges):
        if not len(e):
            continue
        cell = k[rows] * BINS + binned[rows, f]
        sums = [np.bincount(cell, w, len(level) * BINS).reshape(-1, BINS).cumsum(1) for w in (g[rows], h[rows], None)]
        (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
        gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
        gain[(nl < LEAF_ROWS) | (nt - nl < LEAF_ROWS)] = 0
        top = gain[:, : len(e)].argmax(1)
        for j, b in enumerate(top):
            if gain[j, b] > best[j][0]:
                best[j] = (gain[j, b], (f, int(b)))
    out = []
    for j, node in enumerate(level):
        if best[j][1] is None:
            continue
        f, b = best[j][1]
        left = len(nodes)
        nodes[node] = [f, float(edges[f][b]), left, left + 1, 0.0]
        nodes += [[0, 0.0, left, left, 0.0], [0, 0.0, left + 1, left + 1, 0.0]]
        own = rows[k[rows] == j]
        at[own] = np.where(binned[own, f] <= b, left, left + 1)
        out += [left, left + 1]
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def labelled_sample(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids that may be learned from, by the smallest hash of the id; of several labels the least."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    each = usable.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    return each.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", rows: int = TRAIN_ROWS) -> Trees:
    """Trees learned from the statistics of at most ``rows`` labelled documents."""
    sample = F.broadcast(labelled_sample(labels, rows))  # at most TRAIN_ROWS small rows
    known = docs.join(sample, F.col("doc_id") == F.col("labelled_id")).select(
        F.col("doc_id").cast("long"), F.col("quality"), whole_text(text).cast("binary").alias("t")
    )

    def scan(batches):
        for b in batches:
            x = [statistics(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["i", "y", "x"])

    # one row per labelled id: of several documents under one id the one of least statistics
    each = known.mapInArrow(scan, "i long, y int, x array<double>").groupBy("i").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    got = sorted(each.collect())
    return fit_trees(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], np.float64))


def scored(docs: DataFrame, trees: Trees, name: str = "score", *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    key, names = fresh(docs, "quality_text"), docs.columns
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def scan(batches):
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
            score = np.concatenate([sent.value.score(x[at : at + 1000]) for at in range(0, len(x), 1000)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(score, pa.float64())], names=[*names, name])

    return docs.withColumn(key, whole_text(text).cast("binary")).mapInArrow(scan, schema)


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    trees = fit(docs, labels, text=text)
    rows = scored(docs.select("doc_id", F.col(text).alias("text")), trees)
    return rows.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept."""
    name = fresh(docs, "quality_score")
    return scored(docs, fit(docs, labels, text=text), name, text=text).where(F.col(name) >= threshold).drop(name)
