"""SimHash near-duplicates: generalised pigeonhole search over 64-bit fingerprints.

The bits are grouped into partitions so that correlated bits stay together, and every partition
gets its own threshold: -1 (not looked at), 0 (equal) or more (within that many bits). If the
thresholds of m partitions add up to max_bits - m + 1, any two fingerprints within max_bits agree
in at least one partition up to its threshold. A dynamic program over the partitions picks the
thresholds with the fewest expected candidates, estimated from the bit and bit-pair counts of all
fingerprints. Candidates from the probes are verified on all 64 bits.

Equal fingerprints are one node. A bucket of more than BUCKET fingerprints is never paired off:
its members look for each other through the values half of max_bits away from them (for an odd
max_bits with one more bit left out). Two fingerprints share such a value if and only if they are
within max_bits, and a value belongs to a fixed number of fingerprints, so this is exact and linear
for any max_bits; the values of a fingerprint are 65 for two bits and grow with max_bits.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; a text of
fewer words than a shingle is one shingle; repeated rows and equal texts share a component; null
ids are named by the component of their fingerprint and never name one unless all are null; an
empty table gives no rows; other columns are ignored, or pass untouched through ``near_dedup``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import batch, fresh, whole_text, written
from biascomp.llm.components import components

BITS, SHINGLE, SEED, MAX_BITS = 64, 3, 42, 2
#: Fingerprints of a bucket that are compared pair by pair; larger buckets take the other way.
BUCKET = 64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits as an unsigned number; a bit is set if more than half of the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts, n = np.concatenate([[0], ends[:-1]]), max(1, len(words) - shingle + 1)
    stops = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), stops)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", row: str | None = None,
                 shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the 64 bits as a signed long. ``row`` names a long column to pass as row."""

    def scan(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64))], names=[*b.schema.names[1:], "fp"])

    more = [] if row is None else [F.col(row).alias("row")]
    rows = docs.select(whole_text(text).cast("binary").alias("text"), F.col(doc_id).cast("long").alias("doc_id"), *more)
    return rows.mapInArrow(scan, "doc_id long, row long, fp long" if more else "doc_id long, fp long")


# -- partitions and thresholds -------------------------------------------------------------------


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for every two bits how many have both; added up inside tasks first."""

    def scan(batches):
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(fps, axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + (x.T @ x).astype(np.int64)
        at = np.arange(BITS * BITS)
        yield batch({"at": ([-1, *at], pa.int32()), "n": ([n, *both.ravel()], pa.int64())})

    rows = dict(nodes.select("fp").mapInArrow(scan, "at int, n long").groupBy("at").agg(F.sum("n")).collect())
    both = np.array([rows.get(k, 0) for k in range(BITS * BITS)], np.float64).reshape(BITS, BITS)
    return int(rows.get(-1, 0)), both


def partition_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each grows from a free bit by the free bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        groups.append(group)
    return groups


def agreement(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Chance that two random fingerprints differ in at most 0..most bits of the group.

    The bits are taken as a chain: how two draws agree on a bit depends on the bit before through
    the joint counts of the two bits.
    """
    ones, n = np.diag(both), max(n, 1)

    def joint(a: int, b: int) -> np.ndarray:
        x = np.array([[n - ones[a] - ones[b] + both[a, b], ones[b] - both[a, b]], [ones[a] - both[a, b], both[a, b]]])
        return (x + 0.5) / (n + 2)

    p = (ones[group[0]] + 0.5) / (n + 1)
    same = p * p + (1 - p) ** 2
    state = np.zeros((most + 2, 2))  # differing bits so far (the last: too many), last bit agrees
    state[0, 1], state[min(1, most + 1), 0] = same, 1 - same
    for a, b in zip(group, group[1:]):
        j = joint(a, b)
        agree_agree = (j**2).sum()
        agree_differ = 2 * (j[0, 0] * j[0, 1] + j[1, 0] * j[1, 1])
        differ_agree = 2 * (j[0, 0] * j[1, 0] + j[0, 1] * j[1, 1])
        differ_differ = 2 * (j[0, 0] * j[1, 1] + j[0, 1] * j[1, 0])
        new = np.zeros_like(state)
        for d in range(most + 2):
            up = min(d + 1, most + 1)
            new[d, 1] += state[d, 1] * agree_agree / (agree_agree + agree_differ)
            new[up, 0] += state[d, 1] * agree_differ / (agree_agree + agree_differ)
            new[d, 1] += state[d, 0] * differ_agree / (differ_agree + differ_differ)
            new[up, 0] += state[d, 0] * differ_differ / (differ_agree + differ_differ)
        state = new
    return np.cumsum(state[: most + 1].sum(1)).tolist()


def ball(width: int, radius: int) -> int:
    size, ring = 1, 1
    for k in range(radius):
        ring = ring * (width - k) // (k + 1)
        size += ring
    return size


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, adding up to ``total``, of least cost; costs[i][t + 1] is that of t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t in range(-1, len(cost) - 1):
                x = (c + cost[t + 1], [*chosen, t])
                if s + t not in new or x < new[s + t]:
                    new[s + t] = x
        best = new
    return best[total]


def search_plan(n: int, both: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe: the number of partitions and thresholds of least cost.

    A threshold costs its expected candidate pairs plus the index entries and probes it needs.
    """
    options = []
    for m in range(1, max_bits + 3):
        groups = partition_bits(n, both, m)
        costs = []
        for g in groups:
            near = agreement(n, both, g, max_bits)
            pairs = n * max(n - 1, 0) / 2
            costs.append([0.0] + [n * (1 + (ball(len(g), t) if t else 0)) + pairs * near[t] for t in range(max_bits + 1)])
        cost, chosen = allocate(costs, max_bits - m + 1)
        options.append((cost, m, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(options, key=lambda x: x[:2])[2]


# -- probe and verify ----------------------------------------------------------------------------


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _flips(bits: list[int], radius: int) -> list[int]:
    """Masks of every change of at most ``radius`` of the bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << b) for m in masks for b in bits}
    out = [m for m in masks if bin(m).count("1") <= radius]
    return sorted(m - (1 << 64) if m >= 1 << 63 else m for m in out)


def _keys(plan, probe: bool) -> Column:
    """Array of (part, key): own partition values, or every value within the partition's threshold."""
    keys = []
    for k, (bits, t) in enumerate(plan):
        for change in _flips(bits, t) if probe else [0]:
            value = F.col("fp").bitwiseXOR(F.lit(change)).bitwiseAND(F.lit(_mask(bits)))
            keys.append(F.struct(F.lit(k).alias("part"), value.alias("key")))
    return F.array(*keys)


def links(nodes: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all within ``max_bits`` bits."""
    n, both = bit_counts(nodes)
    plan = search_plan(n, both, max_bits)
    held = nodes.select("fp", F.explode(_keys(plan, probe=False)).alias("k")).select("fp", "k.part", "k.key")
    probes = held if all(t == 0 for _, t in plan) else (
        nodes.select("fp", F.explode(_keys(plan, probe=True)).alias("k")).select("fp", "k.part", "k.key")
    )
    held, probes = written(held, "simhash-index"), None if probes is held else written(probes, "simhash-probes")
    asked = held if probes is None else probes
    load = asked.groupBy("part", "key").agg(F.count("*").alias("n"))
    hot = load.where(F.col("n") > bucket).select("part", "key")
    cool = load.where((F.col("n") > 1) & (F.col("n") <= bucket)).select("part", "key")
    a = asked.join(cool, ["part", "key"]).withColumnRenamed("fp", "b")
    b = held.join(cool, ["part", "key"]).withColumnRenamed("fp", "a")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    differ = F.col("a") > F.col("b") if probes is None else F.col("a") != F.col("b")
    paired = b.join(a, ["part", "key"]).where(differ & close).select("a", "b")
    crowd = asked.join(hot, ["part", "key"]).unionByName(held.join(hot, ["part", "key"])).select("fp").distinct()
    return written(paired.unionByName(_through_changes(crowd, max_bits)).distinct(), "simhash-links")


def _through_changes(crowd: DataFrame, max_bits: int) -> DataFrame:
    """Links of fingerprints within max_bits: each value half of that away names its smallest fingerprint."""
    left_out = [-1] if max_bits % 2 == 0 else [~_mask([b]) for b in range(BITS)]
    changes = F.array(*[
        F.struct(F.lit(c).alias("change"), F.lit(m).alias("held"))
        for m in left_out for c in _flips([b for b in range(BITS) if m >> b & 1], max_bits // 2)
    ])
    rows = crowd.select("fp", F.explode(changes).alias("k")).select(
        "fp", F.col("k.held").alias("held"), F.col("fp").bitwiseXOR(F.col("k.change")).bitwiseAND(F.col("k.held")).alias("value")
    )
    met = rows.groupBy("held", "value").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all"))
    return met.where(F.size("all") > 1).select(F.explode("all").alias("a"), "b").where("a > b")


def _labelled(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component, component_id) of every fingerprint of ``rows``."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    member = components(links(nodes, max_bits))
    named = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return written(named.join(least, "component").select("fp", "component", "component_id"), "simhash-labels")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS,
                    shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the component is named by its smallest doc_id."""
    rows = written(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    return rows.join(_labelled(rows, max_bits), "fp").select("doc_id", "fp", "component_id")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, written once with a number for every row, and the name of that column."""
    row = fresh(docs, "row_number")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def one_of_each(docs: DataFrame, row: str, found: DataFrame) -> DataFrame:
    """Of ``numbered`` documents one per component, that with the smallest id; ``found`` has (doc_id, row, component)."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    kept = found.groupBy("component").agg(best.alias("best")).select(F.col("best.row").alias(row))
    return docs.join(kept, row).drop(row)


def near_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS,
               shingle: int = SHINGLE) -> DataFrame:
    """The documents, one of each component: that with the smallest id, null ids last (of repeated rows, one)."""
    docs, row = numbered(docs)
    rows = written(fingerprints(docs, doc_id=doc_id, text=text, row=row, shingle=shingle), "fingerprints")
    return one_of_each(docs, row, rows.join(_labelled(rows, max_bits), "fp"))
