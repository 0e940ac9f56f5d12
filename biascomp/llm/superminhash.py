"""Near-duplicates by SuperMinHash: documents whose sets of five-word shingles have a Jaccard index of 0.85 or more.

* Signature: every shingle draws, rank by rank, a place of its own random permutation of the places
  and a value that begins with the rank; a place keeps the least value. The places that a shingle
  reaches are correlated (all different), so the estimate varies less than that of independent
  minima, and a document stops at the first rank above all of its values. All documents of a batch
  go through one rank at a time in NumPy; permutations are never stored, only the swaps so far.
* Banding: BANDS keys of ROWS places each. A pair at 0.85 meets in no band with a chance of 5e-7.
* Rounds: every member of a bucket is compared with two of its members (least and largest digest), and
  after grouping what is linked, members outside the bucket's largest group with PICKS members of that
  group. Only members of groups that are still different are then compared with each other, by
  their whole signatures, a byte a place, block by block, and a pair is listed in its first common band
  only. Buckets where that would be more than WORK comparisons, which a passage shared by very many
  documents makes, are split by other bands of the signature first. No member is dropped, and no pair is
  listed unless its signatures agree in ALIKE of all places (a pair at 0.85 falls short of that with a
  chance below 1e-6) and the low 16 or 32 bits of all shingles of both leave the index possible, which
  no linked pair fails: what is listed is linked but for few.
* Verification: every listed pair is decided on the whole sets (64-bit hashes of the shingles of both
  texts, 100 * common >= 85 * all), so no link is wrong. Only texts that are asked for are read again.
* Grouping: union-find over the links of a task first, then rounds over what the tasks found.

Equal sets are one node. A group of very many documents that are alike but not linked is the case
that is not linear: they are compared, in blocks, though not listed.

Defined cases: null texts and texts without words have no shingles, are linked with nothing and name
themselves; fewer words than a shingle are one shingle; repeated rows and equal texts share a
component; null ids are named by their component's smallest id and never name one unless all are
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import batch, whole_text, written
from biascomp.llm.components import components

SHINGLE, PERCENT, SEED = 5, 85, 42
BANDS, ROWS, PLACES, ALIKE = 25, 5, 200, 140
#: Places of the bands that split crowded buckets: they cut across the first ones.
ACROSS = np.arange(PLACES).reshape(ROWS, -1).T
#: Members of the largest group that others are compared with, comparisons of a bucket without a split, members of a block.
PICKS, WORK, BLOCK = 6, 1 << 24, 2048
#: Shingles up to which 16 bits of each are compared.
WIDE = 4096
#: Asked digests (24 bytes each) that may be broadcast; more are joined by a shuffle.
SENT = 500_000
#: Pairs that one copy of a text is sent for; shingles of one batch; links that a task groups at a time.
FAN, BATCH, LINKS = 1000, 1 << 19, 1 << 20

_draw = np.random.default_rng(SEED)
_FACTOR = _draw.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = 40  # bits of a value below its rank


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, known: dict, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += h[k : k + n] * _FACTOR[k]
    return np.unique(_mix(out))


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash: the least value of every place, one line per (not empty) set."""
    least = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for at in range(0, len(element), BATCH):
        x, own, swaps = element[at : at + BATCH], owner[at : at + BATCH], []
        for rank in range(places):
            own_max = least[own[0] : own[-1] + 1].max(1)
            going = own_max[own - own[0]] >= np.uint64(rank << _SHIFT)  # a place may still get less
            if not going.all():
                x, own, swaps = x[going], own[going], [s[going] for s in swaps]
                if not len(x):
                    break
            z = _mix(x + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            swap = (rank + ((z >> np.uint64(40)) * np.uint64(places - rank) >> np.uint64(24)).astype(np.int64)).astype(np.int32)
            place = swap.copy()
            for k in range(rank - 1, -1, -1):  # where the swaps so far have moved the place drawn
                np.copyto(place, k, where=swaps[k] == place)
            swaps.append(swap)
            value = np.uint64(rank << _SHIFT) | (z & np.uint64((1 << _SHIFT) - 1))
            np.minimum.at(least.reshape(-1), own * places + place, value)
    return least


def band_keys(least: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (a line of places), different from band to band."""
    parts = least[:, places]
    key = np.tile(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), (len(least), 1))
    for k in range(places.shape[1]):
        key = _mix(key * _FACTOR[8 + k] + parts[:, :, k])
    return key.view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """One byte per place."""
    return (_mix(least) & np.uint64(255)).astype(np.uint8)


FIRST = np.arange(BANDS * ROWS).reshape(BANDS, ROWS)
SKETCH = "doc_id long, digest binary, node binary, mark long, n long, keys array<long>, more array<long>, sketch binary"


def sketches(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """SKETCH rows of every document; without shingles node, keys and sketch are null.

    ``digest`` names the text, ``node`` the set, ``mark`` is a short form of the node for finding
    buckets; ``keys`` are the bands, ``more`` those that cut across them.
    """

    def rows(held):
        ids, texts, sets = zip(*held)
        full = [k for k, s in enumerate(sets) if len(s)]
        least = signatures([sets[k] for k in full]) if full else np.zeros((0, PLACES), np.uint64)
        digests = [hashlib.md5(t, usedforsecurity=False).digest() for t in texts]
        nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        place = np.full(len(sets), -1)
        place[full] = np.arange(len(full))
        index = pa.array(place, mask=place < 0)

        def lists(places):
            flat = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(least, places).ravel()), len(places))
            return flat.cast(pa.list_(pa.int64())).take(index)

        short = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in nodes]
        marks = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PLACES), len(full), [None, pa.py_buffer(sketch(least).tobytes())])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.binary()), pa.array(short, pa.int64()),
             pa.array([len(s) for s in sets], pa.int64()), lists(FIRST), lists(ACROSS), marks.cast(pa.binary()).take(index)],
            names=[c.split()[0] for c in SKETCH.split(", ")],
        )

    def scan(batches):
        known, held, size = _Words(), [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                raw = t.as_py()
                held.append((i.as_py(), raw, shingles(raw, known, shingle)))
                size += len(held[-1][2]) + 100
                if size >= BATCH:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("text"))
    return chosen.mapInArrow(scan, SKETCH)


# -- candidates ------------------------------------------------------------------------------------


def alike(nodes: DataFrame, pairs: DataFrame, on: str = "node", percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes, given by their column ``on``, whose sizes allow the index and whose signatures agree in ALIKE places."""

    def scan(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array((x == y).sum(1) >= ALIKE))

    def side(x):
        return nodes.select(F.col(on).alias(x), F.col("node").alias(f"node_{x}"), F.col("n").alias(f"of_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("of_a", "of_b") >= percent * F.greatest("of_a", "of_b"))
    return both.select("node_a", "node_b", "sketch_a", "sketch_b").mapInArrow(scan, "a binary, b binary")


def _groups(company: DataFrame, links: DataFrame) -> DataFrame:
    """(key, band, node, component, most, strays, load) of every member of a bucket with more than one component.

    ``most`` is the bucket's largest component, ``strays`` the number of members outside it.
    """
    member = components(forest(links))
    named = company.join(member, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("size"))
    most = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("load"), F.count("*").alias("parts"))
    most = most.where("parts > 1").select("key", F.col("most.component").alias("most"), (F.col("load") - F.col("most.size")).alias("strays"), "load")
    return written(named.join(most, "key"), "near-mixed")


def _picked(mixed: DataFrame) -> DataFrame:
    """(a, b): every stray with PICKS members of its bucket's largest component, chosen by hash."""
    chosen = [F.min_by("node", F.xxhash64("node", F.lit(t))).alias(f"p{t}") for t in range(PICKS)]
    picks = mixed.where("component = most").groupBy("key").agg(*chosen)
    strays = mixed.where("component != most").join(picks, "key")
    return strays.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array(*[f"p{t}" for t in range(PICKS)]))).alias("b")).distinct()


def _blocks(of: DataFrame) -> DataFrame:
    """Rows (bucket, ..., load) dealt to (bucket, i, j): all pairs of blocks, of about BLOCK members each."""
    parts = F.ceil(F.col("load") / BLOCK).cast("int")
    own = of.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    return own.withColumn("ij", F.explode(met)).select("bucket", "ij.i", "ij.j", "own", "band", "across", "node", "component")


def images(found: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, image) from (node, text): the low bits of all shingles, 16 of them up to WIDE shingles and else 32."""

    def scan(batches):
        known = _Words()
        for b in batches:
            sets = (shingles(t.as_py(), known, shingle) for t in b.column(1))
            image = [s.astype(np.uint16 if len(s) <= WIDE else np.uint32).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(image, pa.binary())], names=["node", "image"])

    return found.mapInArrow(scan, "node binary, image binary")


def _low(image: bytes, n: int, wide: bool) -> np.ndarray:
    bits = np.frombuffer(image, np.uint16 if n <= WIDE else np.uint32)
    return bits if wide else bits.astype(np.uint16)


def possible(image: bytes, n: int, others: list[bytes], sizes: list[int], percent: int = PERCENT) -> list[bool]:
    """Whether a set may reach the index with each of the others: as if all equal bits were equal shingles."""
    held: dict[bool, np.ndarray] = {}
    out = []
    for other, size in zip(others, sizes):
        wide = n > WIDE and size > WIDE
        if wide not in held:
            held[wide] = np.unique(_low(image, n, wide))
        common = int(np.isin(_low(other, size, wide), held[wide], kind=None if wide else "table").sum())
        out.append(100 * common >= percent * (n + size - common))
    return out


def compared(mixed: DataFrame, nodes: DataFrame, found: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that sizes, signatures and images allow, each once."""
    heavy = F.col("strays") * F.col("load") > WORK
    light = mixed.where(~heavy).select(F.col("key").alias("bucket"), "band", F.lit(-1).alias("across"), "node", "component", "load")
    split = mixed.where(heavy).join(nodes.select("node", F.posexplode("more").alias("across", "k")), "node")
    split = split.select(F.xxhash64("key", "k").alias("bucket"), "band", "across", "node", "component")
    load = split.groupBy("bucket").agg(F.count("*").alias("load"), F.min("component").alias("p"), F.max("component").alias("q"))
    split = split.join(load.where("p != q").select("bucket", "load"), "bucket")

    def pairs(t):
        size, own = t.column("n").to_numpy(), t.column("own").to_numpy()
        component = t.column("component").to_numpy()
        marks = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, PLACES)
        image = t.column("image")
        i, j, band, across = (t.column(c)[0].as_py() for c in ("i", "j", "band", "across"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = []
        for k in left.tolist():
            other = right if i != j else right[right > k]
            other = other[(component[other] != component[k]) & (100 * np.minimum(size[other], size[k]) >= percent * np.maximum(size[other], size[k]))]
            if not len(other):
                continue
            same = marks[other] == marks[k]
            first = same[:, FIRST].all(2).argmax(1) == band  # a later band lists the pair no more
            if across >= 0:
                first &= same[:, ACROSS].all(2).argmax(1) == across
            other = other[first & (same.sum(1) >= ALIKE)].tolist()
            if other:
                may = possible(image[k].as_py(), int(size[k]), [image[x].as_py() for x in other], size[other].tolist(), percent)
                out += [(k, x) for x, ok in zip(other, may) if ok]
        node = t.column("node")
        for at in range(0, len(out), LINKS):
            a, b = zip(*out[at : at + LINKS])
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], names=["a", "b"])

    def edges(t):
        keys = np.array([t.column(c).to_numpy() for c in group])
        return [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]

    def whole(t, ends):
        for a, b in zip(ends, ends[1:]):
            if b - a > 1:
                yield from pairs(t.slice(a, b - a).combine_chunks().to_batches()[0])

    def scan(batches):
        held = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 4 * BLOCK:
                t = pa.Table.from_batches(held).combine_chunks()
                ends = edges(t)
                yield from whole(t, ends)
                held = t.slice(ends[-1]).to_batches()  # the last group may go on
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from whole(t, [*edges(t), t.num_rows])

    group = ["bucket", "i", "j"]
    asked = found.join(mixed.select("node").distinct(), "node", "left_semi")
    held = written(images(asked, shingle).join(nodes.select("node", "n", "sketch"), "node"), "near-images")
    rows = _blocks(light.unionByName(split)).join(held, "node")
    rows = rows.select(*group, "own", "band", "across", "node", F.xxhash64("component").alias("component"), "n", "sketch", "image")
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(scan, "a binary, b binary")


# -- verification ----------------------------------------------------------------------------------


def texts_of(docs: DataFrame, asked: DataFrame, *, text: str = "text") -> DataFrame:
    """(node, text) of the asked (node, digest): one of the texts of each node, read again from the documents."""
    asked = written(asked, "near-asked")
    few = F.broadcast(asked) if asked.count() <= SENT else asked
    named = docs.select(F.unhex(F.md5(whole_text(text))).alias("digest"), whole_text(text).cast("binary").alias("text"))
    # equal texts, any of them
    return written(named.join(few, "digest").groupBy("node").agg(F.first("text").alias("text")), "near-texts")


def verified(found: DataFrame, pairs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets, by their texts (node, text), reach the index."""
    pairs = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-pairs")
    # a text that very many pairs ask for goes out once for every FAN of them
    fan = pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
    dealt = pairs.join(fan, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("fan")).cast("int")).drop("fan")
    hubs = found.toDF("b", "text_b").join(fan, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
    both = dealt.join(found.toDF("a", "text_a"), "a").join(hubs, ["b", "salt"]).sortWithinPartitions("b", "salt")

    def scan(batches):
        known, last = _Words(), (None, None)
        for b in batches:
            keep = []
            for hub, x, y in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                if last[0] != hub:
                    last = hub, shingles(y.as_py(), known, shingle)
                own, other = shingles(x.as_py(), known, shingle), last[1]
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("a", "b", "text_a", "text_b").mapInArrow(scan, "a binary, b binary"), "near-links")


# -- grouping --------------------------------------------------------------------------------------


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) as a forest per task: union-find over up to LINKS links, one link per node to its root."""

    def scan(batches):
        root: dict[bytes, bytes] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def flush():
            links = [(x, find(x)) for x in root]
            a, b = zip(*((x, r) for x, r in links if x != r)) if links else ((), ())
            return batch({"a": (a, pa.binary()), "b": (b, pa.binary())})

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = sorted((find(x), find(y)))
                root[y] = x
            if len(root) >= LINKS:
                yield flush()
                root.clear()
        if root:
            yield flush()

    return links.mapInArrow(scan, "a binary, b binary")


def near_links(docs: DataFrame, nodes: DataFrame, *, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between nodes that connect all pairs that reach the index."""
    index = nodes.select("mark", F.posexplode("keys").alias("band", "key"))
    buckets = index.groupBy("key").agg(F.count("*").alias("load"), F.min("mark").alias("p"), F.max("mark").alias("q"))
    company = written(index.join(buckets.where("load > 1"), "key"), "near-company")
    held = nodes.join(company.select("mark").distinct(), "mark", "left_semi")
    held = written(held, "near-held")
    found = texts_of(docs, held.select("node", "digest"), text=text)

    def check(pairs):
        return verified(found, pairs, shingle=shingle, percent=percent)

    first = company.select(F.col("mark").alias("a"), F.explode(F.array("p", "q")).alias("b")).where("a != b")
    links = check(alike(held, first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "mark", percent))
    company = company.select("key", "band", "mark").join(held.select("mark", "node"), "mark")
    mixed = _groups(company, links)
    links = links.unionByName(check(alike(held, _picked(mixed), percent=percent)))
    mixed = _groups(company.join(mixed.select("key").distinct(), "key", "left_semi"), links)
    return links.unionByName(check(compared(mixed, held, found, shingle=shingle, percent=percent)))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; the component is named by its smallest doc_id."""
    rows = written(sketches(docs, doc_id=doc_id, text=text, shingle=shingle), "near-sketches")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min("digest").alias("digest"), *[F.first(c).alias(c) for c in ("mark", "n", "keys", "more", "sketch")]
    )
    nodes = written(nodes, "near-nodes")
    member = components(forest(near_links(docs, nodes, text=text, shingle=shingle, percent=percent)))
    named = nodes.select("node", "least").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = written(named.join(least, "component").select("node", "component_id"), "near-labels")
    own: Column = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = rows.select("doc_id", "n", "node").join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

