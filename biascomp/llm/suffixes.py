"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Which suffixes start with a string of WINDOW bytes that also starts earlier? Suffixes are sorted one
bucket at a time, each bucket in one task, and equal neighbours tell. What makes that affordable:

* A suffix's bucket follows from its first WINDOW bytes alone: from the smallest hash of the GRAM-byte
  strings in them (its anchor). Equal windows share an anchor, and neighbouring suffixes mostly do
  too, so a run of suffixes travels as one piece of text (its context), not suffix by suffix.
* Anchors are counted first, added up inside parts; a context whose anchor occurs once cannot hold
  a repeated window and is never sent.
* Equal contexts of a part are sent once, with the first place; at all later places of the part every
  byte goes, whatever other parts hold, so those ranges are done and stay out of the buckets.
* Inside a bucket, suffixes are sorted by their first PERIOD bytes. Longer ties are resolved by the
  ranks of a sample: the positions that belong to a difference cover modulo PERIOD, sorted once by
  prefix doubling. For any two residues there is a shift below PERIOD that takes both suffixes to
  sampled positions, so one comparison of two ranks settles a tie of any length. Classes of equal
  residue are merged by binary searches on those ranks; memory is bounded by the bucket.
* An anchor that occurs more than HOT times is split: its suffixes travel in pairs, and a pair's
  bucket follows from the WINDOW - 1 bytes that both hold. So a passage in a third of all documents
  does not put its surroundings into one task. Only the distinct contexts of a part are split.
* Anchors are long: the more bytes a gram has, the fewer grams are frequent without their windows being
  equal, and the less of a growing table is sent, or sent in pairs, for nothing.

Order: smaller doc_id first (null before all), then part and row for rows of equal id, then the
start. Defined cases: a null text is empty; texts shorter than WINDOW keep all; of repeated rows the
first in that order stays; bytes are those of UTF-8 and may be cut inside a character; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import parts_for, table, text_bytes, with_parts

WINDOW, GRAM, SHORT_GRAM = 100, 40, 16
PART_BYTES = 8 << 20
#: Contexts of one anchor beyond which its suffixes are dealt in pairs.
HOT = 4096
# fixed values: every difference modulo 7 is one between two members of 0, 1, 3
PERIOD, COVER = 7, (0, 1, 3)
#: SHIFT[a, b]: least shift that takes residues a and b into the cover.
SHIFT = np.array(
    [[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]
)
_BLOCK = 1 << 18


# -- suffix order of one bucket ------------------------------------------------------------------


def cover_ranks(symbols: np.ndarray, keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of every sampled position among all sampled suffixes; equal suffixes share a rank, 0 elsewhere.

    symbols: bytes plus 1, 0 between texts; keys: first PERIOD symbols as one number; ends: end of
    the text of each position. A suffix ends with its text.
    """
    sampled = np.resize(np.isin(np.arange(PERIOD), COVER), len(symbols))
    at = np.flatnonzero(sampled & (symbols > 0))
    rank = np.zeros(len(symbols), np.int64)
    at = at[np.argsort(keys[at])]
    step, n, key, group = 0, len(at) + 1, keys[at], np.zeros(len(at), np.int64)
    while len(at):
        # a group is cut where its keys change; its number is one more than its first place in the order
        new = np.concatenate([[True], key[1:] != key[:-1]])
        old = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(at))
        first = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
        rank[at] = group + first + (step == 0)
        # only suffixes that are tied and go on beyond what was compared are sorted again
        tied = ~new | ~np.concatenate([new[1:], [True]])
        at = at[tied & (at + step < ends[at])]
        step = 2 * step or PERIOD
        group = rank[at]
        key = group * n + np.where(at + step < ends[at], rank[np.minimum(at + step, len(rank) - 1)], 0)
        order = np.argsort(key)
        at, key, group = at[order], key[order], group[order]
    return rank


def suffix_order(starts: np.ndarray, keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``starts`` in suffix order: by the first PERIOD symbols, ties by the ranks of the cover."""
    _, group = np.unique(keys[starts], return_inverse=True)
    group = group.astype(np.int64) << 32
    residue = starts % PERIOD
    classes, places = [], []
    for r in range(PERIOD):
        own = np.flatnonzero(residue == r)
        own = own[np.argsort(group[own] + rank[starts[own] + SHIFT[r, r]])]
        classes.append((starts[own], group[own]))
        places.append(np.arange(len(own)))
    for a, b in combinations(range(PERIOD), 2):
        # merged by value, with the class in the lowest bit: the class named first leads among equals
        both = [2 * (tied + rank[own + SHIFT[a, b]]) for own, tied in (classes[a], classes[b])]
        from_b = np.sort(np.concatenate([both[0], both[1] + 1])) & 1 == 1
        before = np.cumsum(from_b)
        places[a] += before[~from_b]
        places[b] += np.flatnonzero(from_b) + 1 - before[from_b]
    out = np.empty(len(starts), np.int64)
    for (own, _), place in zip(classes, places):
        out[place] = own
    return out


def _pack(symbols: np.ndarray) -> np.ndarray:
    """First PERIOD symbols from every position, nine bits each."""
    x = np.concatenate([symbols, np.zeros(PERIOD, symbols.dtype)]).astype(np.int64)
    two = (x[:-1] << 9) | x[1:]
    four = (two[:-2] << 18) | two[2:]
    n = len(symbols)
    return (four[:n] << 27) | (two[4 : n + 4] << 9) | x[6 : n + 6]


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position (0 beyond the end) as one number."""
    n = len(data)
    padded = np.zeros((n + 15) // 8 * 8 + 8, np.uint8)
    padded[:n] = data
    out = np.empty(len(padded) - 8, np.uint64)
    for k in range(8):
        out[k::8] = padded[k : k + len(out)].view(np.uint64)
    return out[:n]


def mixed_words(eight: np.ndarray, places: list[slice] | list[np.ndarray]) -> np.ndarray:
    """One hash of the 8-byte words at several places."""
    h = eight[places[0]] * np.uint64(0x9E3779B97F4A7C15)
    for at in places[1:]:
        h ^= h >> np.uint64(32)
        h += eight[at]
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, n: int, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (0 beyond the end) from each of the first ``n`` places on; ``gram`` is a multiple of 8."""
    eight = eight_bytes(np.concatenate([data[: n + gram], np.zeros(max(0, n + gram - len(data)), np.uint8)]))
    return mixed_words(eight, [slice(at, n + at) for at in range(0, gram, 8)])


def window_classes(contexts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, class) of every window of ``window`` bytes; equal windows share a class number.

    In suffix order, neighbours are compared over the whole window, so classes are exact.
    """
    length = np.array([len(c) for c in contexts], np.int64)
    first = np.concatenate([[0], np.cumsum(length + PERIOD)])[:-1]
    data = np.frombuffer(b"".join(c + b"\0" * PERIOD for c in contexts), np.uint8)
    ends = np.repeat(first + length, length + PERIOD)
    symbols = np.where(np.arange(len(data)) < ends, data.astype(np.int16) + 1, 0)
    keys = _pack(symbols)
    n_windows = np.maximum(length - window + 1, 0)
    which = np.repeat(np.arange(len(contexts)), n_windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    starts = first[which] + offset
    order = suffix_order(starts, keys, cover_ranks(symbols, keys, ends))
    eight = eight_bytes(data)
    same, live = np.zeros(len(order), bool), np.arange(1, len(order))
    for at in [*range(0, window - 7, 8), max(window - 8, 0)]:
        live = live[eight[order[live] + at] == eight[order[live - 1] + at]]
    same[live] = True
    number = np.empty(len(data), np.int64)
    number[order] = np.cumsum(~same) - 1
    return which, offset, number[starts]


# -- anchors -------------------------------------------------------------------------------------


def gram_length(window: int) -> int:
    return GRAM if window >= 2 * GRAM else SHORT_GRAM


class Part:
    """The texts of a part in order, and the runs of windows with one anchor."""

    def __init__(self, docs: pa.Table, window: int):
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = docs.column("doc_id").to_pylist()
        texts = [t.encode() for t in docs.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))  # null first, stable
        self.ids, self.texts, self.window = [ids[k] for k in order], [texts[k] for k in order], window
        self.gram = gram_length(window)
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, anchor) of every run, as places in the joined texts."""
        n_windows = np.maximum(self.length - self.window + 1, 0)
        starts, stops, keys = [], [], []
        for at in range(0, len(self.data), _BLOCK):
            anchors, _ = self._anchors(at, min(at + _BLOCK, len(self.data)))
            if not len(anchors):
                continue
            cut = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            begin = np.concatenate([[0], cut])
            starts.append(at + begin)
            stops.append(at + np.concatenate([cut, [len(anchors)]]))
            keys.append(anchors[begin])
        if not starts:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64)
        start, stop, key = np.concatenate(starts), np.concatenate(stops), np.concatenate(keys)
        # a run lies between the first and the last window of the documents it touches
        lo, hi = self.first[:-1], self.first[:-1] + n_windows
        held = np.flatnonzero(n_windows > 0)
        lo, hi = lo[held], hi[held]
        a = np.searchsorted(hi, start, side="right")
        b = np.searchsorted(lo, stop, side="left")
        n = np.maximum(b - a, 0)
        run = np.repeat(np.arange(len(start)), n)
        doc = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        return np.maximum(start[run], lo[doc]), np.minimum(stop[run], hi[doc]) - 1, key[run]

    def grams(self, at: int, stop: int) -> np.ndarray:
        """Hash of the gram from each place on."""
        return gram_hashes(self.data[at : stop + self.gram], stop - at, self.gram)

    def _anchors(self, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(least gram hash of the window at every place of a block that can start one, all gram hashes)."""
        stop = min(stop, len(self.data) - self.window + 1)
        if stop <= at:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        span = self.window - self.gram + 1
        grams = self.grams(at, stop + span - 1)
        return _sliding(grams, span, np.minimum), grams

    def anchor_keys(self) -> np.ndarray:
        """Hash of the gram at every place that is the least of some window, once for each place.

        A gram is at least the anchor of every window that holds it, and an anchor where it equals
        the greatest of them. Windows across texts and places at the edge of a block only add keys.
        """
        span, keys = self.window - self.gram + 1, []
        for at in range(0, len(self.data), _BLOCK):
            least, grams = self._anchors(at, min(at + _BLOCK, len(self.data)))
            if len(least):
                edge = np.zeros(span - 1, np.uint64)
                keys.append(grams[grams == _sliding(np.concatenate([edge, least, edge]), span, np.maximum)])
        return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _sliding(x: np.ndarray, span: int, pick) -> np.ndarray:
    """``pick`` over every stretch of ``span`` values, in doublings."""
    width, out = 1, x
    while 2 * width <= span:
        out, width = pick(out[:-width], out[width:]), 2 * width
    rest, n = span - width, len(x) - span + 1
    return pick(out[:n], out[rest : rest + n])


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key, from its high bits mixed once more: anchors are minima and crowd near 0."""
    return (((keys * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


ANCHOR_SCHEMA = "bucket int, part int, keys binary, counts binary"
REPLY_SCHEMA = "part int, keys binary, hot binary"
CONTEXT_SCHEMA = (
    "bucket int, part int, text binary, length binary, row binary, start binary, doc_id array<long>"
)
RANGE_SCHEMA = "part int, row binary, start binary, stop binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>"


def _raw(table_: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table_.column(name).to_pylist()]


def _groups(values: np.ndarray):
    """(value, places that hold it) for every distinct value."""
    order = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.diff(values[order])) + 1
    for own in np.split(order, cut) if len(order) else ():
        yield int(values[own[0]]), own


def _anchor_rows(window: int, buckets: int):
    def count(docs: pa.Table) -> pa.Table:
        part = docs.column("part")[0].as_py()
        keys, n = np.unique(Part(docs, window).anchor_keys(), return_counts=True)
        rows = [(b, keys[own].tobytes(), np.minimum(n[own], 255).astype(np.uint8).tobytes()) for b, own in _groups(_bucket(keys, buckets))]
        return table(
            {
                "bucket": ([r[0] for r in rows], pa.int32()), "part": ([part] * len(rows), pa.int32()),
                "keys": ([r[1] for r in rows], pa.binary()), "counts": ([r[2] for r in rows], pa.binary()),
            }
        )

    return count


def _repeated(hot: int):
    def pick(rows: pa.Table) -> pa.Table:
        keys, counts = _raw(rows, "keys", np.uint64), _raw(rows, "counts", np.uint8)
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(known))
        out, at = [], 0
        for part, own in zip(rows.column("part").to_pylist(), keys):
            n = total[place[at : at + len(own)]]
            at += len(own)
            if (n > 1).any():
                out.append((part, own[n > 1].tobytes(), (n[n > 1] > hot).tobytes()))
        return table(
            {"part": ([x[0] for x in out], pa.int32()), "keys": ([x[1] for x in out], pa.binary()), "hot": ([x[2] for x in out], pa.binary())}
        )

    return pick


def _context_rows(window: int, buckets: int):
    def send(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not (docs.num_rows and replies.num_rows):
            return _context_table([], [], [], [], [], [], pa.array([], pa.list_(pa.int64())))
        part, texts = docs.column("part")[0].as_py(), Part(docs, window)
        keys, hot = np.concatenate(_raw(replies, "keys", np.uint64)), np.concatenate(_raw(replies, "hot", bool))
        hot = hot[np.argsort(keys)]
        keys = np.sort(keys)
        start, last, anchor = texts.runs()
        at = np.minimum(np.searchsorted(keys, anchor), len(keys) - 1)
        own = np.flatnonzero(keys[at] == anchor)
        start, stop, anchor, split = start[own], last[own] + window, anchor[own], hot[at[own]]
        whole = texts.data.tobytes()
        new = _is_new(whole, start, stop)
        later = [(start[~new], stop[~new])]
        start, stop, anchor, split = start[new], stop[new], anchor[new], split[new]
        bucket = _bucket(anchor, buckets)
        if split.any():
            own = np.flatnonzero(split)
            which, first, last, key = _pairs([whole[s:e] for s, e in zip(start[own].tolist(), stop[own].tolist())], anchor[own], window)
            base = start[own][which]
            first, last = base + first, base + last + window
            new = _is_new(whole, first, last)
            later.append((first[~new], last[~new]))
            start, stop = np.concatenate([start[~split], first[new]]), np.concatenate([stop[~split], last[new]])
            bucket = np.concatenate([bucket[~split], _bucket(key[new], buckets)])
        gone, until = (np.concatenate(x) for x in zip(*later))
        # a row for each bucket, and one for the later places, which passes through a group of its own
        order = np.argsort(bucket, kind="stable")
        start, stop, bucket = start[order], stop[order], bucket[order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        ends = np.concatenate([[0], cut, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
        held = [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        joined = [b"".join([whole[s:e] for s, e in zip(start[x].tolist(), stop[x].tolist())]) for x in held]
        named = bucket[ends[:-1]].tolist()
        row = np.searchsorted(texts.first, start, side="right") - 1
        ids = pa.array(texts.ids, pa.int64()).take(pa.array(row))
        if len(gone):
            named, joined, held = [*named, -1 - part], [*joined, b""], [*held, slice(len(start), len(start) + len(gone))]
            start, stop, ends = np.concatenate([start, gone]), np.concatenate([stop, until]), np.append(ends, ends[-1])
            row = np.searchsorted(texts.first, start, side="right") - 1
        packed = [[values[x].astype(np.int32).tobytes() for x in held] for values in (stop - start, row, start - texts.first[row])]
        return _context_table(named, [part] * len(named), joined, *packed, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids))

    return send


def _context_table(bucket, part, text, length, row, start, ids) -> pa.Table:
    kinds = {"bucket": pa.int32(), "part": pa.int32(), "text": pa.binary(), "length": pa.binary(), "row": pa.binary(), "start": pa.binary()}
    return table({n: (x, k) for (n, k), x in zip(kinds.items(), (bucket, part, text, length, row, start))} | {"doc_id": (ids, ids.type)})


def _is_new(whole: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether each stretch differs from all before it."""
    known: dict[bytes, int] = {}
    first = [known.setdefault(whole[s:e], k) for k, (s, e) in enumerate(zip(start.tolist(), stop.tolist()))]
    return np.array(first, np.int64) == np.arange(len(first))


def _pairs(contexts: list[bytes], anchors: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last, hash of what they share) of the pairs of hot contexts' windows, counted from the anchor on."""
    length = np.array([len(c) for c in contexts], np.int64)
    first, n_windows = np.cumsum(length) - length, length - window + 1
    data = np.frombuffer(b"".join(contexts), np.uint8)
    which = np.repeat(np.arange(len(contexts)), n_windows)
    own = np.arange(len(which)) + np.repeat(first - (np.cumsum(n_windows) - n_windows), n_windows)
    at = np.flatnonzero(gram_hashes(data, len(data), gram_length(window)) == np.repeat(anchors, length))
    p = at[np.searchsorted(at, own)]
    core = p - (p - own) // 2 * 2
    begin = np.flatnonzero(np.diff(core, prepend=-1))
    end = np.append(begin[1:], len(core)) - 1
    core, which = core[begin], which[begin]
    key = mixed_words(eight_bytes(data), [core + k for k in [*range(0, window - 8, 8), window - 9]])
    return which, own[begin] - first[which], own[end] - first[which], key


def _range_rows(window: int):
    def sort(rows: pa.Table) -> pa.Table:
        parts = rows.column("part").to_numpy()
        length, row, start = (_raw(rows, c, np.int32) for c in ("length", "row", "start"))
        sent = np.array([len(x) for x in length])
        length, row, start, part = *(np.concatenate(x).astype(np.int64) for x in (length, row, start)), np.repeat(parts, sent)
        if rows.column("bucket")[0].as_py() < 0:  # later places of a part
            return _range_table(part, row, start, start + length)
        known: dict[bytes, int] = {}
        context, at = [], 0
        for text, n in zip(rows.column("text").to_pylist(), sent.tolist()):
            ends = np.cumsum(length[at : at + n])
            context += [known.setdefault(text[a:b], len(known)) for a, b in zip((ends - length[at : at + n]).tolist(), ends.tolist())]
            at += n
        context = np.array(context, np.int64)
        ids = pc.list_flatten(rows.column("doc_id")).combine_chunks()
        has_id, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        # earliest place of each context, and the number of its document among those of all
        order = np.lexsort((start, row, part, ids, has_id))
        changed = [np.diff(x[order], prepend=x[order[0]]) != 0 for x in (row, part, ids, has_id.astype(np.int8))]
        when = np.empty(len(order), np.int64)
        when[order] = np.cumsum(np.any(changed, axis=0)) << 32
        when += start
        _, first = np.unique(context[order], return_index=True)
        first = order[first]
        which, offset, number = window_classes(list(known), window)
        when = when[first][which] + offset
        earliest = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, number, when)
        later = when != earliest[number]
        edge = np.diff(np.concatenate([[0], later.astype(np.int8), [0]]))
        apart = np.flatnonzero(np.diff(which)) + 1  # runs end with their context
        begins = np.union1d(np.flatnonzero(edge == 1), apart[later[apart]])
        ends = np.union1d(np.flatnonzero(edge == -1), apart[later[apart - 1]])
        held = first[which[begins]]
        rest = np.ones(len(context), bool)
        rest[first] = False  # the same context starts earlier
        return _range_table(
            np.concatenate([part[held], part[rest]]), np.concatenate([row[held], row[rest]]),
            np.concatenate([start[held] + offset[begins], start[rest]]),
            np.concatenate([start[held] + offset[ends - 1] + window, (start + length)[rest]]),
        )

    return sort


def _range_table(part: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """A row for each part, with its (row, start, stop)."""
    groups = list(_groups(part))
    return table(
        {"part": ([p for p, _ in groups], pa.int32())}
        | {n: ([x[own].astype(np.int32).tobytes() for _, own in groups], pa.binary()) for n, x in zip(("row", "start", "stop"), columns)}
    )


def _cut_rows(window: int):
    def cut(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        texts = Part(docs, window)
        cover = np.zeros(len(texts.data) + 1, np.int32)
        for row, start, stop in zip(*(_raw(ranges, c, np.int32) for c in ("row", "start", "stop"))):
            np.add.at(cover, texts.first[row] + start, 1)
            np.add.at(cover, texts.first[row] + stop, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out = []
        for k, text in enumerate(texts.texts):
            own = gone[texts.first[k] : texts.first[k + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).tolist()
            spans = list(zip(edge[::2], edge[1::2]))
            kept = b"".join(text[a:b] for a, b in zip([0, *edge[1::2]], [*edge[::2], len(text)]))
            out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
        return table({"doc_id": (texts.ids, pa.int64())} | {n: ([x[k] for x in out], t) for k, (n, t) in enumerate(zip(names, kinds))})

    return cut


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                   part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans are the removed bytes."""
    parts = parts_for(text_bytes(docs, text), part_bytes)
    own = with_parts(docs, parts, doc_id=doc_id, text=text)
    anchors = own.groupBy("part").applyInArrow(_anchor_rows(window, parts), ANCHOR_SCHEMA)
    replies = anchors.groupBy("bucket").applyInArrow(_repeated(hot), REPLY_SCHEMA)
    buckets = 4 * parts
    contexts = own.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_context_rows(window, buckets), CONTEXT_SCHEMA)
    ranges = contexts.groupBy("bucket").applyInArrow(_range_rows(window), RANGE_SCHEMA)
    return own.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(_cut_rows(window), RESULT_SCHEMA)
