"""Spelling variants: words one edit apart, by blocked Gram matrices of letter counts.

Words are counted over all texts. Two words are near if exactly one inserted, deleted or replaced
code point leads from one to the other; then the squared distance of their letter counts is 1
(adjacent lengths) or 2 (equal lengths). The search compares only words of one block:

* the letters are dealt over classes of nearly equal weight. A block is a length and a count per
  class. A word lies, as its short member, in the block of its own counts, and once for every class
  it uses, as a long member, in the block with one letter of that class less. Near words share
  exactly one block in which each is short or has lost the class of the letter that the edit took;
* inside a block NumPy products of the letter counts (Gram matrices) give all squared distances.
  Pairs at 1 (short and long) or 2 (long and long) are verified letter by letter, and a pair counts
  only in the block of its own letters, so it counts once. Only sums per word leave a task;
* the number of classes grows with the vocabulary, which keeps blocks small. A block of more than
  LIMIT members is split: first by single letters in place of classes, then by the word without the
  letter itself. A block of that last kind holds at most 90 words per letter of the word, so no
  member is ever dropped and no block grows with the table.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that
count is at least FACTOR times its own. Counts grow tenfold along forms, so a root is found in as
many doublings as the decimal digits of the largest count have.

Defined cases: null and empty texts have no words; repeated rows count again; an empty table gives
no rows; words are told apart by code points; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import batch, whole_text, written

LEAST_LETTERS, LEAST_COUNT, FACTOR = 7, 2, 10
#: Members of a block that are compared in one Gram matrix; larger blocks are split.
LIMIT = 2048
#: Distinct words that a counting task holds, rows and bytes of blocks taken at a time, and cells of one product.
HELD, ROWS, BYTES, CELLS = 200_000, 1 << 16, 8 << 20, 1 << 21

#: Letter numbers: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
_NUMBER = np.zeros(256, np.int64)
_NUMBER[97:123], _NUMBER[0xC0:] = np.arange(26), np.arange(26, 90)
_HASH = np.random.default_rng(13).integers(0, 1 << 63, 1 << 8, np.uint64) * np.uint64(2) + np.uint64(1)


# -- counting --------------------------------------------------------------------------------------


def planted_deletion(doc_id: int | None, runs) -> list[str]:
    """The runs of a document; one of 31 (by CRC32 of "<doc_id>:<run>") loses the letter at CRC32 modulo its length.

    A null id plants nothing.
    """
    if doc_id is None:
        return list(runs)
    start, out = zlib.crc32(f"{doc_id}:".encode()), []
    for run in runs:
        h = zlib.crc32(run.encode(), start)
        if h % 31 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out.append(run)
    return out


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", edit=None, least: int = LEAST_LETTERS,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of every run of letters, a-z lower-cased, of at least that length and count.

    ``edit`` may turn the distinct runs of a document into others: (doc_id, runs) -> as many results.
    """

    def out(total):
        return batch({"word": (list(total.keys()), pa.string()), "n": (list(total.values()), pa.int64())})

    def scan(batches):
        total: Counter = Counter()
        find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                runs = find(t.as_py().lower().decode())  # bytes lower only A-Z
                if edit is None:
                    total.update(runs)
                else:
                    own = Counter(runs)
                    for word, n in zip(edit(i, own), own.values()):
                        if len(word) >= least:
                            total[word] += n
                if len(total) >= HELD:
                    yield out(total)
                    total = Counter()
        if total:
            yield out(total)

    rows = docs.select(F.col(doc_id).cast("long"), whole_text(text).cast("binary"))
    counted = rows.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def letter_classes(words: DataFrame) -> np.ndarray:
    """Class of each of the 256 code points: letters are dealt, the heaviest first, to the lightest class."""

    def scan(batches):
        mass, n = np.zeros(256, np.int64), 0
        for b in batches:
            mass += np.bincount(np.frombuffer("".join(b.column(0).to_pylist()).encode("latin-1"), np.uint8), minlength=256)
            n += b.num_rows
        yield batch({"at": (np.arange(-1, 256), pa.int32()), "n": ([n, *mass], pa.int64())})

    got = dict(words.select("word").mapInArrow(scan, "at int, n long").groupBy("at").agg(F.sum("n")).collect())  # 257 rows
    classes = max(4, round(2 * np.log10(max(got.get(-1, 0), 1))) - 1)
    load, out = np.zeros(classes), np.zeros(256, np.int64)
    for letter in sorted(range(256), key=lambda a: (-got.get(a, 0), a)):
        out[letter] = load.argmin()
        load[out[letter]] += got.get(letter, 0)
    return out


# -- blocks ----------------------------------------------------------------------------------------

MEMBER = "size int, block long, role int, word string, n long"


def _rows(size, block, role, words, n) -> pa.RecordBatch:
    return batch({"size": (size, pa.int32()), "block": (block, pa.int64()), "role": (role, pa.int32()), "word": (words, pa.string()), "n": (n, pa.int64())})


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words, number of the word of each, length of each word)."""
    sizes = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.repeat(np.arange(len(words)), sizes), sizes


def members(words: DataFrame, classes: np.ndarray) -> DataFrame:
    """MEMBER rows of every word: the short one (role -1), and a long one per class it uses (role: the class)."""
    kinds = int(classes.max()) + 1

    def scan(batches):
        for b in batches:
            own = b.column(0).to_pylist()
            code, row, sizes = _flat(own)
            cls = classes[code]
            whole = np.zeros(len(own), np.uint64)
            np.add.at(whole, row, _HASH[cls])
            used, lost = np.nonzero(np.bincount(row * kinds + cls, minlength=len(own) * kinds).reshape(-1, kinds))
            block = np.concatenate([whole, whole[used] - _HASH[lost]]).view(np.int64)
            at = pa.array(np.concatenate([np.arange(len(own)), used]))
            size, role = np.concatenate([sizes, sizes[used] - 1]), np.concatenate([np.full(len(own), -1), lost])
            yield _rows(size, block, role, b.column(0).take(at), b.column(1).take(at))

    return words.select("word", "n").mapInArrow(scan, MEMBER)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def by_letter(crowd: DataFrame, classes: np.ndarray) -> DataFrame:
    """The members of crowded blocks by single letters: a long one per letter of its class (role: the letter)."""

    def scan(batches):
        for b in batches:
            own, block, role = b.column(3).to_pylist(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            code, row, _ = _flat(own)
            whole = np.zeros(len(own), np.uint64)
            np.add.at(whole, row, _HASH[code] * np.uint64(0x9E3779B97F4A7C15))
            held = np.unique(row[classes[code] == role[row]] * 256 + code[classes[code] == role[row]])
            used, letter = held // 256, held % 256
            short = np.flatnonzero(role < 0)
            at = np.concatenate([short, used])
            key = np.concatenate([whole[short], whole[used] - _HASH[letter] * np.uint64(0x9E3779B97F4A7C15)])
            new = _mix(block[at] + key).view(np.int64)
            role = np.concatenate([np.full(len(short), -1), letter])
            at = pa.array(at)
            yield _rows(b.column(0).take(at), new, role, b.column(3).take(at), b.column(4).take(at))

    return crowd.mapInArrow(scan, MEMBER)


def by_rest(crowd: DataFrame) -> DataFrame:
    """The members of crowded blocks by what is left of the word without the letter of its role, once per result."""

    def scan(batches):
        for b in batches:
            held, size = ([], [], [], [], []), 0
            for length, block, role, word, n in zip(*(c.to_pylist() for c in b.columns)):
                code = np.frombuffer(word.encode("latin-1"), np.uint8)
                power = np.cumprod(np.full(len(code) + 1, _HASH[7], np.uint64))
                head = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_HASH[code] * power[:-1])])
                tail = head[-1] - head[1:]  # with the powers of one place later
                rest = head[-1:] * _HASH[7] if role < 0 else np.unique((head[:-1] * _HASH[7] + tail)[code == role])
                new = _mix(rest ^ np.uint64(block % (1 << 64))).view(np.int64).tolist()
                for column, x in zip(held, (length, None, role, word, n)):
                    column.extend(new if x is None else [x] * len(new))
                size += len(new) * (len(word) + 32)
                if size >= BYTES:
                    yield _rows(*held)
                    held, size = ([], [], [], [], []), 0
            if held[0]:
                yield _rows(*held)

    return crowd.mapInArrow(scan, MEMBER)


# -- Gram matrices and verification ----------------------------------------------------------------


def _candidates(code: np.ndarray, long: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of long members at squared distance 2 (i < j) and of short j and long i at 1, in blocks of equal size.

    ``at`` has the rows of one block per line, -1 where the block is shorter.
    """
    blocks, width = at.shape
    held, row = at >= 0, np.maximum(at, 0)
    letters = code[row.ravel()]
    line, place = np.nonzero(letters)
    x = np.bincount(line * LETTERS + _NUMBER[letters[line, place]], minlength=blocks * width * LETTERS)
    x = x.astype(np.float64 if code.shape[1] > 2000 else np.float32)
    x = x.reshape(blocks, width, LETTERS)
    square = (x * x).sum(2)
    is_long, is_short = held & long[row], held & ~long[row]
    out = []
    for top in range(0, width, max(1, CELLS // (blocks * width))):
        part = slice(top, top + max(1, CELLS // (blocks * width)))
        far = square[:, part, None] + square[:, None] - 2 * np.matmul(x[:, part], x.transpose(0, 2, 1))
        near = (far == 2) & is_long[:, part, None] & is_long[:, None]
        near &= np.arange(width)[None, part, None] < np.arange(width)[None, None]
        near |= (far == 1) & is_long[:, part, None] & is_short[:, None]
        b, i, j = np.nonzero(near)
        out.append((at[b, i + top], at[b, j]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def near_pairs(size: int, block: np.ndarray, role: np.ndarray, code: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows one edit apart, each in the block of its own letters.

    Rows are sorted by block; ``code`` has the size + 1 code points of long members, one less and a 0 of short ones.
    """
    first = np.flatnonzero(np.diff(block, prepend=~block[:1]) != 0)
    count, long = np.diff(np.append(first, len(block))), role >= 0
    many = (count > 1) & (np.add.reduceat(long, first) > 0)
    first, count = first[many], count[many]
    pairs = []
    for width in sorted({1 << int(c - 1).bit_length() for c in count}):
        chosen = np.flatnonzero((count <= width) & (count > width // 2))
        each = max(1, min(CELLS // width**2, CELLS // (width * max(LETTERS, code.shape[1]))))
        for k in range(0, len(chosen), each):
            own = chosen[k : k + each]
            at = first[own, None] + np.arange(width)
            pairs.append(_candidates(code, long, np.where(np.arange(width) < count[own, None], at, -1)))
    verified = []
    for i, j in pairs:
        for k in range(0, len(i), max(1, BYTES // (size + 1))):
            a, b = i[k : k + max(1, BYTES // (size + 1))], j[k : k + max(1, BYTES // (size + 1))]
            x, y, both = code[a], code[b], long[b]
            differ = x != y
            at = differ.argmax(1)
            line = np.arange(len(a))
            replaced = both & (differ.sum(1) == 1) & (classes[x[line, at]] == role[a]) & (classes[y[line, at]] == role[b])
            head = np.logical_and.accumulate(~differ[:, :size], axis=1).sum(1)
            tail = np.logical_and.accumulate((x[:, 1:] == y[:, :size])[:, ::-1], axis=1).sum(1)
            inserted = ~both & (head + tail >= size) & (classes[x[line, head]] == role[a])
            verified.append((a[replaced | inserted], b[replaced | inserted]))
    return tuple(np.concatenate([p[c] for p in verified] or [np.zeros(0, np.int64)]) for c in (0, 1))


def _edges(t: pa.Table) -> np.ndarray:
    """First rows of the blocks."""
    size, block = t.column(0).to_numpy(), t.column(1).to_numpy()
    return np.flatnonzero(np.append(True, (size[1:] != size[:-1]) | (block[1:] != block[:-1])))


NEAR = "word string, n_near long, top_n long, top string"


def near_words(blocks: DataFrame, classes: np.ndarray) -> DataFrame:
    """NEAR rows: for every member with near words in its block, their number and the one of largest count."""

    def solve(size, block, role, words, n):
        code = np.frombuffer(pa.array(words).cast(pa.string()).to_numpy(zero_copy_only=False).astype(f"U{size + 1}").tobytes(), np.uint32)
        code = code.reshape(-1, size + 1).astype(np.uint8)
        i, j = near_pairs(size, block, role, code, classes)
        if not len(i):
            return None
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.lexsort((code.view(f"S{size + 1}").ravel(), -n))  # largest count, then smallest in code-point order
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        best = np.full(len(n), len(n))
        np.minimum.at(best, a, place[b])
        with_near = np.flatnonzero(best < len(n))
        top = order[best[with_near]]
        return batch({
            "word": (words.take(pa.array(with_near)), pa.string()), "n_near": (np.bincount(a, minlength=len(n))[with_near], pa.int64()),
            "top_n": (n[top], pa.int64()), "top": (words.take(pa.array(top)), pa.string()),
        })

    def scan(batches):
        held, rows = [], 0
        for b in batches:
            held, rows = [*held, b], rows + b.num_rows
            if rows >= ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                edges = _edges(t)
                yield from parts(t, edges)  # the last block may go on
                held = t.slice(edges[-1]).to_batches()
                rows -= int(edges[-1])
        if rows:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from parts(t, np.append(_edges(t), rows))

    def parts(t, edges):
        size = t.column(0).to_numpy()
        at, n = 0, len(edges) - 1
        while at < n:
            own = int(size[edges[at]])
            most = edges[at] + max(1, min(ROWS, BYTES // (own + 1)))
            same = np.searchsorted(size, own, side="right")
            to = max(at + 1, int(np.searchsorted(edges, min(most, same), side="right")) - 1)
            columns = [c.combine_chunks() for c in t.slice(edges[at], edges[to] - edges[at]).columns[1:]]
            found = solve(own, columns[0].to_numpy(), columns[1].to_numpy(), columns[2], columns[3].to_numpy())
            if found is not None:
                yield found
            at = to

    dealt = blocks.repartition("size", "block").sortWithinPartitions("size", "block")
    return dealt.mapInArrow(scan, NEAR)


def _search(blocks: DataFrame, classes: np.ndarray, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(near words in blocks of at most ``limit`` members, the members of the other blocks if there are any)."""
    load = blocks.groupBy("size", "block").agg(F.count("*").alias("load")).where(F.col("load") > limit)
    hot = written(load.select("size", "block"), "spelling-hot")
    if hot.isEmpty():
        return near_words(blocks, classes), None
    on = ["size", "block"]
    return near_words(blocks.join(hot, on, "left_anti"), classes), blocks.join(hot, on, "left_semi").select(*blocks.columns)


def near_counts(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n, n_near, top_n, top) of every word of (word, n): its near words and the one of largest count."""
    classes, letters = letter_classes(words), np.arange(256)
    near, crowd = _search(written(members(words, classes), "spelling-blocks"), classes, limit)
    found = [near]
    if crowd is not None:
        near, crowd = _search(written(by_letter(crowd, classes), "spelling-letters"), letters, limit)
        found += [near] if crowd is None else [near, near_words(by_rest(crowd), letters)]
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:long,top:string>").alias("best"))
    for f in found:
        best = F.struct((-F.col("top_n")).alias("less"), F.col("top"))
        rows = rows.unionByName(f.select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("best")))
    each = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return each.select("word", "n", "n_near", (-F.col("best.less")).alias("top_n"), F.col("best.top").alias("top"))


def _follow(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, twice as far in every round."""
    at = forms.withColumnRenamed("form", "root")
    while steps > 1:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        steps = -(-steps // 2)
    return at


def variants(words: DataFrame, *, factor: int = FACTOR, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n)."""
    words = written(words, "spelling-words")
    found = near_counts(words, limit)
    leads: Column = F.col("top_n") >= factor * F.col("n")
    found = written(found.select("word", "n", "n_near", F.when(leads, F.col("top")).alias("form"), F.when(leads, F.col("top_n")).alias("form_n")), "spelling-forms")
    most = found.agg(F.max("n")).first()[0] or 1
    steps = sum(factor**k <= most for k in range(1, 20))  # a form has at least factor times the count
    roots = _follow(found.where("form is not null").select("word", "form"), steps)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", edit=None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    return variants(word_counts(docs, doc_id=doc_id, text=text, edit=edit))
