"""Language identification of whole, possibly mixed texts.

Words are maximal runs of letters. The script of a word's first letter narrows its candidate
languages to those seen in that script; a word's score in a language is the log-likelihood of its
letter trigrams (with the word's edges). Viterbi with a penalty per switch labels every word, runs
of equal labels are spans, and the language with most letters in its spans is the document's; the
score is its share of the letters. Trigram counts are learned from every document that may be
learned from, added up inside tasks first.

Viterbi runs word by word only where a switch can pay: if no stretch of words gains more than the
penalty by leaving the best single language, staying in it is the best path (k stretches away cost
at least k penalties), and that is checked with running sums.

Defined cases: null texts and texts without letters are ``und`` with score 0, as is everything if
nothing was learned; ties go to the language that sorts first; null and repeated ids are predicted
row by row; rows with null language or id are not learned from; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import batch
from biascomp.llm.quality import held_out

#: Trigrams are counted in this many hash buckets.
GRAMS = 1 << 17
SWITCH = 15.0
#: Least share of a language's letters for a script to count as one of its scripts.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"

# fixed values: first code point of a run of blocks and the script that starts there
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_FROM = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def word_grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram round each letter, first letter of each word, script of each word)."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_letters()[code], code, 0).astype(np.uint32)
    at = np.flatnonzero(code)
    if not len(at):
        return at, at, at
    padded = np.concatenate([[0], code, [0]]).astype(np.uint32)
    h = padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA77) + padded[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    first = np.flatnonzero(padded[at] == 0)
    script = _SCRIPT[np.searchsorted(_FROM, code[at[first]], side="right") - 1]
    return (h * np.uint32(0x27D4EB2F) >> np.uint32(15)).astype(np.int64), first, script


class Model:
    """Log-likelihood of every trigram bucket in every language, and the languages of every script."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = grams.sum(1, keepdims=True)
        self.table = np.log((grams + 0.5) / (total + 0.5 * GRAMS)).T.astype(np.float32).copy()
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed = (share >= SCRIPT_SHARE).T
        allowed[~allowed.any(1)] = True
        self.barred = np.where(allowed, 0.0, -1e4)

    def labels(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(language of each word as a number, letters of each word)."""
        grams, first, script = word_grams(text)
        if not len(first) or not self.languages:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        letters = np.diff(np.append(first, len(grams)))
        scores = np.add.reduceat(self.table[grams], first, axis=0, dtype=np.float64) + self.barred[script]
        best = int(scores.sum(0).argmax())
        gain = np.cumsum(scores - scores[:, [best]], axis=0)
        low = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]]))
        if _stays(scores, best, (gain - low).max(), SWITCH):
            return np.full(len(first), best), letters
        return viterbi(scores, SWITCH), letters

    def predict(self, text: str | None) -> tuple[str, float]:
        labels, letters = self.labels(text or "")
        if not len(labels):
            return UNKNOWN, 0.0
        held = np.bincount(labels, letters, len(self.languages))
        return self.languages[int(held.argmax())], float(held.max() / held.sum())


def _stays(scores: np.ndarray, best: int, gain: float, penalty: float) -> bool:
    """Whether one language, the best on the whole, is proven to beat every path with a switch.

    A path that uses it pays a penalty for each stretch in another language, which gains at most
    ``gain``; a path that never does pays at least one, and gains at most the best other score of every word.
    """
    others = np.delete(scores, best, axis=1)
    return gain <= penalty and (others.shape[1] < 2 or (others.max(1) - scores[:, best]).sum() <= penalty)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The path of labels with the highest sum of scores less a penalty per switch."""
    n, m = scores.shape
    back, total = np.zeros((n, m), np.int64), scores[0].tolist()
    for k, row in enumerate(scores[1:].tolist(), 1):
        top = max(range(m), key=total.__getitem__)
        switch = total[top] - penalty
        for j in range(m):
            if total[j] >= switch:
                back[k, j], total[j] = j, total[j] + row[j]
            else:
                back[k, j], total[j] = top, switch + row[j]
    path = np.zeros(n, np.int64)
    path[-1] = max(range(m), key=total.__getitem__)
    for k in range(n - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Model:
    """The model of every document with a language that is not held out."""
    usable = docs.where(F.col(lang).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = usable.select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def flush(counts):
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield batch({"lang": ([lang] * len(at), pa.string()), "at": (at, pa.int32()), "n": (c[at], pa.int64())})

    def scan(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams, first, script = word_grams(t)
                if lang not in counts:
                    if len(counts) >= 64:
                        yield from flush(counts)
                        counts = {}
                    counts[lang] = np.zeros(GRAMS + len(SCRIPT_NAMES), np.int64)
                seen, n = np.unique(grams, return_counts=True)
                counts[lang][seen] += n
                counts[lang][GRAMS:] += np.bincount(script, np.diff(np.append(first, len(grams))), len(SCRIPT_NAMES)).astype(np.int64)
        yield from flush(counts)

    # at most one number per language and bucket
    got = rows.mapInArrow(scan, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(languages), GRAMS + len(SCRIPT_NAMES)))
    place = {x: k for k, x in enumerate(languages)}
    which = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
    counts[which, got.column("at").to_numpy()] = got.column("n").to_numpy()
    return Model(languages, counts[:, :GRAMS], counts[:, GRAMS:])


def _run(docs: DataFrame, model: Model, row, schema: str, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: (row(b, sent.value) for b in batches), schema)


def identify(docs: DataFrame, model: Model | None = None, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""

    def row(b, m):
        found = [m.predict(t) for t in b.column(1).to_pylist()]
        return batch({"doc_id": (b.column(0), pa.int64()), "lang_pred": ([x for x, _ in found], pa.string()), "score": ([s for _, s in found], pa.float64())})

    model = model or learn(docs, text=text, lang=lang)
    rows = _run(docs, model, row, "doc_id long, lang_pred string, score double", text)
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def spans(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """(doc_id, spans) with the runs of words of one language as (lang, first_word, n_words)."""
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))

    def runs(t, m):
        labels, _ = m.labels(t or "")
        cut = np.flatnonzero(np.diff(labels, prepend=-1)).tolist()
        return [{"lang": m.languages[labels[a]], "first_word": a, "n_words": b - a} for a, b in zip(cut, [*cut[1:], len(labels)])]

    def row(b, m):
        return batch({"doc_id": (b.column(0), pa.int64()), "spans": ([runs(t, m) for t in b.column(1).to_pylist()], kind)})

    return _run(docs, model, row, "doc_id long, spans array<struct<lang:string,first_word:int,n_words:int>>", text)
