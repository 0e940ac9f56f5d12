"""Personal data in whole texts: fixed base spans, and further spans by weak supervision.

Base spans follow fixed rules per kind (email, ip, card, phone) and always stay. Looser proposals
of the same kinds come on top. Labelers vote on every proposal: shape rules (regex), a gazetteer of
name endings, issuer and country prefixes, and cue words in the context. Votes are counted per
pattern over all documents; expectation-maximisation over the patterns estimates how reliable each
labeler is and how likely each pattern is personal data; a logistic span classifier is trained on
those soft labels over shape features and decides about every proposal. Only tables of patterns,
whose size the labelers and features fix, reach the driver.

Positions are code points, ends exclusive. Defined cases: null and empty texts have no spans; null
ids and repeated rows are handled row by row; an added span never overlaps a base span of its kind;
of overlapping additions the one that starts first stays; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import batch, whole_text

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# each digit run is tried once: a later start inside it has the same rest
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from the @ outwards: linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by the fixed rules."""
    found: dict[str, list[tuple[int, int]]] = {"email": emails(text) if "@" in text else []}
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(_at_most_255(p) for p in m[0].split("."))]
    found["card"] = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    found["phone"] = []
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return found


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


# -- proposals, votes and features ---------------------------------------------------------------

# fixed values: cue words before personal data, by kind
CUES = {
    "email": {"email", "e-mail", "mail", "contact", "write", "correo", "courriel", "kontakt", "schreiben"},
    "ip": {"ip", "host", "address", "server", "client", "from", "addr"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "pay", "karte", "carte", "tarjeta"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "cell", "fax", "telefon", "anruf", "teléfono", "téléphone"},
}
# fixed values: common endings of domain names, first digits of card issuers, area-code-like prefixes
ENDINGS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "example"}
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")

_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++ ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}"),
    "ip": re.compile(r"(?<![0-9.:A-Fa-f])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{15})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
}
_HINT = {
    "email": re.compile(r"[(\[ ]at[)\] ]"),
    "ip": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "card": re.compile(r"[0-9]{4}[ -][0-9]{6}|[0-9]{15}"),
    "phone": re.compile(r"[0-9)][ .-][0-9]{3}"),
}
LABELERS = ("strict", "shape", "gazetteer", "context")
FEATURES = 8


def proposals(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, is base): base spans and the looser spans that overlap none of their kind."""
    out = []
    for kind in KINDS:
        out += [(kind, s, e, True) for s, e in base[kind]]
        if _HINT[kind].search(text):
            for m in _LOOSE[kind].finditer(text):
                if not any(s < m.end() and m.start() < e for s, e in base[kind]):
                    out.append((kind, *m.span(), False))
    return out


def votes(text: str, kind: str, start: int, end: int, is_base: bool) -> tuple[int, ...]:
    """1 for, -1 against, 0 no opinion, of each of LABELERS."""
    body = text[start:end]
    digits = "".join(_DIGITS.findall(body))
    before = set(re.findall(r"[^\W\d_-]+", text[max(0, start - 40) : start].lower())[-4:])
    if kind == "email":
        shape, gazetteer = 1 if re.search(r"@|[(\[]at", body) else -1, 1 if re.split(r"[^A-Za-z]+", body.lower())[-1] in ENDINGS else -1
    elif kind == "ip":
        shape, gazetteer = (1 if ":" not in body or body.count(":") == 7 else 0), (-1 if body.startswith(("0.", "127.")) else 0)
    elif kind == "card":
        shape, gazetteer = (1 if luhn(digits) else -1), (1 if digits.startswith(ISSUERS) else -1)
    else:
        shape, gazetteer = (1 if 10 <= len(digits) <= 15 else -1), (1 if body.startswith(("+", "00", "(")) else -1)
    return 1 if is_base else 0, shape, gazetteer, 1 if before & CUES[kind] else 0


def features(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """FEATURES yes/no properties of the span and its edges, without looking at any vote."""
    body = text[start:end]
    digits = sum(c.isdigit() for c in body)
    return (
        int(2 * digits > len(body)), int(" " in body), int("(" in body), int("." in body), int("-" in body),
        int(start > 0 and text[start - 1].isalnum()), int(end < len(text) and text[end].isalnum()), int("@" in body or ":" in body),
    )


# -- estimation ----------------------------------------------------------------------------------


def reliabilities(patterns: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of true spans, P(vote | truth) per labeler, posterior per pattern) by EM.

    patterns: votes -1, 0, 1; n: how often each occurs. Starts from the majority of the votes. A
    labeler without an opinion says nothing about the truth: only votes for and against count.
    """
    post = 1 / (1 + np.exp(-patterns.sum(1).astype(float)))
    prior, table = 0.5, np.ones((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        prior = (w[1].sum() + 1) / (n.sum() + 2)
        for k in range(patterns.shape[1]):
            for v in (-1, 1):
                table[k, :, v + 1] = w[:, patterns[:, k] == v].sum(1) + 0.5
            table[k, :, ::2] /= table[k, :, ::2].sum(1, keepdims=True)
        logs = np.log([[1 - prior], [prior]]) + sum(np.log(table[k][:, patterns[:, k] + 1]) for k in range(patterns.shape[1]))
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return prior, table, post


def logistic(x: np.ndarray, target: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: constant) of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (target - p)) - ridge * w
        w += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def learn(docs: DataFrame, *, text: str = "text") -> dict[str, np.ndarray]:
    """Weights of the span classifier of every kind, from the votes on all proposals of all documents."""

    def scan(batches):
        seen: dict[tuple, int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                for kind, s, e, own in proposals(t, base_spans(t)):
                    key = (kind, votes(t, kind, s, e, own), features(t, kind, s, e))
                    seen[key] = seen.get(key, 0) + 1
        rows = list(seen.items())
        small = pa.list_(pa.int32())
        yield batch(
            {
                "kind": ([k for (k, _, _), _ in rows], pa.string()),
                "votes": ([list(v) for (_, v, _), _ in rows], small),
                "features": ([list(f) for (_, _, f), _ in rows], small),
                "n": ([n for _, n in rows], pa.int64()),
            }
        )

    schema = "kind string, votes array<int>, features array<int>, n long"
    counted = docs.select(whole_text(text)).mapInArrow(scan, schema).groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))
    # one row per kind, vote pattern and feature pattern: bounded by the labelers and features
    rows = sorted(counted.collect(), key=lambda r: (r["kind"], r["votes"], r["features"]))
    weights = {}
    for kind, group in groupby(rows, key=lambda r: r["kind"]):
        group = list(group)
        n = np.array([r["n"] for r in group], float)
        _, _, post = reliabilities(np.array([r["votes"] for r in group]), n)
        weights[kind] = logistic(np.array([r["features"] for r in group], float), post, n)
    return weights


def find(docs: DataFrame, weights: dict[str, np.ndarray] | None = None, *, text: str = "text") -> DataFrame:
    """(doc_id, base, added): lists of spans (kind, start, end) by kind, then start."""
    weights = learn(docs, text=text) if weights is None else weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def spans(t: str) -> tuple[list, list]:
        base = base_spans(t)
        own = [{"kind": k, "start": s, "end": e} for k in KINDS for s, e in base[k]]
        added, last = [], {}
        for k, s, e, is_base in proposals(t, base):
            if not is_base and k in weights and s >= last.get(k, 0):
                if np.dot(weights[k], [*features(t, k, s, e), 1]) > 0:
                    added.append({"kind": k, "start": s, "end": e})
                    last[k] = e
        return own, added

    def scan(batches):
        for b in batches:
            found = [spans(t) for t in b.column(1).to_pylist()]
            yield batch({"doc_id": (b.column(0), pa.int64()), "base": ([x for x, _ in found], kind), "added": ([x for _, x in found], kind)})

    item = "array<struct<kind:string,start:int,end:int>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, base {item}, added {item}")
