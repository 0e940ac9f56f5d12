"""The operators on small awkward inputs, each against a plain version of the same rule."""

import hashlib
import re
import zlib
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from biascomp.llm import chunks, cuckoo, decontaminate, langid, mixing, periodic, pii, quality, simhash, spelling, suffixes, superminhash, tokenshards
from biascomp.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, fp long"

A = "the quick brown fox jumps over the lazy dog and runs far away from the barking crowd of angry village people today"
B = "un texte assez long pour être répété plusieurs fois dans la même collection de documents sans aucune autre raison que cela"
ROWS = [
    (1, A, "en", "a"),
    (2, A, "en", "a"),
    (2, A, "en", "a"),
    (3, None, None, None),
    (None, B, "fr", "b"),
    (5, "", "en", "b"),
    (6, "x", None, "a"),
    (7, f"{A} {B} " * 40, "fr", "c"),
    (8, B.upper(), "fr", None),
    (9, "ab" * 400, "en", "c"),
    (10, f"prefix {A} suffix", "en", "a"),
    (11, " \n\t ", "en", "a"),
    (-4, f"ü {A}", "en", "a"),
    (13, "z" * 99, "en", "é"),
    (14, "z" * 100, "en", "é"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, 0 if t is None else len(t), 0.5, 1, 2) for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return (i is not None, i or 0)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# -- exact deduplication ---------------------------------------------------------------------


def test_exact_dedup_against_groups(docs):
    got = cuckoo.exact_dedup(docs).collect()
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(ROWS)
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(own) and r.keep_id == max(own, key=key) and r.doc_id in own
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_of_nothing(nothing):
    assert cuckoo.exact_dedup(nothing).count() == 0


def test_index_inserts_and_deletes(spark):
    first = cuckoo.digests(spark.createDataFrame([(i, f"text {i % 700}") for i in range(1500)], "doc_id long, text string"))
    index = cuckoo.update(cuckoo.empty_index(spark), 3, first)
    gone = first.where("doc_id < 100").select("text_sha256")
    index = cuckoo.update(index, 3, deletes=gone)
    assert cuckoo.entries(index).count() == 600
    more = cuckoo.digests(spark.createDataFrame([(9000, "text 5"), (9001, "text 200")], "doc_id long, text string"))
    after = {r.keep_id: r.group_size for r in cuckoo.entries(cuckoo.update(index, 3, more)).collect()}
    assert after[9000] == 1 and after[9001] == 3 and len(after) == 601


def test_filter_has_no_false_negatives_and_grows():
    shard = cuckoo.Shard()
    live = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(3000)]
    for d in live:
        shard.insert(d, (True, 1, 1), 1)
    assert shard.filter.n > 4 and all(d in shard.filter and shard.has(d) for d in live)
    for d in live[::2]:
        shard.delete(d)
    assert all(shard.has(d) for d in live[1::2]) and not any(shard.has(d) for d in live[::2])


# -- mixing ----------------------------------------------------------------------------------


def test_mix_targets_and_copies(spark, docs):
    plan = mixing.mix_plan(docs).collect()
    sizes = {}
    for i, t, _, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        rest, share = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else weight[s] * rest / share for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    by_size = {(sizes[s], round(target[s], 6)) for s in order}
    assert len(plan) == len(ROWS)
    assert all((r.source_size, round(r.target, 6)) in by_size and r.taken <= 3 * r["size"] for r in plan)
    assert rows_of(mixing.mix_plan(docs), "doc_id", "taken") == rows_of(mixing.mix_plan(docs.repartition(5)), "doc_id", "taken")


def test_mixed_rows_follow_the_plan(docs):
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixing.mix_plan(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + len((r.text or "").split())
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in seen.items() if v}


def test_mix_comes_near_its_targets(spark):
    rows = [(k, "w " * (20 + k % 50), f"s{k % 4 if k % 3 else 0}") for k in range(8000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in plan.groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert abs(r["sum(taken)"] / r.target - 1) < 0.05


def test_documents_without_ids_draw_one_by_one(spark):
    rows = [(None, f"some words of text {k}", "a") for k in range(900)] + [(k, "w " * 40, "b") for k in range(900)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = plan.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 2 and all(abs(r.taken - r.target) < 0.1 * r.target for r in got)


def test_mix_of_nothing(nothing):
    assert mixing.mix_plan(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


# -- decontamination -------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items, window=10):
    words, hit, found = plain_words(text), set(), set()
    for item, body in items:
        own = plain_words(body)
        n = min(window, len(own))
        for k in range(len(own) - n + 1) if own else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[k : k + n]:
                    hit |= set(range(p, p + n))
                    found |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(found)


ITEMS = [
    (1, A), (2, "Villages PEOPLE today"), (2, "people TODAY"), (3, None), (4, "..."), (None, "lazy dog"), (5, B[10:90]), (6, "ab" * 400),
    (10, "nothing of this kind is found in any of the texts at all"),
]


@pytest.mark.parametrize("block", [16 << 20, 30])
def test_contamination_against_all_windows(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 300)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows_of(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "item_ids")
    assert got == sorted(((i, *plain_hits(t, ITEMS)) for i, t, *_ in ROWS), key=repr)
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert rows_of(clean, "doc_id") == sorted(((i,) for i, t, *_ in ROWS if not plain_hits(t, ITEMS)[1]), key=repr)


def test_longest_matches(spark, docs):
    bench = spark.createDataFrame([(1, f"something {A} else")], "item_id long, text string")
    found = {r.item_pos: r for r in decontaminate.longest_matches(docs, bench).collect()}
    n = len(A.split())
    assert found[1].n_words == n and (found[1].doc_id, found[1].doc_pos) == (-4, 1)
    assert found[n - 9].n_words == 10 and n - 8 not in found and 0 not in found


def test_contamination_of_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(nothing, none).count() == 0
    assert decontaminate.contamination(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminated(docs, none).count() == len(ROWS)
    assert decontaminate.longest_matches(docs, none).count() == 0


# -- suffix arrays ---------------------------------------------------------------------------


def plain_removed(rows, window):
    """(doc_id, bytes, removed, spans, digest) with windows in a set; rows in order."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"part_bytes": 400}, {"part_bytes": 400, "hot": 1}])
def test_removed_bytes_against_all_windows(docs, settings):
    got = rows_of(suffixes.remove_repeats(docs, **settings), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain_removed(sorted(((i, t) for i, t, *_ in ROWS), key=lambda r: key(r[0])), 100)


def test_removed_bytes_of_random_texts(spark):
    draw = np.random.default_rng(5)
    pieces = ["".join(draw.choice(list("abcé"), draw.integers(20, 200))) for _ in range(12)]
    rows = [(k, "".join(draw.choice(pieces, draw.integers(0, 9)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.remove_repeats(df, part_bytes=3000, hot=5)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_removed(rows, 100)


def sent_of_one_part(texts, hot):
    """(bytes of text, places) that a part sends to the buckets."""
    docs = pa.table({"part": pa.array([0] * len(texts), pa.int32()), "doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    replies = suffixes._repeated(hot)(suffixes._anchor_rows(100, 1)(docs))
    rows = suffixes._context_rows(100, 4)(docs, replies).to_pylist()
    rows = [r for r in rows if r["bucket"] >= 0]
    return sum(len(r["text"]) for r in rows), sum(len(r["row"]) // 4 for r in rows)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_a_part_sends_a_repeated_passage_once(hot):
    passage = "".join(np.random.default_rng(8).choice(list("abcdefgh "), 600))
    assert sent_of_one_part([passage] * 300, hot) == sent_of_one_part([passage] * 2, hot)


def test_a_frequent_phrase_in_different_surroundings_is_not_sent():
    draw = np.random.default_rng(9)
    texts = ["".join(draw.choice(list("abcdefgh "), 90)) + " on the other hand it is " + "".join(draw.choice(list("abcdefgh "), 90)) for _ in range(200)]
    assert sent_of_one_part(texts, 10_000) == (0, 0)


def test_settled_suffixes_are_not_sorted_again(monkeypatch):
    """One long tie does not bring the suffixes that are already apart into every round."""
    rng = np.random.default_rng(5)
    twin = rng.integers(1, 250, 4000).astype(np.uint8).tobytes()
    contexts = [twin, twin[:-1] + b"\xff", *(rng.integers(0, 256, 200).astype(np.uint8).tobytes() for _ in range(500))]
    length = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(c + b"\0" * suffixes.PERIOD for c in contexts), np.uint8)
    ends = np.repeat(np.cumsum(length + suffixes.PERIOD) - suffixes.PERIOD, length + suffixes.PERIOD)
    symbols = np.where(np.arange(len(data)) < ends, data.astype(np.int16) + 1, 0)
    keys, worked = suffixes._pack(symbols), []
    for name in ("argsort", "unique"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, *a, plain=plain, **k: worked.append(len(x)) or plain(x, *a, **k))
    rank = suffixes.cover_ranks(symbols, keys, ends)
    assert sum(worked) < 2 * np.count_nonzero(rank)


def test_suffix_order_is_the_true_one():
    draw = np.random.default_rng(1)
    contexts = [bytes(draw.choice(2, draw.integers(1, 60)).astype(np.uint8)) for _ in range(40)] + [b"\0" * 50, b"\0" * 50]
    length = np.array([len(c) for c in contexts])
    first = np.concatenate([[0], np.cumsum(length + 7)])[:-1]
    data = np.frombuffer(b"".join(c + b"\0" * 7 for c in contexts), np.uint8)
    ends = np.repeat(first + length, length + 7)
    symbols = np.where(np.arange(len(data)) < ends, data.astype(np.int16) + 1, 0)
    starts = np.flatnonzero(symbols)
    keys = suffixes._pack(symbols)
    order = suffixes.suffix_order(starts, keys, suffixes.cover_ranks(symbols, keys, ends))
    tails = [bytes(data[s : ends[s]]) for s in order]
    assert sorted(order) == sorted(starts) and tails == sorted(tails)


def test_nothing_is_removed_from_nothing(nothing):
    assert suffixes.remove_repeats(nothing).count() == 0


# -- chunks ----------------------------------------------------------------------------------


def test_chunks_cover_the_text_and_resist_insertions():
    text = np.random.default_rng(2).integers(97, 123, 50_000).astype(np.uint8).tobytes()
    ends = chunks.chunk_ends(text)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes[:-1].min() >= chunks.MIN_CHUNK and sizes.max() <= chunks.MAX_CHUNK
    moved = chunks.chunk_ends(b"inserted" + text)
    assert len({e + 8 for e in ends} & set(moved)) > 0.95 * len(ends)


def test_gear_hash_is_its_sum():
    data = np.random.default_rng(3).integers(0, 256, 100).astype(np.uint8)
    want = [sum(int(chunks.GEAR[data[i - j]]) << j for j in range(min(32, i + 1))) % 2**32 for i in range(len(data))]
    assert chunks.gear_hash(data).tolist() == want


def test_substring_dedup_against_a_set(docs):
    seen, want = set(), []
    for i, t in sorted(((i, t) for i, t, *_ in ROWS), key=lambda r: key(r[0])):
        b, start, marks = (t or "").encode(), 0, bytearray()
        for end in chunks.chunk_ends(b):
            marks += (b"x" if b[start:end] in seen else b".") * (end - start)
            seen.add(b[start:end])
            start = end
        gone = [m.span() for m in re.finditer(b"x+", marks) if len(m[0]) in range(chunks.MIN_RUN, len(b)) or len(m[0]) == len(b)]
        kept = bytes(c for at, c in enumerate(b) if not any(s <= at < e for s, e in gone))
        want.append((i, len(b), hashlib.sha256(kept).hexdigest()))
    got = chunks.substring_dedup(docs)
    assert rows_of(got, "doc_id", "n_bytes", "kept_sha256") == sorted(want, key=repr)
    assert next(r for r in got.collect() if r.doc_id == 2 and r.n_removed).first_docs


def test_short_stretches_of_repeated_chunks_stay():
    assert chunks.long_runs([], []) == []
    assert chunks.long_runs([20], [True]) == [True]  # a whole text, however short
    assert chunks.long_runs([20, 40, 60, 100], [True, False, True, True], 56) == [False, False, True, True]
    assert chunks.long_runs([20, 75, 95], [True, True, False], 76) == [False, False, False]
    assert chunks.long_runs([20, 40], [True, True], 56) == [True, True]


def test_short_passages_in_other_texts_are_found():
    draw = np.random.default_rng(13)
    words = ["".join(chr(c) for c in draw.integers(97, 123, draw.integers(2, 10))) for _ in range(3000)]
    missed, gone, size = 0, 0, 0
    for _ in range(400):
        before, passage, after = (" ".join(draw.choice(words, n)) for n in (60, 51, 60))
        first, second = f"{after} {passage} {before}".encode(), f"{before} {passage} {after}".encode()
        known = {first[s:e] for ends in [chunks.chunk_ends(first)] for s, e in zip([0, *ends], ends)}
        at, end = len(before) + 1, len(before) + 1 + len(passage)
        ends = chunks.chunk_ends(second)
        runs = chunks.long_runs(ends, [second[s:e] in known for s, e in zip([0, *ends], ends)])
        lost = sum(e - s for s, e, gone in zip([0, *ends], ends, runs) if at <= s and e <= end and gone)
        missed, gone, size = missed + (lost == 0), gone + lost, size + len(passage)
    assert missed <= 0.06 * 400 and gone >= 0.6 * size, (missed, gone / size)


def test_no_chunks_in_nothing(nothing):
    assert chunks.substring_dedup(nothing).count() == 0


# -- SimHash ---------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, most=2):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_against_all_pairs(docs):
    ids, fps = [r[0] for r in ROWS], [plain_fingerprint(r[1]) for r in ROWS]
    group = plain_components(fps)
    least = {}
    for i, g in zip(ids, group):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = sorted(((i, fp - (1 << 64) if fp >> 63 else fp, least[g]) for i, fp, g in zip(ids, fps, group)), key=repr)
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == want
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == sorted(((x,) for x in set(least.values())), key=repr)


def test_rows_are_kept_by_row_and_not_by_id(spark):
    rows = [(None, A), (None, B), (None, A + " " + B), (None, A), (7, A), (5, B.upper() + " x y z"), (5, "quite another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root = plain_components([plain_fingerprint(t) for _, t in rows])
    groups = [[r for r, g in zip(rows, root) if g == k] for k in sorted(set(root))]
    want = sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups), key=repr)
    got = simhash.near_dedup(df).collect()
    assert sorted((r.doc_id for r in got), key=repr) == want and want.count(None) > 1 and want.count(5) == 2
    assert all(any((r.doc_id, r.text) in g for r in got) for g in groups)


@pytest.mark.parametrize("most, bucket", [(2, 64), (2, 1), (0, 4), (1, 4), (1, 64), (3, 2)])
def test_links_of_crowded_fingerprints(spark, most, bucket):
    draw = np.random.default_rng(bucket)
    centres = draw.integers(0, 2**63, 5)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in draw.integers(0, 62, draw.integers(0, 4))) for c in centres for _ in range(60)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    linked = simhash.links(nodes, most, bucket)
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= most for r in linked.collect())
    member = {r.node: r.component for r in components(linked).collect()}
    group = plain_components(fps, most)
    assert [member.get(f, f) for f in fps] == [fps[g] for g in group]


def test_thresholds_keep_the_pigeonhole_and_unequal_ones_win():
    n, both = 10**6, np.full((64, 64), 250_000.0) + np.diag(np.full(64, 250_000.0))
    for most in (1, 2, 3):
        plan = simhash.search_plan(n, both, most)
        assert len({b for bits, _ in plan for b in bits}) == sum(len(bits) for bits, _ in plan)
    cost, chosen = simhash.allocate([[0, 9, 9, 9], [0, 1, 2, 50], [0, 1, 30, 90]], 0)
    assert chosen == [-1, 1, 0] and cost == 3
    assert abs(simhash.agreement(n, both, list(range(20)), 1)[0] / 2**-20 - 1) < 0.01


def test_no_fingerprints_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.near_dedup(nothing).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(k, 0) for k in range(61)} | {(100, 100), (101, 100)}


# -- quality ---------------------------------------------------------------------------------


def test_trees_learn_a_rule_and_score_alike_one_by_one():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit_trees(x, y)
    score = trees.score(x)
    assert ((score > 0.5) == y).mean() > 0.97 and score.min() >= 0 and score.max() <= 1
    assert np.allclose([trees.score(r[None])[0] for r in x[:50]], score[:50])


def test_quality_of_awkward_texts(spark, docs, nothing):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, *_) in enumerate(ROWS)] + [(77, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.classify(nothing, labels).count() == 0
    none = labels.where("false")
    assert {r.score for r in quality.classify(docs, none).collect()} == {1.0}
    assert quality.accepted(docs, none).columns == docs.columns


def test_quality_learns_the_same_from_repeated_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    once, often = quality.fit(df, labels, rows=60), quality.fit(df.union(df).union(df), labels.union(labels), rows=60)
    x = np.array([quality.statistics(r.text.encode()) for r in df.limit(50).collect()])
    assert np.array_equal(once.score(x), often.score(x))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = found.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


# -- languages -------------------------------------------------------------------------------


def test_viterbi_finds_the_best_path():
    draw = np.random.default_rng(6)
    scores = draw.normal(size=(6, 3)) * 3
    best = max(np.ndindex(*(3,) * 6), key=lambda p: sum(scores[k, s] for k, s in enumerate(p)) - 2 * sum(a != b for a, b in zip(p, p[1:])))
    assert tuple(langid.viterbi(scores, 2.0)) == best


def test_languages_of_mixed_text(spark, docs, nothing):
    cyr = "это простой русский текст без всяких латинских слов и он повторяется снова"
    rows = [(100 + k, t, lang) for k in range(60) for t, lang in ((A, "en"), (B, "fr"), (cyr, "ru"))]
    model = langid.learn(spark.createDataFrame([(i * 7 + k, t, x) for k, (i, t, x) in enumerate(rows)], "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr", "ru"]
    assert model.predict(cyr)[0] == "ru" and model.predict(f"{A} {A} {B}")[0] == "en" and model.predict("12 34")[0] == "und"
    mixed = spark.createDataFrame([(1, f"{A} {B} {A}"), (2, None)], "doc_id long, text string")
    spans = {r.doc_id: [(s.lang, s.n_words) for s in r.spans] for r in langid.spans(mixed, model).collect()}
    assert [x for x, _ in spans[1]] == ["en", "fr", "en"] and spans[2] == []
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.lang_pred for r in got if r.doc_id in (3, 5, 11)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(nothing).count() == 0


def test_languages_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = langid.identify(df).where("held_out").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98


def test_staying_is_the_best_path_where_it_is_proven():
    draw = np.random.default_rng(8)
    cases = [np.array([[14.0, -100, 0], [-100, 14, 0]])]
    cases += [draw.normal(size=(n, 3)) * draw.choice([0.5, 2, 4]) + [draw.choice([0, 1]), 0, 0] for n in (2, 5, 30) for _ in range(200)]
    stayed = []
    for scores in cases:
        best = int(scores.sum(0).argmax())
        gain = np.cumsum(scores - scores[:, [best]], axis=0)
        low = np.minimum.accumulate(np.concatenate([np.zeros((1, 3)), gain[:-1]]))
        stayed.append(langid._stays(scores, best, (gain - low).max(), 6.0))
        path = langid.viterbi(scores, 6.0)
        value = scores[np.arange(len(scores)), path].sum() - 6 * (np.diff(path) != 0).sum()
        assert not stayed[-1] or abs(value - scores[:, best].sum()) < 1e-9
    assert not stayed[0] and 50 < sum(stayed) < len(cases)


# -- personal data ---------------------------------------------------------------------------


def plain_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_against_the_patterns():
    draw = np.random.default_rng(9)
    pieces = ["a@b.c", "@", ".", "x.y", "1.2.3.4", "300.1.1.1", "0001.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111112", "+1 (771) 555-1655",
              "+", " ", "-", "é", "12", "%", "foo@bar", "@b.c@d.e.f", "+12", "(", "a@b..c", "²", "٣.٣.٣.٣"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces, draw.integers(0, 9)))
        found = pii.base_spans(text)
        assert [(k, s, e) for k in pii.KINDS for s, e in found[k]] == plain_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.base_spans(text)
        pii.proposals(text, pii.base_spans(text))


def test_weak_supervision_adds_spans_and_keeps_the_base(spark, docs, nothing):
    rows = [(k, f"please call 771 555 {1000 + k} or +1 (771) 555-{1000 + k} or write john{k}@mail.com today") for k in range(60)]
    rows += [(500, None), (None, "a@b.c"), (501, "é 4111 1111 1111 1111")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert [(s.kind, s.start, s.end) for s in got[i].base] == plain_base(t or "")
        base = {(s.kind, p) for s in got[i].base for p in range(s.start, s.end)}
        assert not any((s.kind, p) in base for s in got[i].added for p in range(s.start, s.end))
    assert [s.kind for s in got[7].added] == ["phone"]
    assert pii.find(docs).count() == len(ROWS) and pii.find(nothing).count() == 0


def test_reliabilities_find_the_bad_labeler():
    draw = np.random.default_rng(10)
    truth = draw.random(4000) < 0.4
    vote = np.stack([np.where(draw.random(4000) < q, truth, ~truth) * 2 - 1 for q in (0.9, 0.85, 0.5)], 1)
    patterns, n = np.unique(vote, axis=0, return_counts=True)
    prior, table, post = pii.reliabilities(patterns, n.astype(float))
    assert abs(prior - 0.4) < 0.08 and table[0, 1, 2] > 0.8 and abs(table[2, 1, 2] - 0.5) < 0.1


# -- token shards ----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    got = tokenshards.feistel(np.arange(n), n, 7)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 100 or (got != tokenshards.feistel(np.arange(n), n, 8)).mean() > 0.9


def test_shards_hold_every_id_once_in_slot_order(spark, docs, tmp_path):
    import base64

    import tiktoken

    layout, held = tokenshards.write_shards(docs, seq_len=16, shard_sequences=20, folder=str(tmp_path / "s"))
    with open(tokenshards.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=tokenshards.PATTERN, mergeable_ranks=ranks, special_tokens={})
    files = sorted((tmp_path / "s" / "shards").glob("part-*"))
    assert len(files) == layout.n_shards
    assert all(f.stat().st_size == layout.stride * 20 for f in files[:-1])
    data = b"".join(f.read_bytes() for f in files)
    by_slot = [np.frombuffer(data[k : k + 32], "<u2") for k in range(0, len(data), layout.stride)]
    stream = np.concatenate([by_slot[s] for s in tokenshards.feistel(np.arange(layout.n_sequences), layout.n_sequences, layout.key)])
    texts = sorted(tuple(x) for x in np.split(stream, np.flatnonzero(stream == layout.end_id) + 1) if len(x) > 1)
    assert texts == sorted(tuple(plain.encode_ordinary(t)) + (layout.end_id,) for _, t, *_ in ROWS if t)
    back = tokenshards.read_back(spark, layout, 15, 45).collect()
    assert sorted(r.slot for r in back) == list(range(15, 45))
    for r in back:
        assert bytes(r.record) == by_slot[r.slot].tobytes()
        at = r.shard * 20 + r.byte_offset // layout.stride
        assert at == r.slot
    rows = held.collect()
    assert sum(r.n_tokens for r in rows) == sum(len(plain.encode_ordinary(t or "")) + 1 for _, t, *_ in ROWS)
    assert {i for r in rows for i in r.doc_ids} == {i for i, *_ in ROWS if i is not None}


def test_texts_of_single_blanks_need_no_look_ahead(monkeypatch):
    """Any script; the same ids as the whole pattern, which only neighbouring blanks call for."""
    own = tokenshards.Tokenizer(tokenshards.VOCABULARY, tokenshards.PATTERN)
    whole, draw = own._encode, np.random.default_rng(3)
    letters = ["a", "bc", "Ü", "中文", "ж", "12", "²", "'s", "'", "?!", "😀", "\u200b", " ", "\n", "\t", "\xa0", "\x85", "\u3000", "\x1c", "\r"]
    texts = ["".join(draw.choice(letters, draw.integers(0, 12))) for _ in range(3000)]
    assert [own.ids(x) for x in texts] == [whole(x) for x in texts]
    plain = ["Привет, мир", "a b\nc", " 中文 12 '", "x\n"]
    ids = [whole(x) for x in plain]
    monkeypatch.setattr(own, "_encode", None)
    assert [own.document(x) for x in plain] == [own.pack(x) + own.closing for x in ids]


def test_words_looked_up_give_the_ids_of_the_whole_text():
    import base64

    import tiktoken

    with open(tokenshards.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=tokenshards.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = tokenshards.Tokenizer(tokenshards.VOCABULARY, tokenshards.PATTERN)
    draw = np.random.default_rng(12)
    pieces = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "Zé", "ß", "×", "ª", "²", "½", "12", "'s", "'ll", "'", '"', "...", "_", "ɏ", "ɐ", "日本", "\u0301", "😀"]
    for k in range(4000):
        text = "".join(draw.choice(pieces[: 10 + k % 17] if k % 2 else [" ", " ", "\n", "ab", "c", ".", "'s", "'", "7", "é"], draw.integers(0, 12)))
        assert np.frombuffer(own.document(text), own.type).tolist() == plain.encode_ordinary(text) + [own.end], repr(text)


def test_sequences_of_nothing(nothing):
    assert tokenshards.sequences(nothing).count() == 0


# -- periodic runs --------------------------------------------------------------------------------


def plain_runs(words, power=4, least=6):
    out = []
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            own = words[s : i + q]
            if i > s and len(own) >= max(least, power * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((s, len(own), q))
            i += 1
    return sorted(out)


def plain_periodic(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_against_every_period():
    draw = np.random.default_rng(12)
    for t in range(1500):
        words = draw.integers(0, draw.integers(1, 4), draw.integers(0, 60))
        if t % 2 and len(words):
            at, p = int(draw.integers(0, len(words))), int(draw.integers(1, 8))
            for i in range(at + p, min(len(words), at + p * 6)):
                words[i] = words[i - p]
        for power, least in ((4, 6), (2, 1), (3, 9)):
            assert periodic.find_runs(words, power, least) == plain_runs(words.tolist(), power, least)


def test_sorted_places_split_and_keep_their_order(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 4)
    draw, places, plain = np.random.default_rng(3), periodic.Places(500), [500]
    for x in draw.permutation(1000)[:400].tolist():
        if x not in plain:
            below, above = [y for y in plain if y < x], [y for y in plain if y > x]
            assert places.around(x) == (max(below, default=-1), min(above, default=-1))
            places.add(x)
            plain.append(x)
    assert list(places) == sorted(plain) and places.n == len(plain) and len(places.blocks) > 40


def test_runs_of_awkward_documents(spark, docs, nothing):
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        texts = [(t or "").encode().split() for i, t, *_ in ROWS if i == r.doc_id]
        assert r.n_words in map(len, texts) and [tuple(x) for x in r.runs] in [plain_runs(w) for w in texts]
    assert next(r for r in got if r.doc_id == 7).collapsed == f"{A} {B}"
    assert next(r for r in got if r.doc_id == 3).collapsed == ""
    assert periodic.periodic_runs(nothing).count() == 0
    long = spark.createDataFrame([(1, "a " * 300_000), (2, "x " + "b c d " * 50_000 + "y")], "doc_id long, text string")
    assert {r.doc_id: (tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(long).collect()} == {
        1: (((0, 300_000, 1),), "a"),
        2: (((1, 150_000, 3),), "x b c d y"),
    }


# -- spelling variants -----------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def plain_variants(words):
    shared, near = {}, {w: set() for w in words}
    for w in words:  # near words share a rest with one letter less, or one is the other's rest
        for rest in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            for v in shared.setdefault(rest, []):
                if one_edit(w, v):
                    near[w].add(v)
                    near[v].add(w)
            shared[rest].append(w)
    form = {}
    for w, of in near.items():
        best = min(of, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows)


def plain_words_of(rows, planted=False):
    count = {}
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if planted and i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] = count.get(run, 0) + 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


@pytest.mark.parametrize("limit", [2048, 30, 3])
def test_variants_against_all_words(spark, limit):
    draw = np.random.default_rng(13)
    words = {"".join(draw.choice(list("abcé"), draw.integers(7, 10))): int(draw.choice([2, 3, 25, 40, 300, 5000])) for _ in range(400)}
    words |= {"a" * 300: 5, "a" * 299 + "b": 70, "a" * 301: 700, "ÿ" * 9000: 3, "ÿ" * 9001: 2, "abcdefg": 2, "gfedcba": 90, "abcdegf": 90}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), limit=limit)
    assert sorted(map(tuple, got.collect())) == plain_variants(words)


def test_variants_of_awkward_documents(docs, nothing):
    rows = [(i, t) for i, t, *_ in ROWS]
    for planted in (False, True):
        got = spelling.spelling_variants(docs, edit=spelling.planted_deletion if planted else None)
        assert sorted(map(tuple, got.collect())) == plain_variants(plain_words_of(rows, planted))
    assert spelling.spelling_variants(nothing).count() == 0


# -- SuperMinHash ------------------------------------------------------------------------------------


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_near(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) of every row by all pairs that share a shingle."""
    sets = [plain_shingles(t) for _, t in rows]
    root, holders = list(range(len(rows))), {}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, s in enumerate(sets):
        for other in {j for g in s for j in holders.get(g, ())}:
            if find(k) != find(other) and 100 * len(s & sets[other]) >= percent * len(s | sets[other]):
                a, b = sorted((find(k), find(other)))
                root[b] = a
        for g in s:
            holders.setdefault(g, []).append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        g = find(k) if sets[k] else ("alone", k)
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    named = [(i, len(sets[k]), least[find(k) if sets[k] else ("alone", k)]) for k, (i, _) in enumerate(rows)]
    return sorted(((i, n, c, i == c) for i, n, c in named), key=repr)


@pytest.mark.parametrize("batch", [1 << 19, 100])
def test_signatures_by_shuffling_one_by_one(monkeypatch, batch):
    monkeypatch.setattr(superminhash, "BATCH", batch)
    draw = np.random.default_rng(11)
    sets = [np.unique(draw.integers(0, 1 << 63, n, np.uint64)) for n in (1, 2, 7, 300)]
    for s, got in zip(sets, superminhash.signatures(sets, 40)):
        want = [(1 << 64) - 1] * 40
        for e in s:
            p = list(range(40))
            for rank in range(40):
                z = int(superminhash._mix(np.array([(int(e) + (rank + 1) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])
                k = rank + ((z >> 40) * (40 - rank) >> 24)
                p[rank], p[k] = p[k], p[rank]
                want[p[rank]] = min(want[p[rank]], rank << 40 | z & ((1 << 40) - 1))
        assert got.tolist() == want


def test_signatures_vary_less_than_independent_minima():
    draw, agree = np.random.default_rng(5), []
    for _ in range(150):
        common = draw.integers(0, 1 << 63, 170, np.uint64)
        a, b = superminhash.signatures([np.unique(np.append(common, draw.integers(0, 1 << 63, 15, np.uint64))) for _ in range(2)])
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 0.85) < 0.01 and np.std(agree) < 0.9 * np.sqrt(0.85 * 0.15 / 200)


@pytest.mark.parametrize("work, block, batch, sent", [(1 << 24, 2048, 1 << 19, 500_000), (2, 8, 700, 0)])
def test_near_copies_against_all_pairs(spark, monkeypatch, work, block, batch, sent):
    for name, value in (("WORK", work), ("BLOCK", block), ("BATCH", batch), ("SENT", sent)):
        monkeypatch.setattr(superminhash, name, value)
    draw, rows = np.random.default_rng(block), []
    passage = [f"p{k}" for k in range(80)]  # shared by many documents that are not alike
    for k in range(12):
        base = [f"w{x}" for x in draw.integers(0, 5000, 150)]
        for c in range(14):
            own, changed = list(base), draw.integers(0, 150, c % 5)
            for at in changed:
                own[at] = f"c{draw.integers(0, 9999)}"
            rows.append((None if k == 11 else 1000 * c + k, " ".join(own)))
    for k in range(60):
        rows.append((50_000 + k, " ".join(passage + [f"u{x}" for x in draw.integers(0, 5000, 60 + k)])))
    chain = [f"x{k}" for k in range(400)]  # every copy goes on where the one before ended
    rows += [(70_000 + k, " ".join(chain[4 * k : 4 * k + 150])) for k in range(40)]
    rows += [(80_000, "a b"), (80_001, "A  b"), (80_002, None), (80_003, " "), (None, None), (5, "a b c"), (5, "a b c")]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = plain_near(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want and 60 < sum(r[3] for r in want) < 200


def test_images_never_rule_out_a_link(monkeypatch):
    monkeypatch.setattr(superminhash, "WIDE", 300)
    draw, said = np.random.default_rng(2), []
    for _ in range(300):
        common = draw.integers(0, 1 << 63, draw.integers(20, 500), np.uint64)
        sets = [np.unique(np.append(common, draw.integers(0, 1 << 63, draw.integers(0, 2 + len(common) // 6), np.uint64))) for _ in range(2)]
        image = [s.astype(np.uint16 if len(s) <= 300 else np.uint32).tobytes() for s in sets]
        [may] = superminhash.possible(image[0], len(sets[0]), [image[1]], [len(sets[1])])
        shared = len(np.intersect1d(*sets))
        linked = 100 * shared >= 85 * (len(sets[0]) + len(sets[1]) - shared)
        assert may or not linked
        said.append((may, linked))
    assert sum(a != b for a, b in said) < 20 and 50 < sum(b for _, b in said) < 290


def test_near_copies_of_awkward_documents(docs, nothing):
    got = superminhash.near_duplicates(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_near([(i, t) for i, t, *_ in ROWS])
    assert superminhash.near_duplicates(nothing).count() == 0


# -- the rest of the library does not need this subpackage -------------------------------------


def test_entry_works_without_the_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('biascomp.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 100 and not any(k.startswith('op1') for k in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
