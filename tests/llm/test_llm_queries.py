"""The registered queries over the smallest tables: SQL where there is one, else plain versions; the pipeline."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from biascomp.llm import queries as llm
from tests.llm import test_llm_operators as plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = llm.queries()[name](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_suffix_query_against_all_windows(spark, table):
    got = plain.rows_of(llm.queries()["op3_suffix_array_dedup"](spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain.plain_removed(sorted((i, r.text) for i, r in table.items()), 100)


def test_simhash_query_against_all_pairs(spark, table):
    ids = sorted(table)
    fps = [plain.plain_fingerprint(table[i].text) for i in ids]
    want = sorted((i, f"{f:016x}", ids[g]) for i, f, g in zip(ids, fps, plain.plain_components(fps)))
    assert sorted(map(tuple, llm.queries()["op7_simhash_near_dedup"](spark, SF).collect())) == want


def test_pii_query_against_the_patterns(spark, table):
    for r in llm.queries()["op8_pii_weak_supervision"](spark, SF).collect():
        base = plain.plain_base(table[r.doc_id].text or "")
        listed = [f"{k}:{s}:{e}" for k, s, e in base]
        n = Counter(k for k, *_ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(","))


def test_periodic_query_against_every_period(spark, table):
    got = sorted(map(tuple, llm.queries()["op12_periodic_runs"](spark, SF).collect()))
    assert got == sorted(plain.plain_periodic(i, r.text) for i, r in table.items()) and sum(r[1] for r in got) > 10


def test_spelling_query_against_all_words(spark, table):
    got = sorted(map(tuple, llm.queries()["op13_spelling_variants"](spark, SF).collect()))
    assert got == plain.plain_variants(plain.plain_words_of([(i, r.text) for i, r in table.items()], planted=True))
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


def test_superminhash_query_against_all_pairs(spark, table):
    got = sorted(map(tuple, llm.queries()["op11_superminhash_near_dedup"](spark, SF).collect()), key=repr)
    assert got == plain.plain_near([(i, r.text) for i, r in sorted(table.items())])


@pytest.mark.parametrize("name", ["op1_token_shards", "op4_quality_classifier", "op5_substring_dedup", "op6_language_id"])
def test_query_covers_all_documents(spark, table, name):
    rows = llm.queries()[name](spark, SF).collect()
    ids = Counter(r.doc_id for r in rows) if name != "op1_token_shards" else Counter({i: 1 for r in rows for i in r.doc_ids})
    assert ids == Counter({i: 1 for i in table})


def test_pipeline_stages_against_plain_versions(spark, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns
        docs = llm.read(spark, str(_saved(docs, name)), "x")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    good, near, clean, mixed = kept.values()
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(good) > 0.8 * (len(table) - len(bad)) and len(bad & set(good)) <= 0.1 * len(bad) + 1
    ids = sorted(good)
    group = plain.plain_components([plain.plain_fingerprint(table[i].text) for i in ids])
    assert sorted(near) == sorted({ids[g] for g in group})
    assert sorted(clean) == sorted(i for i in near if not plain.plain_hits(table[i].text, bench)[1])
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 3
    sequences = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {i for r in sequences for i in r.doc_ids} == set(mixed)
    assert sorted(r.slot for r in sequences) == list(range(len(sequences)))


def _saved(df, name):
    from biascomp.llm.common import new_folder

    folder = new_folder(df, "stage")
    df.write.parquet(f"{folder}/x.parquet")
    return folder


def test_pipeline_runs_as_a_query(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
