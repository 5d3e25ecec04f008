"""The pipeline's stages, one after the other, on a small corpus whose outcome is known, and the registered queries."""

import os
import random

import pytest

import corpus_pipeline as P
from hitweave.llm import language_kernel as K
from hitweave.llm import queries as Q
from hitweave.llm.simhash_ring import fingerprint

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta the of and to in is was for on with as by at") + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = {i: prose(rng, 300) for i in range(40)}
    passage = prose(rng, 70)
    item = prose(rng, 40)
    words = texts[3].split()
    texts[50] = texts[1]  # exact copy
    copies = (" ".join(words[:i] + words[i + 1 :]) for i in range(len(words)))
    texts[51] = next(c for c in copies if (fingerprint(c) ^ fingerprint(texts[3])).bit_count() <= 3)  # near copy
    texts[52] = prose(rng, 100) + " " + passage + " " + prose(rng, 80)
    texts[53] = prose(rng, 90) + " " + passage + " " + prose(rng, 120)
    texts[54] = prose(rng, 60) + " " + item + " " + prose(rng, 60)  # a quarter is the item
    texts[55] = prose(rng, 2000) + " " + item  # a fiftieth
    texts[56] = "12345 !?"
    texts[57], texts[58] = "", None
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    rows += [rows[5], (None, prose(rng, 80), None, None, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(rng, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, passage, item


def test_stages(spark, corpus, tmp_path):
    folder, texts, passage, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append({r.doc_id: r for r in docs.collect()} if n < 4 else docs.collect())
        if n < 4:
            assert docs.columns == P.COLUMNS
    language, near, passages, clean, packed = kept
    assert set(language) == set(texts) - {56, 57, 58} | {None}
    assert set(near) == set(language) - {50, 51}
    assert set(passages) == set(near)
    assert sum(passage in (r.text or "") for r in passages.values()) == 1
    assert sum(r.text != texts.get(i, r.text) for i, r in passages.items()) == 1
    assert all(r.n_chars == len(r.text) for r in passages.values())
    gone = {i for i, r in passages.items() if item in r.text and len(r.text.split()) < 800}
    assert set(clean) == set(passages) - gone
    assert {r.doc_id for r in packed} == set(clean)
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


def test_run_gives_what_the_stages_give(spark, corpus):
    folder, _, _, _ = corpus
    out = P.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_stages_on_nothing(spark, corpus, tmp_path):
    folder = corpus[0]
    docs = spark.createDataFrame([], SCHEMA)
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries(spark, name):
    from oracle_check import compare, connect

    ok, note = compare(spark, connect(SF_DIR), name, Q.QUERIES[name], Q.ORACLES.get(name), SF_DIR)
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_held_out_rows_are_a_fifth(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    share = docs.where(K.held_out(docs["doc_id"])).count() / docs.count()
    assert 0.1 < share < 0.3
