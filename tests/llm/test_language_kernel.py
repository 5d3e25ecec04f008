"""Language identification: held-out accuracy, the kernel against sets, and rows without a language."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.llm import language_kernel as K

SF_DIR = "/root/testdata/sf0.01"


def gram_sets(presence, text):
    s = "".join(chr(33 + x) for x in presence.symbols[K.code_points(text)])
    while "!!" in s:
        s = s.replace("!!", "!")
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def test_kernel_counts_shared_grams():
    texts = ["the cat sat, on the mat 12", "der Hund und die Katze", "été là-bas", "a", "the the the", "日本語 テキスト x"]
    model = K.train(texts * 2, ["en", "de", "fr", "en", "en", "xx"] * 2, landmarks=2)
    presence = K.Presence(model.symbols)
    sets = [gram_sets(presence, t) for t in texts]
    counts = np.array([len(presence.distinct(t)) for t in texts], dtype=float)
    assert counts.tolist() == [len(s) for s in sets]
    rows = np.stack([np.isin(model.vocabulary, presence.distinct(t)) for t in texts]).astype(np.float32)
    kernel = model.kernel(rows, counts)
    landmarks = [i for name in model.languages for i in [j for j, x in enumerate(["en", "de", "fr", "en", "en", "xx"] * 2) if x == name][:2]]
    for i, a in enumerate(sets):
        for j, at in enumerate(landmarks):
            b = sets[at % 6]
            assert kernel[i, j] == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5, abs=1e-5)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = K.identify(docs).where(K.held_out(F.col("doc_id")))
    right, n = found.agg(F.avg((F.col("_lang") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97
    assert found.where("_lang_score < 0 or _lang_score > 1").count() == 0


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog of them all", "en") for i in range(20)]
    rows += [(20 + i, "der Hund und die Katze von allen", "de") for i in range(20)]
    rows += [(50, None, "en"), (51, "", None), (52, "123 !? ...", "de"), (None, "und der Hund", None), (7, "the dog", "en"), (7, "the dog", "en")]
    rows += [(53, "the dog and the cat " * 20_000, None), (54, "\U0001f600 \U0001f601 12", None), (55, "\U00020000\U00020001", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, _lang string")
    got = [(r.doc_id, r._lang, r._lang_score) for r in K.identify(docs).collect()]
    assert len(got) == len(rows)
    by = {i: (x, s) for i, x, s in got}
    assert by[50] == by[51] == by[52] == by[54] == ("und", 0.0)
    assert by[55][0] in ("en", "de")
    assert by[None][0] == "de" and by[7][0] == by[53][0] == "en"
    unknown = K.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r._lang for r in unknown} == {"und"}
    assert K.identify(docs.limit(0)).count() == 0


def test_language_of_copies_is_learnt(spark):
    """A language of which nearly all rows are copies, or have no text, is learnt like any other."""
    german = ["der Hund und die Katze", "das Haus ist nicht weit", "wir sind schon immer hier"]
    rows = spark.range(12_000).selectExpr("id", f"array('{"', '".join(german)}')[id % 3] text", "'de' lang")
    rows = rows.unionAll(spark.range(2000).selectExpr("id", "concat('the dog number ', id, ' and the cat') text", "'en' lang"))
    rows = rows.unionAll(spark.range(5000).selectExpr("id", "CAST(null AS string) text", "'fr' lang"))
    sample = K.labelled_sample(rows, "id", "text", "lang", 300)
    assert {r["text"] for r in sample if r["lang"] == "de"} == set(german)
    assert sum(r["lang"] == "en" for r in sample) == 300 and {r["lang"] for r in sample} == {"de", "en"}
    found = K.identify(rows.where("text is not null"), doc_id="id")
    assert found.where("_lang <> lang").count() == 0


def test_only_the_text_decides(spark):
    rows = [(i, "the cat %d" % (i % 3), "en") for i in range(30)] + [(i, "der hund %d" % (i % 3), "de") for i in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("fr").alias("lang"))
    first = {r.text: (r._lang, r._lang_score) for r in K.identify(docs).collect()}
    second = {r.text: (r._lang, r._lang_score) for r in K.identify(other, docs).collect()}
    assert first == second
