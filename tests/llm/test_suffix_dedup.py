"""Repeated passages against all windows of the texts."""

import random

import pytest

from hitweave.llm import suffix_dedup as S

VOCABULARY = [f"w{i}" for i in range(400)]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    shared = [words(rng, n) for n in (50, 51, 64, 90, 200, 49, 35)]
    texts = {}
    for i in range(60):
        body = words(rng, rng.choice([0, 3, 30, 60, 120, 300]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(shared)
        texts[i] = body
    texts[60] = texts[8] + texts[9]
    texts[61] = list(texts[60])
    texts[62] = words(rng, 70) * 3  # repeats in itself only
    texts[63] = ["same"] * 400
    texts[64] = ["same"] * 260
    return texts


def spans_of(spark, texts, **more):
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(900, None), (901, ""), (None, "short text"), (3, " ".join(texts[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.find_repeats(docs, **more)
    return docs, found.spans(), found.removable()


def windows(texts, size):
    found = {}
    for i, t in texts.items():
        for s in range(len(t) - size + 1):
            found.setdefault(tuple(t[s : s + size]), set()).add((i, s))
    return found


@pytest.mark.parametrize("passage,reach,gram", [(50, 20, 6), (12, 5, 3)])
def test_covers_all_repeats_and_nothing_else(spark, planted, passage, reach, gram):
    docs, spans, _ = spans_of(spark, planted, passage=passage, reach=reach, gram=gram)
    got = {}
    for r in S.span_report(docs, spans).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["begin"], r["end"]))
        assert r["n_words"] >= passage
        assert r["first_doc_id"] is not None
    want, block = {}, passage - reach + 1
    for places in windows(planted, passage).values():
        if len({i for i, _ in places}) > 1:
            for i, s in places:
                want.setdefault(i, set()).update(range(s, s + passage))
    assert want
    for i, covered in want.items():
        assert covered <= got.get(i, set()), i
    # Each word reported is part of a block of words that occurs elsewhere, or next to one.
    allowed = {}
    for places in windows(planted, block).values():
        if len(places) > 1:
            for i, s in places:
                allowed.setdefault(i, set()).update(range(s, s + block))
    for i, covered in got.items():
        assert covered <= allowed.get(i, set()), i
    assert 62 not in got


def test_one_copy_of_every_block_stays(spark, planted):
    docs, _, removable = spans_of(spark, planted)
    left = {r["doc_id"]: r["text"].split() for r in S.without_repeats(docs, removable).collect() if r["text"]}
    size = 50 - 20 + 1
    before = {w for w, p in windows(planted, size).items() if len({i for i, _ in p}) > 1}
    passages = [w for w, p in windows(planted, 50).items() if len({i for i, _ in p}) > 1]
    after = windows({i: t for i, t in left.items() if i is not None}, 50)
    spread = [len({i for i, _ in after.get(w, ())}) for w in passages]
    # Some stay double: where the first row of a block shares fewer words than two later rows do.
    assert sum(n <= 1 for n in spread) >= 0.95 * len(spread)
    kept = {x for t in left.values() for x in t}
    assert {x for w in before for x in w} <= kept


def test_small_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = S.find_repeats(docs)
    assert found.spans().count() == 0 and found.removable().count() == 0
    same = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (None, None)], "doc_id long, text string")
    found = S.find_repeats(same)
    assert found.spans().count() == 0
    assert S.without_repeats(same, found.removable()).count() == 3


def test_equal_rows_are_one_document(spark):
    rng = random.Random(1)
    text = " ".join(words(rng, 120))
    docs = spark.createDataFrame([(5, text)] * 3, "doc_id long, text string")
    assert S.find_repeats(docs).spans().count() == 0
    two = spark.createDataFrame([(5, text), (5, text), (6, text.upper()), (None, text)], "doc_id long, text string")
    report = S.span_report(two, S.find_repeats(two).spans()).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["begin"], r["end"]) for r in report) == [
        (False, 5, 0, 120),
        (False, 6, 0, 120),
        (True, 0, 0, 120),
    ]


def test_no_passage_stays_in_two_documents(spark, planted):
    rng = random.Random(3)
    texts = dict(planted)
    for n, size in enumerate([50, 51, 55, 60, 70, 80, 90, 100, 110]):
        for trial in range(4):  # all orders of the rows come up
            at = 1000 + 40 * n + 10 * trial
            passage = words(rng, size)
            around = words(rng, 60), words(rng, 60)
            texts[at] = words(rng, 80) + passage + words(rng, 80)
            texts[at + 1] = words(rng, 40) + around[0] + passage + around[1] + words(rng, 40)
            other = list(passage)
            other[size // 2] = "other"
            texts[at + 2] = words(rng, 30) + around[0] + other + around[1] + words(rng, 30)
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = {r.doc_id: r.row for r in docs.select("doc_id", S.row_key(docs.doc_id, docs.text).alias("row")).collect()}
    passages = {w: p for w, p in windows(texts, 50).items() if len({i for i, _ in p}) > 1}
    removable = S.find_repeats(docs).removable()
    got = {}
    for r in removable.collect():
        got.setdefault(r.row, set()).update(range(r.begin, r.end))
    want = {}
    for places in passages.values():
        first = min(key[i] for i, _ in places)
        for i, at in places:
            if key[i] != first:
                want.setdefault(key[i], set()).update(range(at, at + 50))
    assert got == want  # only words of a window that a lesser row has, and all of them
    left = {r.doc_id: r.text.split() for r in S.one_of_each_passage(docs).collect()}
    assert all(len({i for i, _ in p}) == 1 for p in windows(left, 50).values())
    assert {x for w in passages for x in w} <= {x for t in left.values() for x in t}


def test_later_rounds_hash_only_what_was_cut(spark, monkeypatch):
    rng = random.Random(5)
    shared, texts = words(rng, 60), [words(rng, 90) for _ in range(30)]
    for _ in range(6):  # the cut of the shared words brings together a passage that another document has
        left, right = words(rng, 30), words(rng, 30)
        texts += [words(rng, 20) + left + right + words(rng, 20), words(rng, 40) + left + shared + right + words(rng, 40)]
    texts += [words(rng, 80), shared + ["\u3000"] + words(rng, 80)]  # may lose its first word, a blank of another script, too
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")

    def rounds(again):
        rows = docs
        while True:
            spans = S.find_repeats(rows).removable()
            if spans.isEmpty():
                return sorted(tuple(r) for r in rows.collect())
            again.append(spans.select("row").distinct().count())
            rows = S.cut_lineage(S.without_repeats(rows, spans))

    cuts, hashed = [], []
    want = rounds(cuts)
    whole = S.retained_suffixes
    monkeypatch.setattr(S, "retained_suffixes", lambda d, *more: (hashed.append(d.count()), whole(d, *more))[1])
    assert sorted(tuple(r) for r in S.one_of_each_passage(docs).collect()) == want
    assert len(cuts) > 1 and hashed[0] == len(texts)
    assert hashed[1:] == cuts  # not the whole table once more


def test_seams():
    assert S._seams("a b c d e f", "a d f", [(1, 3), (4, 5)]) == [1, 2]
    assert S._seams("a b c", "c", [(0, 2)]) == [0]
    assert S._seams("a b \u3000 c", "c", [(0, 2)]) == [S.ANYWHERE]  # the blank word after the cut went with the end
