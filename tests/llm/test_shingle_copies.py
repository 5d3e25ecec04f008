"""Near copies against all pairs of shingle sets."""

import random

from hitweave.llm import shingle_copies as C
from hitweave.llm.simhash_ring import fingerprint


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_pair_of_similar_texts(spark):
    rng = random.Random(9)
    word = lambda: "w" + str(rng.randrange(3000))
    texts = {}
    for i in range(60):
        body = [word() for _ in range(rng.choice([3, 40, 80, 200, 600]))]
        texts[i] = " ".join(body)
        for copy in range(rng.choice([0, 1, 1, 4])):
            other = list(body)
            for _ in range(max(1, len(body) * rng.choice([1, 2, 3, 5]) // 100)):
                other[rng.randrange(len(other))] = word()
            texts[100 * (copy + 1) + i] = " ".join(other)
    texts[900], texts[901], texts[902] = texts[7].upper(), None, ""
    texts[903] = texts[8] + " " + " ".join(word() for _ in range(30))
    sets, prints = {i: shingles(t) for i, t in texts.items()}, {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    far = 0
    for a in texts:
        for b in texts:
            alike = 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            near = (prints[a] ^ prints[b]).bit_count() <= 3
            if a < b and (alike or near):
                far += not near
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert far > 10  # the rule of 3 bits would keep both
    rows = list(texts.items()) + [(3, texts[3]), (None, texts[5]), (None, "alone and without a name")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in C.one_of_each(docs).collect()]
    assert sorted(i for i in got if i is not None) == sorted({find(i) for i in texts})
    assert got.count(None) == 1


def test_empty(spark):
    assert C.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def components(texts, alike):
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if find(a) != find(b) and alike(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in texts}


def crowd(n, seed, edits):
    """Copies of one text, each with its own edits: they share bands, but many are not alike."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(100000))
    body = [word() for _ in range(220)]
    texts = {}
    for i in range(n):
        other = list(body)
        for _ in range(rng.choice(edits)):
            other[rng.randrange(len(other))] = word()
        texts[i] = " ".join(other)
    return texts


def test_a_crowded_band_of_texts_that_differ(spark):
    """Neither links are lost nor pairs of unlike members listed."""
    texts = crowd(300, 3, [1, 4, 6, 12, 20])
    sets, prints = {i: shingles(t) for i, t in texts.items()}, {i: fingerprint(t) for i, t in texts.items()}

    def alike(a, b):
        near = 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
        return near or (prints[a] ^ prints[b]).bit_count() <= 3

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in C.one_of_each(docs).collect()}
    want = components(texts, alike)
    assert got == want and 20 < len(want) < 290


def test_counts_of_common_shingles(monkeypatch):
    monkeypatch.setattr(C, "COLUMNS", 7)
    rng = random.Random(6)
    sets = [rng.sample(range(60), rng.randrange(1, 40)) for _ in range(12)]
    got = C.common_counts([C.np.array(x) for x in sets], C.np.arange(5), C.np.arange(3, 12))
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[3:]] for a in sets[:5]]


def test_crowded_keys_are_dealt_into_parts(spark):
    """One key for all, cut into small parts, some nodes known to be one component: no link is lost."""
    texts = crowd(90, 5, [1, 2, 2, 8, 12])
    sets = {i: sorted(hash(s) for s in shingles(t)) for i, t in texts.items()}
    alike = lambda a, b: 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))
    main = [i for i in sets if alike(0, i)]
    root = {i: 0 if i in main else i for i in sets}
    assert len(main) > 20
    placed = spark.createDataFrame([(7, i, root[i]) for i in sets], "key long, node long, root long")
    nodes = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    found = [tuple(r) for r in C.links_within_keys(placed, nodes, crowd=8).collect()]
    parent = dict(root)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {find(i) for i in sets} == components(dict.fromkeys(sets), alike)


def test_clashing_columns_and_a_long_text(spark):
    rng = random.Random(4)
    long = " ".join("w" + str(rng.randrange(5000)) for _ in range(60_000))
    rows = [(1, long, 5), (2, long + " tail", 6), (3, "some other text that stands alone here", 7), (3, "some other text that stands alone here", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long")
    docs = docs.selectExpr("*", "1 AS row", "2 AS name", "3 AS component", "4 AS _zero", "5 AS _twin", "6 AS a", "7 AS keys")
    got = C.one_of_each(docs)
    assert got.columns == [c for c in docs.columns if c != "_twin"]
    assert sorted((r.doc_id, r.node) for r in got.collect()) == [(1, 5), (3, 7)]
