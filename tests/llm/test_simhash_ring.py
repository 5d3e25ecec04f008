"""Fingerprints against their definition, links against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from hitweave.llm import simhash_ring as R
from hitweave.llm.components import component_labels


def by_definition(text):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        tokens = tokens.replace(c, " ")
    tokens = [t for t in tokens.split(" ") if t]
    if not tokens:
        return 0
    grams = [" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "A b", "a b c", "x y z x y z x y z w", "Été plus  loin\vÀ\x1cb", "w " * 70_000])
def test_fingerprint(text):
    assert R.fingerprint(text) == by_definition(text)


def components(prints):
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def sample(rng):
    prints = []
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 12])):
            base ^= sum({1 << rng.randrange(64) for _ in range(rng.choice([0, 1, 2, 3, 4]))})
            prints.append(base)
    low = rng.getrandbits(32) << 32
    prints += [low | sum({1 << rng.randrange(32) for _ in range(5)}) for _ in range(80)]  # one key for many
    return prints


@pytest.mark.parametrize("crowd", [R.CROWD, 3])
def test_links_reach_what_all_pairs_reach(spark, crowd):
    prints = sample(random.Random(11))
    signed = np.array(sorted(set(prints)), dtype=np.uint64).view(np.int64).tolist()
    links = R.ring_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), crowd)
    labels = {r["node"]: r["root"] for r in component_labels(links, "a", "b").collect()}
    group = {}
    for p, root in components(prints).items():
        p = int(np.array(p, dtype=np.uint64).view(np.int64))
        group.setdefault(root, set()).add(labels.get(p, p))
    assert all(len(g) == 1 for g in group.values())
    assert len({next(iter(g)) for g in group.values()}) == len(group)


def test_documents(spark):
    rng = random.Random(5)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(n)]
    texts = []
    for i in range(30):
        body = words(rng.choice([2, 20, 300]))
        texts.append((i, " ".join(body)))
        if len(body) == 300:
            body[rng.randrange(300)] = "changed"
            texts.append((100 + i, " ".join(body)))
    texts += [(200, None), (201, ""), (202, " "), (None, texts[0][1]), (None, "alone and without a name"), (4, texts[4][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, fingerprint int")
    got = R.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    prints = [by_definition(t) for _, t in texts]
    root = components(prints)
    least = {}
    for (i, _), p in zip(texts, prints):
        least[root[p]] = min(x for x in (least.get(root[p]), i, 1 << 62) if x is not None)
    want = sorted((i is None, i or 0, p, least[root[p]] if least[root[p]] < 1 << 62 else None) for (i, _), p in zip(texts, prints))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint % (1 << 64), r.component_id) for r in got) == want
    kept = R.one_of_each(docs).collect()
    assert len(kept) == len(set(root.values()))
    assert {r.doc_id for r in kept if r.doc_id is not None} == {x for x in least.values() if x < 1 << 62}


def test_empty(spark):
    assert R.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
