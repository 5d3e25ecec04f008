"""Winnowing against a search for every window."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hitweave.llm import winnowing as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        tokens, hit, held = words(text), set(), set()
        for item_id, item in items:
            parts = words(item)
            size = min(window, len(parts))
            grams = {tuple(parts[s : s + size]) for s in range(len(parts) - size + 1)} if size else set()
            for s in range(len(tokens) - size + 1 if size else 0):
                if tuple(tokens[s : s + size]) in grams:
                    hit.update(range(s, s + size))
                    held.add(str(item_id))
        out.append((doc_id, len(tokens), len(hit), sorted(held), len(hit) > 0 and 20 * len(hit) >= len(tokens)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    r = F.col("_report")
    rows = W.decontaminate(d, b).select("doc_id", r["n_words"], r["n_hit"], r["items"], W.contaminated(r)).collect()
    return sorted(((a, n, h, list(i), c) for a, n, h, i, c in rows), key=str)


def test_against_every_window(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["été", "ß2", "Ünd"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([13, 14, 20, 45, 60, 13, 12, 5, 4, 1])]
    items += [(20, items[2][1]), (21, "rare words"), (22, None), (23, ""), (24, "!?"), (25, items[2][1].upper())]
    docs = []
    for i in range(60):
        body = text(rng.choice([0, 1, 5, 12, 13, 40, 200])).split()
        item = rng.choice(items)[1] or ""
        part = item.split()
        a, b = sorted(rng.sample(range(len(part) + 1), 2)) if part else (0, 0)
        at = rng.randrange(len(body) + 1)
        body[at:at] = part[a:b] if rng.random() < 0.5 else part
        docs.append((i, rng.choice([" ", ", ", "\n", " -- "]).join(body)))
    docs += [(100, None), (101, ""), (102, "... !!"), (103, docs[3][1]), (3, docs[3][1]), (None, docs[4][1]), (104, "a" * 50_000)]
    docs += [(105, text(6000) + " " + items[4][1])]
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("items", [[], [(1, None)], [(1, "short item")]])
def test_few_items(spark, items):
    docs = [(1, "a short item here"), (2, None)]
    assert run(spark, docs, items) == brute(docs, items)


def test_names_that_clash(spark):
    """Own columns give way, in any case of letters; a column _zero stays."""
    docs = [(1, "a short item here", 5, "x", "y", "z"), (2, None, 6, "x", "y", "z"), (1, "other", None, "x", "y", "z")]
    d = spark.createDataFrame(docs, "doc_id long, text string, _zero int, _k1 string, _K2 string, _report string")
    b = spark.createDataFrame([(1, "Short item", 9)], "item_id long, text string, _report int")
    found = W.decontaminate(d, b)
    assert found.columns == ["doc_id", "text", "_zero", "_report"]
    got = sorted((r.doc_id, r._zero, r._report.n_hit, list(r._report["items"])) for r in found.where("_zero is not null").collect())
    assert got == [(1, 5, 2, ["1"]), (2, 6, 0, [])] and found.count() == 3


def test_no_documents(spark):
    assert run(spark, [], [(1, "some words of an item")]) == []
