"""Source divergence against plain counting and integer arithmetic."""

import random
import re
from collections import Counter

import numpy as np

from hitweave.llm import term_divergence as T

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, in_docs = {}, {}
    for lang, source, text in rows:
        terms = Counter(TERM.findall(text.translate(LOWER)))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        in_docs.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang, of in counts.items():
        kept = sorted(t for t, n in in_docs[lang].items() if n >= min_docs)

        def p(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 5) // (total + 5 * len(kept)) for t in kept}

        freq = {s: p(c) for s, c in of.items()}
        whole = p(sum(of.values(), Counter()))
        for s in of:
            pair = [(sum(abs(freq[s][t] - freq[o][t]) for t in kept), o) for o in of if o != s]
            term = [(freq[s][t] - whole[t], t) for t in kept if of[s][t] and freq[s][t] > whole[t]]
            for part, values, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked[:most])]
    return sorted(out)


def corpus(seed=3, n=260):
    rng = random.Random(seed)
    vocabulary = ["a", "Ab", "haus", "straße", "Éclair", "internationalisierung", "x" * 16, "y" * 17, "ÿ" * 40, "naïve", "ÀB", "日本語", "z" * 70]
    vocabulary += ["w" + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 22))) for _ in range(50)]
    rows = []
    for _ in range(n):
        lang = rng.choice(["de", "en", "en", None, ""])
        source = rng.choice(["hot", "hot", "hot", "s1", "s2", None, "ü"])
        words = [rng.choice(vocabulary[: 10 + 12 * len(source or "")]) for _ in range(rng.randrange(0, 60))]
        rows.append((lang, source, rng.choice([" ", ", ", "1", "\x7f", "_"]).join(words)))
    rows += [("xx", "only", None), ("xx", "other", ""), ("yy", "one", "alone"), ("en", "empty", "12 34"), ("en", "s1", "Vielwort " * 20000)]
    rows += [("en", "dup", "same text twice"), ("en", "dup", "same text twice")]
    return rows


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "lang string, source string, text string")


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_against_plain_counting(spark):
    rows = corpus()
    got = result(T.divergence(frame(spark, rows).repartition(3), min_docs=4, top=5))
    assert got == brute(rows, 4, 5)
    assert {r[0] for r in got if r[2] == "pair" and r[4] == 0} >= {"xx"}


def test_blocks_of_sources_and_terms_and_small_chunks(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(T, "TERM_BLOCK", 7)
    counts = {tuple(r)[:3]: (r.n, r.docs) for r in T.term_counts(frame(spark, rows).repartition(2), chunk=500).collect()}
    whole = {tuple(r)[:3]: (r.n, r.docs) for r in T.term_counts(frame(spark, rows).coalesce(1)).collect()}
    assert counts == whole
    assert result(T.divergence(frame(spark, rows), min_docs=2, top=3)) == brute(rows, 2, 3)


def test_many_sources_in_blocks(spark):
    rng = random.Random(1)
    rows = [("en", f"s{i % 300:03}", " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(5))) for i in range(700)]
    assert result(T.divergence(frame(spark, rows), min_docs=2, top=3)) == brute(rows, 2, 3)


def test_long_text_is_cut_in_steps(monkeypatch):
    monkeypatch.setattr(T, "STEP", 50)
    texts = ["ab " * 100 + "AB", "", "x" * 300, "Cd ab", "ef gh", ""]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    found = {}
    for terms, of, n, docs in T.count_terms(data, ends, np.array([0, 0, 1, 1, 2, 2])):
        found |= {(t.decode(), g): (a, b) for t, g, a, b in zip(terms, of.tolist(), n.tolist(), docs.tolist())}
    assert found == {("ab", 0): (101, 1), ("ab", 1): (1, 1), ("x" * 300, 1): (1, 1), ("cd", 1): (1, 1), ("ef", 2): (1, 1), ("gh", 2): (1, 1)}


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(0)
    low, high = (rng.integers(0, 5, 400, dtype=np.uint64) << np.uint64(40) for _ in range(2))
    order = T.radix_order([low, high], 8)
    assert order.tolist() == sorted(range(400), key=lambda i: (high[i], low[i]))


def test_empty_table_and_clashing_columns(spark):
    assert result(T.divergence(frame(spark, []))) == []
    rows = corpus(7, 60)
    docs = frame(spark, rows).selectExpr("*", "1 AS term", "2 AS n", "3 AS number", "4 AS p", "5 AS rank", "6 AS docs")
    assert result(T.divergence(docs, min_docs=2, top=4)) == brute(rows, 2, 4)
