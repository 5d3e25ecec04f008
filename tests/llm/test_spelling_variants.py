"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from hitweave.llm import spelling_variants as S

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows):
    n = words_of(rows)
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(c, key=lambda v: (-n[v], v)) if (c := close[w]) else None for w in n}
    form = {w: f if f and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(close[w]), n[form[w]] if form[w] else 0) for w in n)


def corpus(seed=1, n_docs=300):
    rng = random.Random(seed)
    letters = "abcdeéßÿÀÖnrst"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 13))) for _ in range(60)]
    words += ["banana", "bananaa", "bananas", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abcdef", "abcdeg", "bbcdef", "ab" * 200, "ab" * 200 + "c"]
    weight = [rng.choice([1, 1, 5, 40]) for _ in words]
    rows = []
    for i in range(n_docs):
        text = []
        for w in rng.choices(words, weight, k=40):
            if rng.random() < 0.06:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:]])
            text.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "1", "Œ"]).join(text)))
    # chains: a form of a form
    rows += [(1000 + i, "handlng " * 2 + "handling " * 11 + "handlings " * 60) for i in range(3)]
    return rows + [(None, "nameless nameless nameless nameless nameless namelesss"), (7, None), (8, ""), (9, "12 !"), (3, rows[3][1]), (3, rows[3][1])]


def result(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("symbols", [8, 2])
def test_against_all_pairs(spark, symbols):
    rows = corpus()
    got = result(S.variant_groups(frame(spark, rows).repartition(3), symbols=symbols))
    assert got == brute(rows)
    assert sum(r[2] not in (r[0], r[1]) for r in got) > 0  # some word's root is its form's form
    assert max(len(r[0]) for r in got) > 390


def test_neighbourhoods_hold_every_edit():
    rng = random.Random(2)
    for word in ["a", "abba", "straße", "".join(rng.choice("abc") for _ in range(40))]:
        hashes = set(S.neighbourhood(S.reduced([word]))[0].tolist())
        for at in range(len(word) + 1):
            edits = [word[:at] + "é" + word[at:], word[:at] + "q" + word[at + 1 :], word[:at] + word[at + 1 :], word]
            for other in filter(None, edits):
                assert int(S.reduced_hash(S.reduced([other]))[0]) in hashes


def test_letters_are_deleted_by_the_id():
    runs = [(i, "zusammenhang") for i in range(2000)]
    changed = [i for i, run in runs if S.without_one_letter(str(i).encode(), run.encode()) != run.encode()]
    assert changed == [i for i, run in runs if zlib.crc32(f"{i}:{run}".encode()) % 199 == 0] and changed


def test_counts_passed_on_in_parts(spark, monkeypatch):
    rows = corpus(4, 60)
    whole = {r.word: r.n for r in S.word_counts(frame(spark, rows)).collect()}
    assert {w: n for w, n in whole.items() if n >= 5} == words_of(rows)


def test_empty_table_and_clashing_columns(spark):
    assert result(S.variant_groups(frame(spark, []))) == []
    rows = corpus(5, 40)
    docs = frame(spark, rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS form", "4 AS reduced", "5 AS near")
    assert result(S.variant_groups(docs)) == brute(rows)
