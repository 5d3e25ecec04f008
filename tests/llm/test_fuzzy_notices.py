"""Places found by pieces against all runs of words under the edit distance."""

import random

import pytest

from hitweave.llm import fuzzy_notices as N


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(text, notices):
    tokens = N.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    out = []
    for phrase, k in notices.items():
        places = []
        for i in range(len(tokens)):
            best, run = None, ""
            for j in range(i, len(tokens)):
                run = tokens[i] if j == i else run + " " + tokens[j]
                if len(run) > len(phrase) + k:
                    break
                d = distance(phrase, run)
                if d <= k and (best is None or d < best[2]):
                    best = (i, j, d)
            if best:
                places.append(best)
        for a in places:
            rivals = [b for b in places if b is not a and a[0] <= b[1] and b[0] <= a[1] and (b[2], b[0]) < (a[2], a[0])]
            if a[2] == 0 or not rivals:
                out.append((phrase, *a))
    return len(tokens), sorted(out, key=lambda f: (f[1], f[0]))


def damaged(rng, phrase, edits):
    s = list(phrase)
    for _ in range(edits):
        at = rng.randrange(len(s))
        s[at : at + 1] = rng.choice([[], ["x"], [s[at], "q"], [" ", s[at]]])
    return "".join(s)


NOTICES = {p: N.edits_allowed(p) for p in N.NOTICES}


def test_against_all_runs():
    rng = random.Random(9)
    vocabulary = ["the", "mit", "lic", "license", "general", "public", "apache", "creative", "common", "a", "b", "rights", "été"]
    for _ in range(250):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(4)):
            phrase = rng.choice(list(NOTICES))
            parts.insert(rng.randrange(len(parts) + 1), damaged(rng, phrase, rng.randrange(4)))
        text = rng.choice([" ", "\n", ", "]).join(parts)
        text = text.upper() if rng.random() < 0.2 else text
        n, got = N.search(text, NOTICES)
        want = brute(text, NOTICES)
        assert (n, [(p, a, b, e) for p, a, b, _, _, e in got]) == want, text
        for phrase, a, b, start, end, e in got:
            words = N.WORD.findall(text[start:end].lower())
            assert distance(phrase, " ".join(words)) == e


@pytest.mark.parametrize("phrase", ["ab ab", "a b a"])
def test_exact_places_may_overlap(phrase):
    _, got = N.search("ab ab ab ab " + "a b a b a", {phrase: 1})
    assert len([g for g in got if g[-1] == 0]) == (3 if phrase == "ab ab" else 2)


def test_rows(spark):
    texts = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None), (3, ""), (None, "MIT--\nLICENSE " * 3),
             (4, "word " * 60_000 + "GNU General Publc License")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, places int")
    got = {(r.doc_id, r.n_words): [tuple(p) for p in r.places] for r in N.notice_places(docs).collect()}
    assert got[1, 5] == [("mit license", 3, 4, 19, 30, 0)]
    assert got[2, 0] == got[3, 0] == []
    assert [p[1] for p in got[None, 6]] == [0, 2, 4]
    assert [(p[0], p[1], p[5]) for p in got[4, 60_004]] == [("general public license", 60_001, 1)]
    assert N.notice_places(docs.limit(0)).count() == 0
