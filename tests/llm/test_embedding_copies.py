"""Near copies of embeddings against all pairs."""

import math

import numpy as np
import pytest

from hitweave.llm import embedding_copies as C


def brute(rows, threshold=0.9):
    def valid(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [k for k, (_, v) in enumerate(rows) if valid(v)]
    links = {k: [] for k in range(len(rows))}
    for dim in {len(rows[k][1]) for k in ok}:
        same = [k for k in ok if len(rows[k][1]) == dim]
        cosine = (m := C.units(np.array([rows[k][1] for k in same], dtype=float))) @ m.T
        for i, j in zip(*np.nonzero(cosine >= threshold)):
            if i != j:
                links[same[i]].append(same[j])
    out = []
    for k, (name, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        names = [rows[s][0] for s in seen if rows[s][0] is not None]
        least = min(names) if names else None
        out.append((name if name is not None else -1, len(links[k]), least if least is not None else -1, name is not None and name == least))
    return sorted(out)


def result(df):
    null = lambda x: -1 if x is None else x
    return sorted((null(r.vec_id), r.n_links, null(r.component_id), r.kept) for r in df.collect())


def vectors(seed=0, n=400, dims=16, spread=0.3, per=(1, 1, 2, 5, 60)):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        centre = rng.standard_normal(dims)
        for _ in range(rng.choice(per)):
            rows.append((len(rows) + 1000, (centre + spread * rng.standard_normal(dims)).astype(np.float32).tolist()))
    return rows


ODD = [
    (1, None), (2, []), (3, [0.0] * 16), (4, [None] + [1.0] * 15), (5, [float("nan")] + [1.0] * 15), (6, [float("inf")] + [1.0] * 15),
    (None, [1.0] * 16), (7, [2.0] * 16), (8, [-1.0] * 16), (9, [1.0] * 16), (9, [1.0] * 16), (None, [-0.0] + [3.0] * 3),
    (None, None), (10, [1e300, -1e300] * 8), (11, [1e-300, -1e-300] * 8), (12, [0.0, 5.0, 0.0, -0.0]),
]


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_against_all_pairs(spark):
    rows = vectors() + ODD
    got = result(C.near_copies(frame(spark, rows).repartition(4), miss=1e-9))
    assert got == brute(rows)
    assert max(r[1] for r in got) > 30 and len({r[2] for r in got}) > 30


def test_recall_of_all_links(spark):
    """Cosines all around the threshold: no link below it, hardly one above it lost."""
    rows = vectors(3, 900, 16, 0.32, (200, 4))
    got, want = result(C.near_copies(frame(spark, rows))), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert 10_000 < sum(w[1] for w in want) * 0.995 <= sum(g[1] for g in got)


def test_float_vectors_and_crowded_keys(spark):
    rows = [(i, v) for i, v in vectors(1, 300, 8, 0.12, (150, 3)) if v]
    rows += rows[:40]  # repeated rows
    assert result(C.near_copies(frame(spark, rows, "float"), crowd=16)) == brute(rows)


@pytest.mark.parametrize("n", [2_000, 50_000, 10**9])
def test_recall_at_the_threshold(n):
    """Pairs whose cosine is just the threshold share a key as often as promised."""
    bits, tables = C.plan(n)
    assert (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables <= C.MISS
    if n > 10**6:
        return
    rng = np.random.default_rng(n)
    a = C.units(rng.standard_normal((3000, 64)))
    b = rng.standard_normal((3000, 64))
    b = C.units(b - (a * b).sum(axis=1, keepdims=True) * a)
    pair = 0.9 * a + math.sqrt(1 - 0.81) * b
    met = (C.table_keys(a, bits, tables) == C.table_keys(pair, bits, tables)).any(axis=1)
    assert met.mean() >= 1 - 3 * C.MISS


def test_the_threshold_itself_is_a_link():
    three_four = np.array([[3.0, 4.0], [1.0, 0.0]])
    assert C.reaches(*three_four, 0.6) == (C.Fraction(3, 5) >= C.Fraction(0.6))
    assert not C.reaches(*three_four, 0.61)


def test_empty_table_and_clashing_columns(spark):
    assert result(C.near_copies(frame(spark, []))) == []
    rows = vectors(2, 60)
    clash = frame(spark, rows).selectExpr("*", "1 AS node", "2 AS vector", "3 AS copies", "4 AS t", "5 AS root", "6 AS kept")
    assert result(C.near_copies(clash)) == brute(rows)
