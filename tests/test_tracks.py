import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitweave.operators import components as CC
from hitweave.operators import paths as PT
from hitweave.operators import walk as WK
from hitweave.plans import tracks as P

EDGE = "event_id long, src long, dst long, score double"


def random_graph(seed, nodes=14, edges=26, events=(1, 2)):
    """Acyclic: edges go from lower to higher ids. Same ids in every event."""
    rng = np.random.default_rng(seed)
    out = []
    for e in events:
        pairs = {tuple(sorted(rng.choice(nodes, 2, replace=False))) for _ in range(edges)}
        out += [(e, int(a), int(b), float(np.round(rng.random(), 2))) for a, b in sorted(pairs)]
    return out


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for e, a, b, _ in edges:
        ra, rb = find((e, a)), find((e, b))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x)[1] for x in parent}


# ---- components ----------------------------------------------------------------
@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    data = random_graph(seed, nodes=40, edges=30, events=(1, 2, 3))[:-8]
    labels = CC.component_labels(spark.createDataFrame(data, EDGE))
    got = {(r.event_id, r.hit_id): r.component for r in labels.collect()}
    assert got == union_find(data)


def test_long_chain_and_star(spark):
    chain = [(1, i, i + 1, 1.0) for i in range(200)]
    star = [(2, 300, i, 1.0) for i in range(200)]
    labels = CC.component_labels(spark.createDataFrame(chain + star, EDGE))
    got = {r.event_id: (r.n, r.c) for r in labels.groupBy("event_id").agg(F.count("*").alias("n"), F.max("component").alias("c")).collect()}
    assert got == {1: (201, 0), 2: (201, 0)}


def test_isolated_hits(spark, rows):
    hits = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "event_id long, hit_id long")
    edges = spark.createDataFrame([(1, 2, 1, 0.9), (2, 0, 0, 0.9), (1, 0, 1, 0.5)], EDGE)
    assert rows(CC.connected_components(hits, edges, 0.5)) == [(1, 0, 0), (1, 1, 1), (1, 2, 1), (2, 0, 0)]
    assert rows(CC.weak_components(hits, edges, 0.5)) == [(1, 0, -1), (1, 1, 1), (1, 2, 1), (2, 0, -1)]


def test_simple_paths_leave_the_graph(spark, rows):
    data = [(1, 0, 1, 1.0), (1, 1, 2, 1.0), (1, 5, 6, 1.0), (1, 7, 8, 1.0), (1, 7, 9, 1.0), (2, 0, 1, 1.0), (2, 0, 2, 1.0)]
    e = spark.createDataFrame(data, EDGE)
    labels = CC.component_labels(e)
    tracks, rest = CC.simple_path_tracks(e, labels, CC.component_shapes(e, labels))
    assert rows(tracks, "event_id", "hit_id", "track_id") == [(1, 0, 0), (1, 1, 0), (1, 2, 0)]
    assert rows(rest, "event_id", "src", "dst") == [(1, 7, 8), (1, 7, 9), (2, 0, 1), (2, 0, 2)]


# ---- walkthrough ---------------------------------------------------------------
def walk_by_listing(edges, low, add):
    """All roads listed one by one, the last of the longest kept: the definition itself."""
    out = {}
    for a, b, s in edges:
        out.setdefault(a, []).append((-s, b))
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    level = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b, _ in edges:
            level[b] = max(level[b], level[a] + 1)
    used, tracks = set(), []

    def next_hits(v):
        free = [(s, b) for s, b in sorted(out.get(v, [])) if b not in used]
        if not free or -free[0][0] <= low:
            return []
        return [free[0][1]] + [b for s, b in free[1:] if -s > add]

    def roads(v):
        follow = next_hits(v)
        return [[v, *rest] for b in follow for rest in roads(b)] if follow else [[v]]

    for v in sorted(nodes, key=lambda n: (level[n], n)):
        if v not in used:
            best = []
            for road in roads(v):
                if len(road) >= len(best):
                    best = road
            used |= set(best)
            tracks.append(best)
    return tracks


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.floats(0, 0.6), st.floats(0, 1))
def test_walk_equals_listing_all_roads(seed, low, add):
    edges = [(a, b, s) for _, a, b, s in random_graph(seed, 10, 18, (1,))]
    src, dst, score = map(np.array, zip(*edges))
    assert WK.walk_arrays(src, dst, score, low, add) == walk_by_listing(edges, low, add)


def test_cycle_is_refused():
    with pytest.raises(ValueError):
        WK.generations(np.array([0, 1, 2]), np.array([1, 2, 0]), 3)


@pytest.mark.parametrize("task_limit", [1, 10**6])
def test_edges_without_a_score(spark, rows, task_limit):
    data = [(1, 1, 2, float("nan"), 0), (1, 1, 3, 0.9, 0), (1, 3, 4, 0.9, 0), (1, 5, 6, None, 5)]
    e = spark.createDataFrame(data, EDGE + ", component long")
    want = [(1, 1, 1), (1, 2, 2), (1, 3, 1), (1, 4, 1), (1, 5, 5), (1, 6, 6)]
    assert rows(WK.walkthrough(e, 0.1, 0.95, task_limit=task_limit)) == want


@pytest.mark.parametrize("batch", [1, 7, 1 << 16])
def test_components_are_walked_together(spark, rows, monkeypatch, batch):
    rng = np.random.default_rng(3)
    data, want = [], []
    for event in range(4):
        for component in range(0, 60, 10):
            pairs = {(component + a, component + b) for a in range(9) for b in range(a + 1, 10) if rng.random() < 0.4}
            some = [(s, d, float(rng.integers(1, 8)) / 8) for s, d in sorted(pairs)]
            data += [(event, component, *e) for e in some]
            arrays = [np.array(c) for c in zip(*some)]
            want += [(event, h, road[0]) for road in WK.walk_arrays(*arrays, 0.2, 0.6) for h in road]
    edges = spark.createDataFrame(data, "event_id long, component long, src long, dst long, score double")
    assert rows(WK.walk_components(edges.repartition(3), 0.2, 0.6, batch)) == sorted(want)
    calls, whole = [], WK.walk_arrays
    monkeypatch.setattr(WK, "walk_arrays", lambda *a: (calls.append(1), whole(*a))[1])
    WK._walk_batch(pa.table({c: [r[i] for r in data] for i, c in enumerate(("event_id", "component", "src", "dst", "score"))}), 0.2, 0.6)
    assert len(calls) == 1  # not once for each component


def test_generations_of_a_long_cycle_end_at_once():
    n = 20_000
    at = np.arange(n)
    assert WK.generations(at[:-1], at[1:], n)[-1] == n - 1
    with pytest.raises(ValueError):
        WK.generations(at, (at + 1) % n, n)


@pytest.mark.parametrize("task_limit", [1, 10**6])
def test_cycles_are_refused_either_way(spark, task_limit):
    data = [(1, 0, 1, 0.5, 0), (1, 1, 2, 0.5, 0), (1, 2, 0, 0.5, 0)]
    with pytest.raises(Exception, match="directed cycle"):
        WK.walkthrough(spark.createDataFrame(data, EDGE + ", component long"), 0.1, 0.9, task_limit=task_limit).collect()


def test_walk_by_rounds_equals_walk_in_task(spark, rows):
    data = random_graph(11, nodes=16, edges=24)
    e = spark.createDataFrame(data, EDGE)
    expected = []
    for event in (1, 2):
        for road in walk_by_listing([d[1:] for d in data if d[0] == event], 0.2, 0.6):
            expected += [(event, h, road[0]) for h in road]
    whole = e.withColumn("component", F.lit(0).cast("long"))
    assert rows(WK.walkthrough(whole, 0.2, 0.6)) == sorted(expected)
    assert rows(WK.walkthrough(whole, 0.2, 0.6, task_limit=1)) == sorted(expected)


def test_cc_and_walk(spark, rows):
    hits = spark.createDataFrame(
        [(e, i, float(i), 0.0) for e in (1, 2) for i in range(9)], "event_id long, hit_id long, r double, z double"
    )
    data = [(1, 0, 0, 1, 0.9), (1, 1, 2, 1, 0.9), (1, 2, 4, 5, 0.9), (1, 3, 5, 6, 0.8), (1, 4, 5, 7, 0.7), (1, 5, 8, 3, 0.4),
            (2, 0, 0, 1, 0.9), (2, 1, 1, 2, 0.9)]
    e = spark.createDataFrame(data, "event_id long, edge_id long, src long, dst long, score double")
    out = P.cc_and_walk(hits, e, 0.5, 0.5, 0.95)
    assert rows(out, "event_id", "track_id", "hit_id", "reco_method") == [
        (1, 0, 0, "cc"), (1, 0, 1, "cc"), (1, 0, 2, "cc"),
        (1, 4, 4, "walk"), (1, 4, 5, "walk"), (1, 4, 6, "walk"), (1, 7, 7, "walk"),
        (2, 0, 0, "cc"), (2, 0, 1, "cc"), (2, 0, 2, "cc"),
    ]
    assert P.cc_and_walk(hits, e, 0.5, 0.5, 0.95, cc_only=True).count() == 6
    labels = P.label_hits(hits, out)
    assert labels.where("track_id = -1").count() == 8


# ---- paths ---------------------------------------------------------------------
def all_paths(edges):
    out, heads = {}, set()
    for a, b in edges:
        out.setdefault(a, []).append(b)
        heads.add(b)
    found = []

    def go(path):
        if path[-1] not in out:
            found.append(path)
        for b in out.get(path[-1], []):
            if b not in path:
                go([*path, b])

    for a in out:
        if a not in heads:
            go([a])
    return sorted(found)


@pytest.mark.parametrize("seed", [3, 4])
def test_long_path_labels(spark, seed):
    data = random_graph(seed, nodes=12, edges=18)
    out = PT.long_path_labels(spark.createDataFrame(data, EDGE), min_nodes=4, max_edges=5)
    got = {(r.event_id, r.hit_id): r.path for r in out.collect()}
    for event in (1, 2):
        pairs = [(a, b) for e, a, b, _ in data if e == event]
        want = {h: None for p in pairs for h in p}
        for path in all_paths(pairs):
            if 4 <= len(path) <= 6:
                want.update(dict.fromkeys(path, path))
        assert {h: p for (e, h), p in got.items() if e == event} == want


def test_long_paths_without_a_bound(spark, rows):
    chain = [(1, i, i + 1, 1.0) for i in range(28)]
    out = PT.long_path_labels(spark.createDataFrame(chain, EDGE), max_edges=None)
    assert out.where("size(path) = 29").count() == 29
    assert PT.long_path_labels(spark.createDataFrame(chain, EDGE)).where("path is not null").count() == 0


def cyclic_graph(seed, nodes=13, edges=20, back=5):
    rng = np.random.default_rng(seed)
    out = set()
    for event in (1, 2):
        for _ in range(edges):
            a, b = sorted(rng.choice(nodes, 2, replace=False))
            out.add((event, int(a), int(b)))
        for _ in range(back):
            a, b = sorted(rng.choice(nodes, 2, replace=False))
            out.add((event, int(b), int(a)))
    return [(*e, 1.0) for e in sorted(out)]


def reachable(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        found[a] = seen
    return found


@pytest.mark.parametrize("seed", [1])
def test_paths_of_graphs_with_cycles(spark, seed):
    data = cyclic_graph(seed)
    df = spark.createDataFrame(data, EDGE)
    scc = PT.strongly_connected(df)
    got = {} if scc is None else {(r.event_id, r.hit_id): r.scc for r in scc.collect()}
    labels = {(r.event_id, r.hit_id): r.path for r in PT.long_path_labels(df, min_nodes=3, max_edges=7).collect()}
    listed = sorted((r.event_id, r.path) for r in PT.all_paths(df, 0.0).collect())
    want_listed = []
    for event in (1, 2):
        pairs = [(a, b) for e, a, b, _ in data if e == event]
        reach = reachable(pairs)
        on_cycle = [a for a in reach if a in reach[a]]
        assert {h: s for (e, h), s in got.items() if e == event} == {a: min(b for b in on_cycle if b in reach[a] and a in reach[b]) for a in on_cycle}
        want = {h: None for p in pairs for h in p}
        sinks = want.keys() - {a for a, _ in pairs}
        paths = [p for p in all_paths(pairs) if p[-1] in sinks]
        want_listed += [(event, p) for p in paths]
        for path in paths:
            if 3 <= len(path) <= 8:
                want.update(dict.fromkeys(path, path))
        assert {h: p for (e, h), p in labels.items() if e == event} == want
    assert listed == sorted(want_listed) and got


def test_a_cycle_beside_a_path(spark):
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 2, 1.0), (1, 2, 1, 1.0), (1, 2, 3, 1.0)], EDGE)
    for bound in (25, None):
        assert PT.long_path_labels(edges, min_nodes=8, max_edges=bound).where("path IS NOT NULL").count() == 0
        assert {tuple(r.path) for r in PT.long_path_labels(edges, min_nodes=4, max_edges=bound).collect()} == {(0, 1, 2, 3)}


@pytest.mark.parametrize(("edges_held", "ways_held"), [(1 << 15, 1 << 16), (12, 0)])
def test_long_paths_of_pieces_and_by_rounds(spark, monkeypatch, edges_held, ways_held):
    """Small events go whole into tasks, without any round; components of larger ones too, the rest by rounds: all alike."""
    chain = [(3, h, h + 1, 1.0) for h in [*range(4), *range(20, 35)]]
    data = cyclic_graph(4, edges=15, back=3) + chain + [(3, 40, 40, 1.0)]
    want, firsts = {}, {}
    for event in (1, 2, 3):
        pairs = [(a, b) for e, a, b, _ in data if e == event]
        label = {h: None for p in pairs for h in p}
        sinks = label.keys() - {a for a, _ in pairs}
        for path in all_paths(pairs):
            if path[-1] in sinks and 3 <= len(path) <= 10:
                label.update(dict.fromkeys(path, tuple(path)))
        want.update({(event, h): path for h, path in label.items()})
    for (event, hit), path in sorted(want.items(), key=lambda item: item[0]):
        firsts.setdefault((event, path), hit)
    by_rounds, rounds = [], PT._long_paths_by_rounds
    monkeypatch.setattr(PT, "_long_paths_by_rounds", lambda *a: by_rounds.append(1) or rounds(*a))
    monkeypatch.setattr(PT.PP, "PIECE_EDGES", edges_held)
    monkeypatch.setattr(PT.PP, "PIECE_WAYS", ways_held)
    got = PT._long_paths(spark.createDataFrame(data + data[:6], EDGE), 3, 9).collect()
    assert {(r.event_id, r.hit_id): r.path and tuple(r.path) for r in got} == want and len(got) == len(want)
    assert all(r["first"] == (r.path and firsts[r.event_id, tuple(r.path)]) for r in got)
    assert any(want.values()) and bool(by_rounds) == (edges_held == 12)


def test_shortest_paths(spark):
    data = random_graph(5, nodes=12, edges=18)
    out = PT.shortest_paths(spark.createDataFrame(data, EDGE), -1.0)
    got = {(r.event_id, r.start, r.end): r.path for r in out.collect()}
    want = {}
    for event in (1, 2):
        for path in all_paths([(a, b) for e, a, b, _ in data if e == event]):
            key = (event, path[0], path[-1])
            if key not in want or (len(path), path) < (len(want[key]), want[key]):
                want[key] = path
    assert got == want


def test_all_simple_path_tracks_overwrite(spark, rows):
    chain = [(1, i, i + 1, 0.4) for i in range(8)]
    e = spark.createDataFrame([*chain, (1, 0, 1, 0.9), (1, 20, 21, 0.4), (1, 30, 31, 0.9)], EDGE)
    hits = spark.createDataFrame([(1, h) for h in [*range(9), 20, 21, 30, 31, 40]], "event_id long, hit_id long")
    out = PT.all_simple_path_tracks(CC.weak_components(hits, e, 0.5), e, 0.1, 0.5)
    # nine hits on the long path, two on a short one, one component, one hit alone
    assert rows(out, "hit_id", "track_id") == [
        *[(h, 41) for h in range(9)], (20, -1), (21, -1), (30, 30), (31, 30), (40, -1),
    ]
