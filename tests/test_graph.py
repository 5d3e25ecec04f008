import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.operators import cuts, edge_tables, mapping, messages, module_map, weighting
from hitweave.plans import hooks


def edges(spark):
    return spark.createDataFrame(
        [(1, 0, 0, 1, 0.9), (1, 1, 1, 2, 0.4), (1, 2, 0, 2, 0.5), (2, 0, 0, 1, 0.1)],
        "event_id long, edge_id long, src long, dst long, score double",
    )


def track_edges(spark):
    return spark.createDataFrame(
        [(1, 0, 0, 1, 5, 2.0), (1, 1, 1, 3, 5, 2.0), (2, 0, 1, 0, 5, 0.5)],
        "event_id long, track_edge_id long, src long, dst long, particle_id long, pt double",
    )


def hits(spark):
    return spark.createDataFrame([(1, i, float(i)) for i in range(4)] + [(2, i, 10.0 + i) for i in range(2)], "event_id long, hit_id long, v double")


def test_intersection_and_mappings(spark, rows):
    e, t, h = edges(spark), track_edges(spark), hits(spark)
    assert rows(mapping.label_edges(e, t), "event_id", "edge_id", "y") == [(1, 0, True), (1, 1, False), (1, 2, False), (2, 0, False)]
    linked = mapping.link_track_edges(t, e)
    assert rows(linked, "event_id", "track_edge_id", "edge_id") == [(1, 0, 0), (1, 1, None), (2, 0, None)]
    assert mapping.intersect_graphs(e, t).count() == 6
    assert rows(mapping.nodes_to_edges(e, h, "v", "mean"), "event_id", "edge_id", "v") == [(1, 0, 0.5), (1, 1, 1.5), (1, 2, 1.0), (2, 0, 10.5)]
    assert rows(mapping.tracks_to_edges(e, linked, ["pt"]), "event_id", "edge_id", "pt") == [(1, 0, 2.0), (1, 1, 0.0), (1, 2, 0.0), (2, 0, 0.0)]
    last = mapping.edges_to_nodes(h, e, "score")
    assert rows(last, "event_id", "hit_id", "score") == [(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.0), (2, 0, 0.1), (2, 1, 0.1)]
    at_dst = mapping.edges_to_nodes(h, e, "score", "max")
    assert rows(at_dst, "event_id", "hit_id", "score") == [(1, 0, 0.0), (1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.0), (2, 0, 0.0), (2, 1, 0.1)]
    ends = mapping.map_values("pt", "track", "node", hits=h, track_edges=t, aggr="sum")
    assert rows(ends, "event_id", "hit_id", "pt") == [(1, 0, 2.0), (1, 1, 4.0), (1, 2, 0.0), (1, 3, 2.0), (2, 0, 0.5), (2, 1, 0.5)]
    with pytest.raises(ValueError):
        mapping.map_values("pt", "track", "cluster", track_edges=t)


def test_weights_overwrite_in_order(spark, rows):
    e = mapping.label_edges(edges(spark), track_edges(spark))
    t = mapping.link_track_edges(track_edges(spark), e)
    rules = [
        {"weight": 2.0, "conditions": {"y": True, "pt": [1.0, float("inf")]}},
        {"weight": 0.5, "conditions": {"y": False, "score": [0.5, 1.0]}},
        {"weight": 0.25, "conditions": {"y": False, "v": [2.0, 2.0]}},
    ]
    out = weighting.weight_edges(e, rules, t, hits(spark))
    assert rows(out, "event_id", "edge_id", "weight") == [(1, 0, 2.0), (1, 1, 0.25), (1, 2, 0.25), (2, 0, 1.0)]
    assert rows(weighting.signal_edges(t, rules), "event_id", "track_edge_id") == [(1, 0), (1, 1)]
    with pytest.raises(ValueError):
        weighting.weight_edges(e, [{"weight": 1, "conditions": {"absent": True}}])


def test_cuts(spark, rows):
    e, t = edges(spark), mapping.link_track_edges(track_edges(spark), edges(spark))
    assert cuts.score_cut(e, 0.5).count() == 2 and cuts.score_cut(e, 0.5, "above").count() == 1
    kept, tracks = cuts.hard_edge_cut(e, t, {"pt": [1.0, 9.0]})
    assert rows(kept, "event_id", "edge_id") == [(1, 0)]
    assert rows(tracks, "event_id", "track_edge_id", "edge_id") == [(1, 0, 0), (1, 1, None)]
    nodes, kept_tracks = cuts.hard_node_cut(hits(spark), track_edges(spark), {"pt": [1.0, 9.0]})
    assert rows(nodes, "event_id", "hit_id", "node_id") == [(1, 0, 0), (1, 1, 1), (1, 3, 2)]
    assert rows(kept_tracks, "event_id", "node_src", "node_dst") == [(1, 0, 1), (1, 1, 2)]
    assert rows(cuts.drop_large_events(e, 2), "event_id", "edge_id") == [(2, 0)]
    assert rows(cuts.drop_isolated(hits(spark), e), "event_id", "hit_id") == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]


def test_undirected(spark, rows):
    e = mapping.label_edges(edges(spark), track_edges(spark))
    both = edge_tables.to_undirected(e)
    assert both.count() == 8
    unique, linked = edge_tables.undirected_unique(both, track_edges(spark))
    pairs = unique.select("event_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "y")
    assert rows(pairs) == [(1, 0, 1, True), (1, 0, 2, False), (1, 1, 2, False), (2, 0, 1, False)]
    assert rows(linked, "event_id", "track_edge_id", "edge_id") == [(1, 0, 0), (1, 1, None), (2, 0, 0)]
    decided = edge_tables.directed_decision(both.withColumn("score", F.when(F.col("reversed"), 0.0).otherwise(0.9)), 0.5)
    assert {(r.loose, r.tight) for r in decided.collect()} == {(True, False)}


def test_messages_without_edges_are_zero(spark):
    e = edges(spark).withColumn("e", F.array("score"))
    out = messages.aggregate_messages(hits(spark).select("event_id", "hit_id"), e, "e", 1, ["sum", "std"])
    got = {(r.event_id, r.hit_id): r.message for r in out.collect()}
    assert got[(1, 3)] == [0, 0, 0, 0]
    assert got[(1, 2)] == pytest.approx([0.9, 0.05, 0, 0])
    assert got[(2, 1)] == pytest.approx([0.1, 0, 0, 0])


def test_module_map_cuts_are_strict(spark, rows):
    ids = [1, 2, 3]
    names = [f"{f}{s}_{p}" for p in ("12", "23") for f in ("z0", "dphi", "phiSlope", "deta") for s in ("max", "min")]
    names += [f"diff_{f}_{s}" for f in ("dzdr", "dydx") for s in ("max", "min")]
    limits = [9.0 if "max" in n else -9.0 for n in names]
    schema = "mid_1 long, mid_2 long, mid_3 long, " + ", ".join(f"{n} double" for n in names)
    h = spark.createDataFrame(
        [(e, i, m, float(m), float(m), 0.0, 1.0, 0.5, 0.0) for e in (1, 2) for i, m in enumerate(ids)],
        "event_id long, hit_id long, module_id long, r double, x double, y double, z double, eta double, phi double",
    )

    def build(**changed):
        row = [changed.get(n, v) for n, v in zip(names, limits)]
        parts = module_map.module_map_parts(spark.createDataFrame([(*ids, *row)], schema))
        first, second = module_map.doublets(h, parts[0], True), module_map.doublets(h, parts[1], False)
        return module_map.edges_of_triplets(module_map.triplets(first, second, parts[2]))

    whole = [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 2)]
    assert rows(build()) == whole
    assert rows(build(detamax_12=0.0)) == []  # a value equal to a bound is outside
    assert rows(build(diff_dzdr_min=0.0)) == []
    assert rows(build(z0max_23=1.0)) == []


@pytest.mark.parametrize("low,high", [(-0.3, 0.2), (-9.0, 9.0), (2.9, 3.5)])
def test_doublets_by_bins_of_the_angle(spark, low, high):
    """The same pairs as by testing all, also where the angle passes pi."""
    rng = np.random.default_rng(int(abs(low) * 1000))
    phi = [*np.round(rng.uniform(-np.pi, np.pi, 60), 3), np.pi, -np.pi, 3.14, -3.14, 3.1, -3.1]
    data = [(1, i, 1 + i % 2, 1.0 + i % 2, 0.0, 0.0, 0.0, 0.0, float(p)) for i, p in enumerate(phi)]
    h = spark.createDataFrame(data, "event_id long, hit_id long, module_id long, r double, x double, y double, z double, eta double, phi double")
    cuts = {f"{n}{s}": b for n in ("z0", "phiSlope", "deta") for s, b in (("min", -99.0), ("max", 99.0))}
    for first, suffix in ((True, "_12"), (False, "_23")):
        other, mids = ("mid_1", (1, 2, 2)) if first else ("mid_3", (2, 2, 1))
        rows = [(*mids, *cuts.values(), low, high), (mids[0], 2, mids[2], *cuts.values(), low, (low + high) / 2)]
        names = [f"{c}{suffix}" for c in [*cuts, "dphimin", "dphimax"]]
        maps = spark.createDataFrame(rows, "mid_1 long, mid_2 long, mid_3 long, " + ", ".join(f"{n} double" for n in names)).select("mid_2", other, *names)
        want = []
        for _, i, m, *_, p in data:
            for _, j, n, *_, q in data:
                if (m, n) == (2, 1):  # middle i, outer j
                    d = p - q if first else q - p
                    d = d - 2 * np.pi if d > np.pi else d + 2 * np.pi if d < -np.pi else d
                    want += [(i, j)] * ((low < d < high) + (low < d < (low + high) / 2))
        found = module_map.doublets(h, maps, first)
        assert sorted((r.hit_id_m, r.hit_id_o) for r in found.collect()) == sorted(want)
        if high - low < 0.6 and want:
            work = module_map.doublet_work(h, maps, first).first()
            assert work.n_compared < 0.6 * work.n_all


def test_hooks():
    @hooks.register("processing", "test_double")
    def double(h, p, t):
        return h + h, p, t

    assert hooks.process(["test_double"], 1, 2, 3) == (2, 2, 3)
    with pytest.raises(KeyError):
        hooks.get("graph", "absent")
    with pytest.raises(ValueError):
        hooks.register("odd", "x")


def test_components_that_meet_in_a_task_need_no_rounds(spark, monkeypatch):
    """Chains are contracted before the rounds; cut into small batches and blocks they get the same labels."""
    from hitweave.operators import components as CC

    rows = [(e, h, h + 7) for e in (1, 2) for h in range(300)]
    edges = spark.createDataFrame(rows, "event_id long, src long, dst long")
    rounds, star = [], CC._large_star
    monkeypatch.setattr(CC, "_large_star", lambda pairs: rounds.append(1) or star(pairs))
    want = {(e, h, h % 7) for e in (1, 2) for h in range(307)}
    assert {tuple(r) for r in CC.component_labels(edges).collect()} == want and len(rounds) == 1
    monkeypatch.setattr(CC, "BLOCK", 16)
    monkeypatch.setattr(CC, "BATCH", 1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "8")
    try:
        assert {tuple(r) for r in CC.component_labels(edges).collect()} == want and len(rounds) > 2
    finally:
        spark.conf.unset(size)


def test_an_event_over_several_batches_leaves_as_one_star(spark, monkeypatch):
    """A batch that ends within an event must not leave its components to the rounds."""
    from hitweave.operators import components as CC

    rows = [(e, h, h + 1) for e in range(5) for h in range(100)]
    pairs = spark.createDataFrame(rows, "event_id long, v long, u long").select("event_id", "u", "v").coalesce(1)
    monkeypatch.setattr(CC, "BATCH", 250)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "30")
    try:
        got = sorted(tuple(r) for r in CC._contracted(pairs).collect())
    finally:
        spark.conf.unset(size)
    assert got == [(e, h, 0) for e in range(5) for h in range(1, 101)]
