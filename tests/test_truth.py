"""Two events reuse the same ids throughout: a missing event key shows at once."""

import pytest
from pyspark.sql import functions as F

from hitweave.operators import checks, truth, truth_edges
from hitweave.operators import detector as D
from hitweave.plans.ingest import IngestConfig, build_event_graph


def particles(spark):
    return spark.createDataFrame(
        [(1, 0, 5, 1.0), (1, 0, 123, -1.0), (2, 0, 5, 0.0), (2, 3, 7, 1.0)],
        "event_id long, subevent long, barcode long, charge double",
    )


def clusters(spark):
    return spark.createDataFrame(
        [(1, 1, "(0,5)"), (1, 2, "(0,5),(0,123)"), (1, 3, ""), (1, 4, "(9,9)"), (2, 1, "(0,5)"), (2, 2, "(3,7)")],
        "event_id long, cluster_id long, links string",
    )


def test_ids_links_and_detectable(spark, rows):
    numbered = truth.particle_ids(particles(spark))
    assert rows(numbered, "event_id", "particle_id") == [(1, 5), (1, 123), (2, 5), (2, 37)]
    expanded = truth.expand_clusters(clusters(spark), truth.split_links(clusters(spark)), numbered)
    assert rows(expanded, "event_id", "cluster_id", "particle_id") == [
        (1, 0, 5), (1, 1, 5), (1, 1, 123), (1, 2, 0), (1, 3, 0), (2, 0, 5), (2, 1, 37),
    ]
    found = truth.detectable_particles(numbered, expanded)
    assert rows(found, "event_id", "particle_id", "num_clusters") == [(1, 5, 2), (1, 123, 1), (2, 37, 1)]


def test_match_and_clean(spark, rows):
    c = spark.createDataFrame(
        [(1, 0, 5), (1, 0, 0), (1, 1, 5), (1, 2, 9), (2, 0, 4)], "event_id long, cluster_id long, particle_id long"
    )
    s = spark.createDataFrame(
        [(1, 0, 0, 1), (1, 1, 0, 2), (1, 2, 7, 7), (2, 0, 0, 0)],
        "event_id long, hit_id long, cluster_index_1 long, cluster_index_2 long",
    )
    cleaned = truth.clean_spacepoints(truth.match_spacepoints(s, c))
    assert rows(cleaned, "event_id", "hit_id", "particle_id") == [(1, 0, 5), (1, 1, 0), (1, 2, 0), (2, 0, 4)]
    masked = truth.mask_undetectable(cleaned, spark.createDataFrame([(1, 5)], "event_id long, particle_id long"))
    assert rows(masked, "event_id", "hit_id", "particle_id") == [(1, 0, 5), (1, 1, 0), (1, 2, 0), (2, 0, 0)]


def test_regions_and_modules_fail_loudly(spark, rows):
    hits = spark.createDataFrame([(1, "PIXEL", 0), (2, "STRIP", 2)], "hit_id int, hardware string, barrel_endcap int")
    both = {1: {"hardware": "PIXEL"}, 2: {"barrel_endcap": [0, 2]}}
    assert rows(hits.select("hit_id", truth.region_label(both).alias("r"))) == [(1, 2), (2, 2)]
    with pytest.raises(Exception, match="outside every region"):
        hits.select(truth.region_label({1: {"hardware": "PIXEL"}})).collect()
    module = "hardware string, barrel_endcap int, layer_disk int, eta_module int, phi_module int"
    wide = spark.createDataFrame([("PIXEL", 0, 1, 1, 1)], module)
    ambiguous = spark.createDataFrame([("PIXEL", 0, 1, 1, 1, 7), ("PIXEL", 0, 1, 1, 1, 8)], module + ", ID int")
    with pytest.raises(Exception, match="unknown or ambiguous module"):
        truth.add_module_id(wide, ambiguous).collect()
    assert truth.add_module_id(wide, ambiguous.where("ID = 7")).first().module_id == 7


def hits(spark):
    data = [
        (1, 0, 5, 10, 1.0), (1, 1, 5, 10, 1.1), (1, 2, 5, 11, 2.0), (1, 3, 5, 12, 3.0), (1, 4, 0, 11, 2.5),
        (2, 0, 5, 12, 1.0), (2, 1, 5, 10, 2.0), (2, 2, 6, 10, 1.0),
    ]
    return spark.createDataFrame(data, "event_id long, hit_id long, particle_id long, module_id long, x double").withColumns(
        {"y": F.lit(0.0), "z": F.lit(0.0)}
    )


def test_truth_edges(spark, rows):
    p = spark.createDataFrame(
        [(1, 5, 1.5, 0.0), (2, 5, 2.5, 0.0), (2, 6, 0.1, 0.0)], "event_id long, particle_id long, pt double, vx double"
    ).withColumns({"vy": F.lit(0.0), "vz": F.lit(0.0)})
    full = truth.add_production_distance(truth.add_particles(hits(spark), p, ["pt"]))
    assert rows(full, "event_id", "hit_id", "nhits") == [
        (1, 0, 4), (1, 1, 4), (1, 2, 4), (1, 3, 4), (1, 4, -1), (2, 0, 2), (2, 1, 2), (2, 2, 1),
    ]
    edges = truth_edges.build_truth_edges(full, ["module_id"], ["pt"])
    assert rows(edges, "event_id", "src", "dst", "pt") == [(1, 0, 2, 1.5), (1, 1, 2, 1.5), (1, 2, 3, 1.5), (2, 0, 1, 2.5)]
    marked = truth_edges.mark_redundant(edges)
    assert rows(marked.where("redundant_split_edges"), "event_id", "src", "dst") == [(1, 1, 2)]
    assert truth_edges.inconsistent_features(edges, full, ["pt"]).count() == 0
    assert checks.noise_on_track_edges(full, edges).count() == 0
    nodes, remapped = truth_edges.remap_nodes(full.where("hit_id <> 1"), edges.where("src <> 1 and dst <> 1"))
    assert rows(nodes, "event_id", "hit_id", "node_id") == [
        (1, 0, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 0, 0), (2, 2, 1),
    ]
    assert rows(remapped, "event_id", "node_src", "node_dst") == [(1, 0, 1), (1, 1, 2)]


@pytest.fixture
def no_broadcasts(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_plan(df, step):
    return df._jdf.queryExecution().executedPlan().toString().count(step)


def test_edges_of_particles_take_one_shuffle(spark, rows, no_broadcasts):
    h = hits(spark).withColumn("big_r", F.col("x"))
    edges = truth_edges.mark_redundant(truth_edges.build_truth_edges(h, ["module_id"], []))
    assert in_plan(edges, "Exchange hashpartitioning") == 1
    assert rows(edges, "event_id", "src", "dst", "redundant_split_edges") == [
        (1, 0, 2, False), (1, 1, 2, True), (1, 2, 3, False), (2, 0, 1, False),
    ]


def test_points_are_matched_once(spark, rows, no_broadcasts):
    c = spark.createDataFrame([(1, 0, 5), (1, 0, 6), (1, 1, 5)], "event_id long, cluster_id long, particle_id long")
    s = spark.createDataFrame(
        [(1, 0, 0, 0), (1, 0, 1, 0), (1, 1, 1, 9), (None, None, 3, 3), (1, None, 0, 0), (1, None, 9, 9)],
        "event_id long, hit_id long, cluster_index_1 long, cluster_index_2 long",
    )
    cleaned = truth.clean_spacepoints(truth.match_spacepoints(s, c))
    assert in_plan(cleaned, "SortMergeJoin") == 1
    # Missing numbers are -1, which is one hit of an event.
    assert rows(cleaned, "event_id", "hit_id", "cluster_index_1", "particle_id") == [
        (-1, -1, 3, 0), (1, -1, 0, 5), (1, -1, 0, 6), (1, 0, 0, 5), (1, 0, 0, 6), (1, 0, 1, 5), (1, 1, 1, 0),
    ]


def test_missing_particles_are_noise_of_the_graph(spark, rows):
    modules = {"barrel_endcap": 0, "hardware": "PIXEL", "layer_disk": 0, "eta_module": 0}
    t = spark.createDataFrame(
        [(1, 0, 5, 1.0, 0), (1, 1, 5, 2.0, 1), (1, 1, None, 2.0, 1), (1, 2, None, 3.0, 2), (1, 2, 0, 3.0, 2)],
        "event_id long, hit_id long, particle_id long, x double, phi_module int",
    ).withColumns({**{k: F.lit(v) for k, v in modules.items()}, "y": F.lit(0.0), "z": F.lit(0.0)})
    p = spark.createDataFrame([(1, 5, 1.0, 0.0, 0.0, 0.0)], "event_id long, particle_id long, charge double, vx double, vy double, vz double")
    nodes, edges = build_event_graph(t, p, IngestConfig(regions={}, track_features=("charge",)))
    assert rows(nodes, "event_id", "hit_id", "particle_id", "nhits", "node_id") == [(1, 0, 5, 2, 0), (1, 1, 5, 2, 1), (1, 2, 0, -1, 2)]
    assert rows(edges, "event_id", "src", "dst", "particle_id", "node_src", "node_dst") == [(1, 0, 1, 5, 0, 1)]


def test_unique_edges_and_orientation(spark, rows):
    e = spark.createDataFrame([(1, 0, 1, 9), (1, 0, 1, 4), (2, 0, 1, 9)], "event_id long, src long, dst long, particle_id long")
    assert rows(truth_edges.unique_edges(e), "event_id", "src", "dst", "particle_id") == [(1, 0, 1, 4), (2, 0, 1, 9)]
    assert rows(checks.shared_edges(e)) == [(1, 1), (2, 0)]
    h = spark.createDataFrame(
        [(1, 0, 5.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 4.0, 3.0), (2, 0, 1.0, 0.0), (2, 1, 2.0, 0.0)],
        "event_id long, hit_id long, r double, z double",
    )
    e = spark.createDataFrame([(1, 0, 1), (1, 2, 0), (2, 0, 1)], "event_id long, src long, dst long")
    assert rows(truth_edges.orient_outward(e, h)) == [(1, 1, 0), (1, 2, 0), (2, 0, 1)]
    assert rows(truth_edges.orient_outward(e, h, ties_by_id=True)) == [(1, 0, 2), (1, 1, 0), (2, 0, 1)]


def test_measurements(spark, rows):
    detector = spark.createDataFrame(
        [(70, 1, 2, 3, 1.0, 2.0, 3.0, *([1.0, 0.0, 0.0] + [0.0, 1.0, 0.0] + [0.0, 0.0, 1.0]))],
        "geometry_id long, volume_id long, layer_id long, module_id long, cx double, cy double, cz double,"
        + ", ".join(f"rot_{a}{b} double" for a in "xyz" for b in "uvw"),
    )
    m = spark.createDataFrame(
        [(1, 0, 70, 0.5, 0.25), (1, 1, 99, 0.0, 0.0)], "event_id long, measurement_id long, geometry_id long, local0 double, local1 double"
    )
    hit_map = spark.createDataFrame([(1, 0, 4), (1, 0, 6)], "event_id long, measurement_id long, hit_id long")
    sim = spark.createDataFrame([(1, 6, 11), (1, 4, 12)], "event_id long, hit_id long, particle_id long")
    out = D.measurements_to_hits(m, detector, hit_map, sim)
    assert rows(out, "measurement_id", "x", "y", "z", "hit_id", "particle_id") == [(0, 1.5, 2.25, 3.0, 6, 11)]


def test_checks(spark):
    h = hits(spark)
    checks.check_columns(h, ["event_id", "x"])
    with pytest.raises(ValueError):
        checks.check_columns(h, ["absent"])
    with pytest.warns(UserWarning):
        checks.check_columns(h, [], ["absent"])
    with pytest.raises(ValueError):
        checks.require_rows({"empty": h.where("false")})
