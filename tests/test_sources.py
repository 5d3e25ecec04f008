import os

import pytest
from pyspark.sql import functions as F

from hitweave.operators import checks
from hitweave.sources import files, nested, schemas, sinks, text_dumps


def write(path, text):
    path.write_text(text)
    return str(path)


def test_particle_and_spacepoint_files(spark, tmp_path):
    write(tmp_path / "event000000003-particles.txt", "0,17,1,2,3,4,5,6,7,8,9,1,-1,211,OK,1,2,3,4,#,9,9,#\n")
    p = text_dumps.parse_particles(text_dumps.read_lines(spark, f"{tmp_path}/*-particles.txt")).first()
    assert (p.event_id, p.barcode, p.charge, p.pdgId, p["pass"], p.vProdBarcode) == (3, 17, -1.0, 211, "OK", 4)
    write(tmp_path / "event000000003-spacepoints.txt", "5,1.0,2.0,3.0,7,\n9,1,2,3,8,4\n")
    lines = text_dumps.read_lines(spark, f"{tmp_path}/*-spacepoints.txt")
    s = text_dumps.renumber_spacepoints(text_dumps.parse_spacepoints(lines)).orderBy("hit_id").collect()
    assert [(r.hit_id, r.cluster_index_1, r.cluster_index_2) for r in s] == [(0, 7, 7), (1, 8, 4)]


def test_cluster_lines_need_known_shape(spark):
    good = "1,PIXEL,1,2,3,#,0,1,2,3,0,#,(0,17),(1,4),#,1,#,0.1,0.2,#,1,0,0,#,c"
    df = spark.createDataFrame([(1, good)], "event_id long, value string")
    row = text_dumps.parse_clusters(df).first()
    assert (row.cluster_id, row.links, row.eta_angle, row["count"]) == (1, "(0,17),(1,4)", 0.1, None)
    bad = spark.createDataFrame([(1, good.replace("0.1,0.2", "0.1,0.2,0.3"))], "event_id long, value string")
    with pytest.raises(Exception, match="2 or 14 fields"):
        text_dumps.parse_clusters(bad).collect()


def test_event_discovery_needs_every_term(spark, tmp_path):
    for name in ("event000000001-truth.csv", "event000000001-particles.csv", "event000000002-truth.csv"):
        write(tmp_path / name, "a\n1\n")
    found = files.event_files(spark, str(tmp_path), ["truth", "particles"]).collect()
    assert sorted((r.event_id, r.term) for r in found) == [(1, "particles"), (1, "truth")]
    table = files.read_event_csv(spark, f"{tmp_path}/*-truth.csv", "a int")
    assert sorted((r.event_id, r.a) for r in table.collect()) == [(1, 1), (2, 1)]


def test_module_lookup_and_branches(spark, tmp_path):
    row = "PIXEL 0 1 2 3 1.0 2.0 3.0 99 0\n"
    path = write(tmp_path / "lookup.txt", row + row + row.replace(" 0\n", " 1\n"))
    lookup = text_dumps.clean_module_lookup(text_dumps.read_module_lookup(spark, path)).collect()
    assert [(r.hardware, r.ID) for r in lookup] == [("PIXEL", 99)]
    branches = spark.createDataFrame([(4, [0, 1], [5, 6], [-1, 2])], "event_id int, SPindex array<int>, SPCL1_index array<int>, SPCL2_index array<int>")
    points = nested.clean_nested_spacepoints(nested.flatten_branches(branches)).orderBy("hit_id").collect()
    assert [(r.event_id, r.hit_id, r.cluster_index_2) for r in points] == [(4, 0, 5), (4, 1, 2)]
    with pytest.raises(ValueError, match="unknown branches"):
        schemas.rename_branches(branches.withColumnRenamed("SPindex", "odd"))
    assert len(schemas.MODULE_MAP_COLUMNS) == 24


def test_assignment_split_and_first(spark):
    entries = spark.createDataFrame(
        [(1, "train", 0, "a", 0), (1, "test", 5, "b", 1), (2, "train", 1, "a", 0)],
        "event_id long, dataset string, entry int, file string, ordinal int",
    )
    assert sorted((r.event_id, r.dataset, r.entry) for r in files.assign_events(entries).collect()) == [
        (1, "test", 5),
        (2, "train", 1),
    ]
    assert [r.event_id for r in files.overlapping_events(entries).collect()] == [1]
    events = spark.range(100).withColumnRenamed("id", "event_id")
    split = files.split_events(events, {"a": 0.8, "b": 0.1, "c": None})
    again = files.split_events(events, {"a": 0.8, "b": 0.1, "c": None})
    assert {r.dataset: r["count"] for r in split.groupBy("dataset").count().collect()} == {"a": 80, "b": 10, "c": 10}
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))
    fixed = files.split_events(events, counts={"a": 5, "b": 3})
    assert fixed.count() == 8
    assert files.first_events(events, 3).count() == 3
    with pytest.raises(ValueError):
        files.first_events(events, 101, require=True)


def test_sinks_round_trip(spark, tmp_path):
    hits = spark.createDataFrame([("train", 1, 0, 1.5), ("train", 2, 0, 2.5)], "dataset string, event_id long, hit_id long, x double")
    sinks.write_event_csv(hits, f"{tmp_path}/csv")
    back = spark.read.option("header", "true").csv(f"{tmp_path}/csv")
    assert sorted((r.dataset, int(r.event_id), float(r.x)) for r in back.collect()) == [("train", 1, 1.5), ("train", 2, 2.5)]
    edges = spark.createDataFrame([("train", 1, 0, 1)], "dataset string, event_id long, src long, dst long")
    sinks.write_graph(hits, edges, edges, f"{tmp_path}/graph", {"cut": 0.5})
    assert spark.read.parquet(f"{tmp_path}/graph/nodes").first().config == '{"cut": 0.5}'
    tracks = spark.createDataFrame([(1, 3, 0), (1, 1, 0), (1, 2, -1), (1, 9, 4)], "event_id long, hit_id long, track_id long")
    sinks.write_track_lines(tracks, f"{tmp_path}/tracks")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/tracks").collect()) == ["1 3", "9"]


def test_one_file_per_event(spark, tmp_path):
    path = f"{tmp_path}/files"
    hits = spark.createDataFrame([(e, h, 0.5 * h) for e in (1, 23) for h in (4, 2, 9)], "event_id long, hit_id long, z double")
    sinks.write_event_files(hits.repartition(3), path, "event{:09d}-truth.csv", "csv", ["hit_id"])
    names = lambda: sorted(n for n in os.listdir(path) if not n.startswith("."))
    assert names() == ["event000000001-truth.csv", "event000000023-truth.csv"]
    assert open(f"{path}/event000000023-truth.csv").read().split() == ["hit_id,z", "2,1.0", "4,2.0", "9,4.5"]
    # written again: the file is replaced; a failing job leaves what was there and nothing else
    sinks.write_event_files(hits.where("hit_id = 2"), path, "event{:09d}-truth.csv", "csv", ["hit_id"])
    bad = hits.withColumn("z", F.when(F.col("hit_id") == 9, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("z")))
    with pytest.raises(Exception, match="broken"):
        sinks.write_event_files(bad, path, "event{:09d}-new.csv", "csv", ["hit_id"])
    assert names() == ["event000000001-truth.csv", "event000000023-truth.csv"]
    assert open(f"{path}/event000000001-truth.csv").read().split() == ["hit_id,z", "2,1.0"]
    tracks = spark.createDataFrame([(7, 3, 0), (7, 1, 0), (7, 2, -1), (7, 9, 4), (7, 8, 10)], "event_id long, hit_id long, track_id long")
    sinks.write_track_files(tracks.repartition(4), f"{tmp_path}/tracks")
    assert open(f"{tmp_path}/tracks/event000000007.txt").read() == "1 3\n9\n8\n"


def test_event_files_are_listed_once(spark, tmp_path):
    hits = spark.createDataFrame([(e, h) for e in (1, 2, 3) for h in (5, 4)], "event_id long, hit_id long")
    for name in ("truth", "other"):
        sinks.write_event_files(hits, f"{tmp_path}", "event{:09d}-" + name + ".csv", "csv", ["hit_id"])
    read = files.read_event_csv(spark, f"{tmp_path}/*-truth.csv", "hit_id long", number="event([0-9]+)-truth")
    assert "InMemoryFileIndex(1 paths)" in read._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in read.collect()) == [(e, h) for e in (1, 2, 3) for h in (4, 5)]


def test_written_graph_is_checked(spark, tmp_path):
    hits = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "dataset string, event_id long, hit_id long")
    edges = spark.createDataFrame([("a", 1, 0, 1, 1.0), ("b", 2, 0, 1, None)], "dataset string, event_id long, src long, dst long, weight double")
    tracks = spark.createDataFrame([("a", 1, 0, 1, 5), ("b", 2, 0, 1, 6)], "dataset string, event_id long, src long, dst long, track_edge_id long")
    with pytest.raises(ValueError, match="1 rows of edges in b have no weight"):
        checks.write_checked_graph(hits, edges, tracks, f"{tmp_path}/g1", {}, ["a", "b"])
    full = edges.fillna(1.0, ["weight"])
    with pytest.raises(ValueError, match="nodes of c is empty"):
        checks.write_checked_graph(hits, full, tracks, f"{tmp_path}/g2", {}, ["a", "c"])
    counted = checks.write_checked_graph(hits, full, tracks, f"{tmp_path}/g3", {}, ["a", "b"])
    assert counted["edges"] == {"n_rows": 2, "n_a": 1, "n_b": 1, "without_a": 0, "without_b": 0}


def test_coerce_leaves_other_columns(spark):
    df = spark.createDataFrame([("7", "x")], "cluster_index_1 string, other string")
    out = schemas.coerce(df, schemas.SPACEPOINT_TYPES)
    assert out.dtypes == [("cluster_index_1", "bigint"), ("other", "string")]
