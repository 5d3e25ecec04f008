"""Queries over whole chains, data checks and incremental ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.conditions import all_of
from ..operators import checks as Q
from ..operators import evaluation as EV
from ..operators import truth_edges as W
from ..operators.joins import E
from ..operators import truth as T
from ..plans import graphs as P
from ..plans import hooks
from ..plans.evaluation import scoring_report
from ..plans.ingest import IngestConfig, build_event_graph, build_truth
from ..session import checkpoint_root
from ..sources import adapters as A
from ..streaming.ingest import ingest_stream
from .graph_tables import RULES, TYPE_GROUPS, graph, plain_track_edges, weighted_edges
from .registry import query, rnd
from .sqltables import cte, with_tables
from .truth_tables import REGION_SQL, REGIONS, hit_features, numbered_particles, spacepoints, truth_edges, truth_hits

INF = float("inf")
cte("masked", """
SELECT t.* EXCLUDE (particle_id), CASE WHEN d.particle_id IS NULL THEN 0 ELSE t.particle_id END AS particle_id
FROM truth t LEFT JOIN (SELECT DISTINCT event_id, particle_id FROM detectable) d
ON d.event_id = t.event_id AND d.particle_id = t.particle_id""", "truth", "detectable")
MODULE = "barrel_endcap, hardware, layer_disk, eta_module, phi_module"
cte("chain_hits", """
SELECT h.*, sqrt((h.x - p.vx) * (h.x - p.vx) + (h.y - p.vy) * (h.y - p.vy) + (h.z - p.vz) * (h.z - p.vz)) AS big_r, p.charge
FROM masked h JOIN detectable p USING (event_id, particle_id) WHERE particle_id <> 0""", "masked", "detectable")
cte("chain_steps", f"""
SELECT event_id, particle_id, m, LEAD(m) OVER (PARTITION BY event_id, particle_id ORDER BY f, m) AS nm FROM (
  SELECT event_id, particle_id, ({MODULE}) AS m, MIN((big_r, hit_id)) AS f FROM chain_hits GROUP BY ALL)""", "chain_hits")
cte("chain_edges", f"""
SELECT s.event_id, a.hit_id AS src, b.hit_id AS dst, MIN(s.particle_id) AS particle_id
FROM chain_steps s JOIN chain_hits a ON a.event_id = s.event_id AND a.particle_id = s.particle_id
  AND (a.barrel_endcap, a.hardware, a.layer_disk, a.eta_module, a.phi_module) = s.m
JOIN chain_hits b ON b.event_id = s.event_id AND b.particle_id = s.particle_id
  AND (b.barrel_endcap, b.hardware, b.layer_disk, b.eta_module, b.phi_module) = s.nm
GROUP BY ALL""", "chain_steps")
CONFIG = IngestConfig(regions=REGIONS, track_features=("charge",))


def ingested(spark, sf_dir):
    clusters = A.raw_clusters(spark, sf_dir)
    return build_truth(
        A.raw_particles(spark, sf_dir), clusters, T.split_links(clusters), spacepoints(spark, sf_dir),
        A.module_lookup(spark, sf_dir), CONFIG,
    )


@query(
    "chain_truth_table",
    with_tables(
        "masked",
        "module_lookup",
        body=f"""SELECT t.event_id, t.hit_id, t.particle_id, {REGION_SQL} AS region, m.module_id FROM masked t
LEFT JOIN module_lookup m USING ({MODULE})""",
    ),
)
def chain_truth_table(spark, sf_dir):
    """Dumps to truth hits: ids, clusters, truth match, cleaning, masking, regions, modules."""
    truth, _ = ingested(spark, sf_dir)
    return truth.select(E, "hit_id", "particle_id", "region", "module_id")


@query("chain_event_graph", with_tables("chain_edges", body="SELECT event_id, src, dst, particle_id FROM chain_edges"))
def chain_event_graph(spark, sf_dir):
    """The same on to truth-track edges by the five module columns."""
    truth, particles = ingested(spark, sf_dir)
    _, edges = build_event_graph(truth, particles, CONFIG)
    return edges.select(E, "src", "dst", "particle_id")


# ---- G15: preprocessing chains -------------------------------------------------
cte("te_hard", "SELECT * FROM te WHERE pt BETWEEN 1.0 AND 1e9", "te")
cte("te_hard_nodes", "SELECT event_id, src AS hit_id FROM te_hard UNION SELECT event_id, dst FROM te_hard", "te_hard")
cte("hard_edges", """
SELECT l.*, CASE WHEN NOT l.y AND l.score BETWEEN 0.5 AND 10 THEN 0.25
  WHEN l.y AND COALESCE(t.pdg_id IN (11, -11), FALSE) THEN -1.0
  WHEN l.y AND t.pt IS NOT NULL AND COALESCE(t.nhits BETWEEN 3 AND 1e9, FALSE) THEN 2.0
  WHEN l.y THEN 0.0 ELSE 1.0 END::DOUBLE AS weight
FROM ledges l LEFT JOIN te_hard t ON t.event_id = l.event_id AND t.edge_id = l.edge_id
WHERE EXISTS (SELECT 1 FROM te_hard_nodes n WHERE n.event_id = l.event_id AND n.hit_id = l.src)
  AND EXISTS (SELECT 1 FROM te_hard_nodes n WHERE n.event_id = l.event_id AND n.hit_id = l.dst)""",
    "ledges", "te_hard", "te_hard_nodes")


@query(
    "g15_base_chain",
    with_tables(
        "hard_edges",
        "hit_features",
        body="""SELECT e.event_id, e.edge_id, e.weight, round(b.r - a.r, 6) + 0.0 AS dr, round(b.z - a.z, 6) + 0.0 AS dz
FROM hard_edges e JOIN hit_features a ON a.event_id = e.event_id AND a.hit_id = e.src
JOIN hit_features b ON b.event_id = e.event_id AND b.hit_id = e.dst WHERE e.score >= 0.4""",
    ),
)
def g15_base_chain(spark, sf_dir):
    """Hard cut, weights, input cut, edge features, scaling."""
    _, edges, _ = P.prepare_edges(
        hit_features(spark, sf_dir),
        *graph(spark, sf_dir),
        hard_cuts={"pt": [1.0, INF]},
        rules=RULES,
        input_cut=0.4,
        scales={"r": 1000.0, "z": 1000.0},
        features=["dr", "dz"],
    )
    return edges.select(E, "edge_id", "weight", rnd("dr").alias("dr"), rnd("dz").alias("dz"))


@query(
    "g15_heterogeneous_chain",
    with_tables(
        "hard_edges",
        "typed_hits",
        "te_hard",
        body="""
, n AS (SELECT event_id, src AS hit_id FROM te_hard UNION SELECT event_id, dst FROM te_hard)
SELECT h.event_id, h.hit_id, h.node_type_name, n.hit_id IS NOT NULL AS y_node, COUNT(e.edge_id) AS n_out
FROM typed_hits h LEFT JOIN n ON n.event_id = h.event_id AND n.hit_id = h.hit_id
LEFT JOIN hard_edges e ON e.event_id = h.event_id AND e.src = h.hit_id GROUP BY ALL""",
    ),
)
def g15_heterogeneous_chain(spark, sf_dir):
    """Typed chain with node truth: types of all hits, and out-degrees of the typed edges."""
    hits, edges, _ = P.prepare_heterogeneous(
        hit_features(spark, sf_dir),
        *graph(spark, sf_dir),
        TYPE_GROUPS,
        ["r", "phi", "z"],
        node_truth=True,
        hard_cuts={"pt": [1.0, INF]},
        rules=RULES,
    )
    out = edges.groupBy(E, F.col("src").alias("hit_id")).agg(F.count("*").alias("n_out"))
    return hits.select(E, "hit_id", "node_type_name", "y_node").join(out, [E, "hit_id"], "left").fillna(0, ["n_out"])


@query(
    "g15_directed_chain",
    with_tables(
        "hard_edges",
        "hit_features",
        "typed_hits",
        body="""
, d AS (SELECT e.event_id, e.edge_id, a.hit_id AS s, b.hit_id AS t,
  (a.r / 100) * (a.r / 100) + (a.z / 100) * (a.z / 100) > (b.r / 100) * (b.r / 100) + (b.z / 100) * (b.z / 100) AS inward
FROM hard_edges e JOIN hit_features a ON a.event_id = e.event_id AND a.hit_id = e.src
JOIN hit_features b ON b.event_id = e.event_id AND b.hit_id = e.dst),
o AS (SELECT event_id, edge_id, CASE WHEN inward THEN t ELSE s END AS src, CASE WHEN inward THEN s ELSE t END AS dst FROM d)
SELECT o.event_id, o.edge_id, o.src, o.dst, p.node_type_name || '__to__' || q.node_type_name AS edge_type_name
FROM o JOIN typed_hits p ON p.event_id = o.event_id AND p.hit_id = o.src
JOIN typed_hits q ON q.event_id = o.event_id AND q.hit_id = o.dst""",
    ),
)
def g15_directed_chain(spark, sf_dir):
    _, edges, _ = P.prepare_heterogeneous(
        hit_features(spark, sf_dir),
        *graph(spark, sf_dir),
        TYPE_GROUPS,
        ["r", "phi", "z"],
        directed=True,
        hard_cuts={"pt": [1.0, INF]},
        rules=RULES,
        scales={"r": 100.0, "z": 100.0},
    )
    return edges.select(E, "edge_id", "src", "dst", "edge_type_name")


@query(
    "g15_metric_chain",
    with_tables(
        "te_ends",
        "hit_features",
        body="""
, k AS (SELECT event_id, hit_id FROM (SELECT event_id, hit_id, arg_max(pt BETWEEN 1.0 AND 1e9,
  place * 1000000 + track_edge_id) AS ok FROM te_ends GROUP BY ALL) WHERE ok)
SELECT h.event_id, h.hit_id, ROW_NUMBER() OVER (PARTITION BY h.event_id ORDER BY h.hit_id) - 1 AS node_id,
       round(h.r / 1000, 6) + 0.0 AS r FROM hit_features h JOIN k USING (event_id, hit_id)""",
    ),
)
def g15_metric_chain(spark, sf_dir):
    nodes, _ = P.prepare_metric(
        hit_features(spark, sf_dir), plain_track_edges(spark, sf_dir), {"pt": [1.0, INF]}, {"r": 1000.0}
    )
    return nodes.select(E, "hit_id", "node_id", rnd("r").alias("r"))


@query(
    "g15_tracks_chain",
    with_tables("hard_edges", body="SELECT event_id, edge_id, weight FROM hard_edges"),
)
def g15_tracks_chain(spark, sf_dir):
    edges, _ = P.prepare_tracks(
        *graph(spark, sf_dir), {"pt": [1.0, INF]}, RULES
    )
    return edges.select(E, "edge_id", "weight")


@query(
    "g15_undirected_chain",
    with_tables(
        "hard_edges",
        "typed_hits",
        body="""
, u AS (SELECT event_id, edge_id, src, dst, FALSE AS reversed, weight FROM hard_edges
  UNION ALL SELECT event_id, edge_id, dst, src, TRUE, weight FROM hard_edges)
SELECT u.event_id, u.edge_id, u.src, u.dst, u.reversed, u.weight, p.node_type_name || '__to__' || q.node_type_name AS edge_type_name
FROM u JOIN typed_hits p ON p.event_id = u.event_id AND p.hit_id = u.src
JOIN typed_hits q ON q.event_id = u.event_id AND q.hit_id = u.dst""",
    ),
)
def g15_undirected_chain(spark, sf_dir):
    """D6 first: edges and track edges in both directions, then cut, weights and types."""
    _, edges, _ = P.prepare_heterogeneous(
        hit_features(spark, sf_dir),
        *graph(spark, sf_dir),
        TYPE_GROUPS,
        ["r", "phi", "z"],
        undirected=True,
        hard_cuts={"pt": [1.0, INF]},
        rules=RULES,
    )
    return edges.select(E, "edge_id", "src", "dst", "reversed", "weight", "edge_type_name")


# ---- data checks ---------------------------------------------------------------
@query(
    "q2_q5_written_graph",
    with_tables(
        "hits",
        "ledges",
        "te",
        body="""
, d AS (SELECT unnest(['even', 'odd']) AS dataset, unnest([0, 1]) AS part),
t AS (SELECT 'nodes' AS name, event_id % 2 AS part, 0 AS lost FROM hits
  UNION ALL SELECT 'edges', event_id % 2, 0 FROM ledges UNION ALL SELECT 'track_edges', event_id % 2, 0 FROM te)
SELECT n.name AS "table", d.dataset, COUNT(t.part) AS n_rows, 0::BIGINT AS n_without
FROM (SELECT unnest(['nodes', 'edges', 'track_edges']) AS name) n CROSS JOIN d
LEFT JOIN t ON t.name = n.name AND t.part = d.part GROUP BY ALL""",
    ),
)
def q2_q5_written_graph(spark, sf_dir):
    """Rows of each dataset (none may be empty) and edges without a weight, counted by the jobs that write the graph."""
    dataset = F.when(F.col(E) % 2 == 0, "even").otherwise("odd")
    hits, weighted = A.hits(spark, sf_dir), weighted_edges(spark, sf_dir)
    tables = [t.withColumn("dataset", dataset) for t in (hits, weighted, plain_track_edges(spark, sf_dir))]
    path = f"{checkpoint_root(spark)}/files/{uuid.uuid4().hex}"
    counted = Q.write_checked_graph(*tables, path, {"cut": 0.3}, ["even", "odd"])
    rows = [(t, d, c[f"n_{d}"], c[f"without_{d}"]) for t, c in counted.items() for d in ("even", "odd")]
    return spark.createDataFrame(rows, "table string, dataset string, n_rows long, n_without long")


@query(
    "q1_unknown_nodes",
    with_tables(
        "hits",
        "edges",
        body="""SELECT e.event_id, n.n_nodes, e.max_node FROM (SELECT event_id, MAX(greatest(src, dst + 100)) AS max_node
FROM edges GROUP BY event_id) e JOIN (SELECT event_id, COUNT(*) AS n_nodes FROM hits GROUP BY event_id) n USING (event_id)
WHERE max_node >= n_nodes""",
    ),
)
def q1_unknown_nodes(spark, sf_dir):
    """Edges with a shifted end name nodes that do not exist."""
    edges = A.candidate_edges(spark, sf_dir).withColumn("dst", F.col("dst") + 100)
    hits = A.hits(spark, sf_dir)
    Q.check_columns(hits, ["event_id", "hit_id", "x", "y", "z"])
    Q.require_rows({"hits": hits})
    return Q.events_with_unknown_nodes(hits, edges)


@query(
    "q3_noise_on_tracks",
    with_tables(
        "hits",
        "edges",
        body="""SELECT h.event_id, h.hit_id FROM hits h WHERE particle_id = 0 AND EXISTS (
SELECT 1 FROM edges e WHERE e.event_id = h.event_id AND h.hit_id IN (e.src, e.dst) AND e.score > 0.5)""",
    ),
)
def q3_noise_on_tracks(spark, sf_dir):
    """Noise on candidate edges; on true track edges the result is empty."""
    edges = A.candidate_edges(spark, sf_dir).where("score > 0.5")
    return Q.noise_on_track_edges(A.hits(spark, sf_dir), edges)


@query(
    "q4_shared_edges",
    with_tables(
        "clusters",
        "spacepoints",
        body="""
, e AS (SELECT a.event_id, a.cluster_id AS src, b.cluster_id AS dst, a.particle_id FROM clusters a JOIN clusters b
  ON b.event_id = a.event_id AND b.particle_id = a.particle_id AND b.cluster_id = a.cluster_id + 1 WHERE a.particle_id <> 0)
SELECT event_id, COUNT(*) - COUNT(DISTINCT (src, dst)) AS n_shared FROM e GROUP BY event_id""",
    ),
)
def q4_shared_edges(spark, sf_dir):
    """Edges between clusters of neighbouring ids that two particles share."""
    from .truth_tables import clusters

    c = clusters(spark, sf_dir).where("particle_id <> 0").select(E, "cluster_id", "particle_id")
    src = c.select(E, F.col("cluster_id").alias("src"), "particle_id", (F.col("cluster_id") + 1).alias("dst"))
    edges = src.join(c.withColumnRenamed("cluster_id", "dst"), [E, "particle_id", "dst"])
    return Q.shared_edges(edges)


@query("q4_w3_inconsistent_features", with_tables("track_edges", body="SELECT event_id, particle_id, src, dst FROM track_edges"
       " WHERE src_module <> dst_module"))  # fmt: skip
def q4_w3_inconsistent_features(spark, sf_dir):
    """Edges whose ends differ; the module always does, particle features never do."""
    hits = truth_hits(spark, sf_dir)
    return W.inconsistent_features(truth_edges(spark, sf_dir), hits, ["module_id"])


@query(
    "q6_max_difference",
    with_tables(
        "hits",
        body="SELECT round(MAX(abs(z - (x + y))), 6) + 0.0 AS max_difference FROM hits",
    ),
)
def q6_max_difference(spark, sf_dir):
    h = A.hits(spark, sf_dir)
    other = h.select(E, "hit_id", (F.col("x") + F.col("y")).alias("z"))
    return EV.max_difference(h, other, [E, "hit_id"], "z").select(rnd("max_difference").alias("max_difference"))


# ---- scored graphs: outward, intersected, masked -------------------------------
INWARD = """(a.r * a.r + a.z * a.z > b.r * b.r + b.z * b.z OR (a.r * a.r + a.z * a.z = b.r * b.r + b.z * b.z AND t.src > t.dst))"""
TURNED = f"""CASE WHEN {INWARD} THEN t.dst ELSE t.src END AS src, CASE WHEN {INWARD} THEN t.src ELSE t.dst END AS dst"""
ENDS = """JOIN hit_features a ON a.event_id = t.event_id AND a.hit_id = t.src
JOIN hit_features b ON b.event_id = t.event_id AND b.hit_id = t.dst"""
cte("both_ways", """
SELECT event_id, edge_id, src, dst, score FROM edges UNION ALL SELECT event_id, edge_id + 250000, dst, src, 1 - score FROM edges""",
    "edges")
cte("built_pairs", f"""
SELECT event_id, src, dst, MAX(score) AS score FROM (SELECT t.event_id, t.score, {TURNED} FROM both_ways t {ENDS}) GROUP BY ALL""",
    "both_ways", "hit_features")
cte("true_pairs", f"""
SELECT p.event_id, p.src, p.dst, pt, score FROM (
  SELECT event_id, src, dst, arg_min(pt, track_edge_id) AS pt FROM (
    SELECT t.event_id, t.track_edge_id, t.pt, {TURNED} FROM te t {ENDS}) GROUP BY event_id, src, dst) p
LEFT JOIN built_pairs u ON u.event_id = p.event_id AND u.src = p.src AND u.dst = p.dst""",
    "te", "hit_features", "built_pairs")
SCORE_BINS, SCORE_CUTS = [0.5, 1.0, 2.0, 3.0, 4.0, 4.9], [0.3, 0.5, 0.7, 0.9]
BIN_OF_PT = " + ".join(f"CAST(pt >= {x!r} AS INTEGER)" for x in SCORE_BINS[1:-1])


def _scoring(spark, sf_dir):
    """Edges built in both directions, against truth edges as they are."""
    edges = A.candidate_edges(spark, sf_dir).select(E, "edge_id", "src", "dst", "score")
    back = edges.selectExpr("event_id", "edge_id + 250000 as edge_id", "dst as src", "src as dst", "1 - score as score")
    return scoring_report(
        hit_features(spark, sf_dir), edges.unionByName(back), plain_track_edges(spark, sf_dir), 0.5,
        all_of({"pt": [1.0, float("inf")]}), "pt", SCORE_BINS, SCORE_CUTS,
    )


@query(
    "chain_scoring_summary",
    with_tables(
        "built_pairs",
        "true_pairs",
        "hits",
        body="""
, t AS (SELECT COUNT(*) AS n_target, COUNT(score) AS n_built, COUNT(*) FILTER (score >= 0.5) AS n_found FROM true_pairs
  WHERE pt BETWEEN 1.0 AND 1e9),
e AS (SELECT CAST(SUM(n) AS BIGINT) AS n_positive, AVG(n) AS mean_graph_size FROM (
  SELECT COUNT(*) FILTER (score >= 0.5) AS n FROM (SELECT DISTINCT event_id FROM hits) h LEFT JOIN built_pairs USING (event_id)
  GROUP BY event_id))
SELECT n_target, n_built, n_found, n_positive, round(mean_graph_size, 6) + 0.0 AS mean_graph_size,
  round(CAST(n_found AS DOUBLE) / n_built, 6) + 0.0 AS target_efficiency,
  round(CAST(n_found AS DOUBLE) / n_positive, 6) + 0.0 AS target_purity,
  round(CAST(n_found AS DOUBLE) / n_target, 6) + 0.0 AS cumulative_efficiency,
  round(CAST(n_built AS DOUBLE) / n_target, 6) + 0.0 AS construction_efficiency
FROM t, e""",
    ),
)
def chain_scoring_summary(spark, sf_dir):
    """P22, J13, F7 and A24 in a row: a pair built inward is as good as one built outward."""
    out = _scoring(spark, sf_dir)[0]
    counts = ["n_target", "n_built", "n_found", "n_positive"]
    return out.select(*counts, *[rnd(c).alias(c) for c in out.columns if c not in counts])


@query(
    "chain_scoring_construction",
    with_tables(
        "true_pairs",
        body=f"""
, b AS (SELECT {BIN_OF_PT} AS bin, score FROM true_pairs WHERE pt BETWEEN 1.0 AND 4.9)
SELECT i.bin, COUNT(b.bin) AS n_total, COUNT(b.score) AS n_passed,
  round(CASE WHEN COUNT(b.bin) = 0 THEN 0 ELSE CAST(COUNT(b.score) AS DOUBLE) / COUNT(b.bin) END, 6) + 0.0 AS efficiency
FROM (SELECT unnest(range(5)) AS bin) i LEFT JOIN b ON b.bin = i.bin GROUP BY i.bin""",
    ),
)
def chain_scoring_construction(spark, sf_dir):
    out = _scoring(spark, sf_dir)[1]
    return out.select("bin", "n_total", "n_passed", rnd("efficiency").alias("efficiency"))


@query(
    "chain_scoring_by_cut",
    with_tables(
        "true_pairs",
        body=f"""
, c AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS score_cut),
b AS (SELECT {BIN_OF_PT} AS bin, score FROM true_pairs WHERE score IS NOT NULL AND pt BETWEEN 1.0 AND 4.9)
SELECT i.bin, score_cut, COUNT(b.bin) AS n_total, COUNT(*) FILTER (score >= score_cut) AS n_passed,
  round(CASE WHEN COUNT(b.bin) > 0 THEN CAST(COUNT(*) FILTER (score >= score_cut) AS DOUBLE) / COUNT(b.bin) END, 6) + 0.0
  AS efficiency
FROM (SELECT unnest(range(5)) AS bin) i CROSS JOIN c LEFT JOIN b ON b.bin = i.bin GROUP BY i.bin, score_cut""",
    ),
)
def chain_scoring_by_cut(spark, sf_dir):
    return _scoring(spark, sf_dir)[2].withColumn("efficiency", rnd("efficiency"))


# ---- S19: incremental ingest ---------------------------------------------------
@query(
    "s19_incremental_ingest",
    with_tables(
        "hits",
        body="SELECT event_id, COUNT(*) AS n_hits, COUNT(*) FILTER (particle_id = 0) AS n_noise FROM hits GROUP BY event_id",
    ),
)
def s19_incremental_ingest(spark, sf_dir):
    """File stream of the events table, run twice; the second run finds nothing new."""
    root = f"{checkpoint_root(spark)}/ingest/{uuid.uuid4().hex}"
    schema = A.table(spark, sf_dir, "events").schema
    for _ in range(2):
        source = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
        ingest_stream(source, A.hits_of, f"{root}/hits", f"{root}/state").awaitTermination()
    hits = spark.read.parquet(f"{root}/hits")
    return hits.groupBy(E).agg(F.count("*").alias("n_hits"), F.count_if(F.col("particle_id") == 0).alias("n_noise"))


@query(
    "s19_events_in_two_files",
    with_tables(
        "hits",
        body="SELECT event_id, COUNT(*) AS n_hits, COUNT(DISTINCT hit_id) AS n_different FROM hits GROUP BY event_id",
    ),
)
def s19_events_in_two_files(spark, sf_dir):
    """Every event spread over two files that arrive one after the other, then read again from a new checkpoint."""
    root = f"{checkpoint_root(spark)}/ingest/{uuid.uuid4().hex}"
    hits = A.hits(spark, sf_dir)
    for turn, state in ((0, "state"), (1, "state"), (1, "other")):
        if state == "state":
            hits.where((F.col("particle_id") == 0) == F.lit(turn == 1)).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(hits.schema).parquet(f"{root}/in")
        ingest_stream(source, lambda df: df, f"{root}/hits", f"{root}/{state}").awaitTermination()
    written = spark.read.parquet(f"{root}/hits")
    return written.groupBy(E).agg(F.count("*").alias("n_hits"), F.count_distinct("hit_id").alias("n_different"))


@query(
    "s19_repeated_rows",
    with_tables(
        "hits",
        body="""SELECT event_id, CAST(2 * COUNT(*) AS BIGINT) AS n_hits, COUNT(DISTINCT hit_id) AS n_different
FROM hits GROUP BY event_id""",
    ),
)
def s19_repeated_rows(spark, sf_dir):
    """Files in which every row comes twice: they differ, though their rows cancel in pairs; each is written once."""
    root = f"{checkpoint_root(spark)}/ingest/{uuid.uuid4().hex}"
    hits = A.hits(spark, sf_dir)
    for half in (0, 1, 1):
        rows = hits.where(F.col("hit_id") % 2 == half)
        rows.unionByName(rows).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(hits.schema).parquet(f"{root}/in")
        ingest_stream(source, lambda df: df, f"{root}/hits", f"{root}/state").awaitTermination()
    written = spark.read.parquet(f"{root}/hits")
    return written.groupBy(E).agg(F.count("*").alias("n_hits"), F.count_distinct("hit_id").alias("n_different"))


# ---- U3, U4: user functions ----------------------------------------------------
@hooks.register("processing", "drop_noise")
def drop_noise(hits, particles, tracks):
    return hits.where("particle_id <> 0"), particles, tracks


@hooks.register("track", "by_sector")
def by_sector(hits, edges):
    """A user track builder: one track per sector."""
    return hits.select(E, "hit_id", (F.col("module_id") % 10).alias("track_id"))


@query(
    "u3_u4_user_functions",
    with_tables(
        "hits",
        body="""SELECT event_id, module_id % 10 AS track_id, COUNT(*) AS n_hits FROM hits WHERE particle_id <> 0 GROUP BY ALL""",
    ),
)
def u3_u4_user_functions(spark, sf_dir):
    """A registered processing step and a registered track builder, planned with the rest."""
    hits, _, edges = hooks.process(["drop_noise"], A.hits(spark, sf_dir), None, A.candidate_edges(spark, sf_dir))
    tracks = hooks.get("track", "by_sector")(hits, edges)
    return tracks.groupBy(E, "track_id").agg(F.count("*").alias("n_hits"))
