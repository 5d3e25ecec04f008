"""Queries over graphs: selections, mappings, weights, cuts and edge tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vectors as V
from ..functions.conditions import all_of, condition, fiducial
from ..operators import cuts as C
from ..operators import edge_tables as ET
from ..operators import mapping as M
from ..operators import messages as MS
from ..operators import weighting as WT
from ..operators.joins import E, endpoints, gather
from ..operators.truth_edges import orient_outward
from ..session import cut_lineage
from ..sources import adapters as A
from .registry import query, rnd
from .sqltables import cte, with_tables
from .truth_tables import hit_features, truth_edges, truth_hits

cte("te", """
SELECT t.event_id, t.src * 500 + t.dst AS track_edge_id, t.src, t.dst, t.particle_id, t.pt, t.nhits, t.is_primary,
       t.pdg_id, t.eta_particle, t.src_module, e.edge_id, e.score
FROM track_edges t LEFT JOIN edges e ON e.event_id = t.event_id AND e.src = t.src AND e.dst = t.dst
""", "track_edges", "edges")
cte("ledges", """
SELECT e.event_id, e.edge_id, e.src, e.dst, e.score, t.track_edge_id, t.track_edge_id IS NOT NULL AS y
FROM edges e LEFT JOIN te t ON t.event_id = e.event_id AND t.src = e.src AND t.dst = e.dst""", "edges", "te")
cte("te_ends", """
SELECT event_id, src AS hit_id, 0 AS place, track_edge_id, particle_id, pt, nhits, is_primary, pdg_id FROM te
UNION ALL
SELECT event_id, dst, 1, track_edge_id, particle_id, pt, nhits, is_primary, pdg_id FROM te""", "te")
cte("edge_ends", """
SELECT event_id, src AS hit_id, 0 AS place, edge_id, score FROM edges
UNION ALL SELECT event_id, dst, 1, edge_id, score FROM edges""", "edges")
cte("weighted", """
SELECT l.*, CASE WHEN NOT l.y AND l.score BETWEEN 0.5 AND 10 THEN 0.25
  WHEN l.y AND COALESCE(t.pdg_id IN (11, -11), FALSE) THEN -1.0
  WHEN l.y AND COALESCE(t.pt BETWEEN 1 AND 1e9, FALSE) AND COALESCE(t.nhits BETWEEN 3 AND 1e9, FALSE) THEN 2.0
  WHEN l.y THEN 0.0 ELSE 1.0 END::DOUBLE AS weight
FROM ledges l LEFT JOIN te t ON t.event_id = l.event_id AND t.edge_id = l.edge_id""", "ledges", "te")
INF = float("inf")
RULES = [
    {"weight": 2.0, "conditions": {"y": True, "pt": [1.0, INF], "nhits": [3, INF]}},
    {"weight": -1.0, "conditions": {"y": True, "pdg_id": ["in", [11, -11]]}},
    {"weight": 0.25, "conditions": {"y": False, "score": [0.5, 10.0]}},
]


def track_edges(spark, sf_dir):
    """Truth edges with ids and the built edge they equal."""
    return graph(spark, sf_dir)[1]


def graph(spark, sf_dir):
    """(labelled edges, linked track edges), the stage tables between construction and scoring."""
    edges = cut_lineage(A.candidate_edges(spark, sf_dir).drop("y"))
    true = cut_lineage(plain_track_edges(spark, sf_dir))
    built = edges.select(E, "src", "dst", "edge_id", "score")
    return M.label_edges(edges, true), true.join(built, [E, "src", "dst"], "left")


FEATURES = ["pt", "nhits", "is_primary", "pdg_id", "eta_particle"]


def plain_track_edges(spark, sf_dir):
    return truth_edges(spark, sf_dir).selectExpr(
        "event_id", "src * 500 + dst as track_edge_id", "src", "dst", "particle_id", *FEATURES
    )


def labelled_edges(spark, sf_dir):
    return graph(spark, sf_dir)[0]


def weighted_edges(spark, sf_dir):
    edges, true = graph(spark, sf_dir)
    return WT.weight_edges(edges, RULES, true)


# ---- F1-F3: selections ---------------------------------------------------------
@query(
    "f1_condition_masks",
    with_tables(
        "hit_truth",
        body="""
SELECT event_id, hit_id, COALESCE(pt BETWEEN 1.0 AND 3.5, FALSE) AS in_range,
       COALESCE(pdg_id IN (11, -11), FALSE) AS electron, COALESCE(pdg_id NOT IN (11, -11), FALSE) AS not_electron,
       COALESCE(is_primary = 1, FALSE) AS is_prim, COALESCE(pt <> 2.0, FALSE) AS not_two,
       COALESCE(NOT (nhits BETWEEN 5 AND 9), FALSE) AS odd_length
FROM hit_truth""",
    ),
)
def f1_condition_masks(spark, sf_dir):
    h = truth_hits(spark, sf_dir)
    return h.select(
        E,
        "hit_id",
        condition("pt", [1.0, 3.5]).alias("in_range"),
        condition("pdg_id", ["in", [11, -11]]).alias("electron"),
        condition("pdg_id", ["not_in", [11, -11]]).alias("not_electron"),
        condition("is_primary", True).alias("is_prim"),
        condition("pt", ["is_not", 2.0]).alias("not_two"),
        condition("nhits", ["not_within", [5, 9]]).alias("odd_length"),
    )


@query(
    "f2_target_mask",
    with_tables(
        "te",
        body="""SELECT event_id, track_edge_id,
COALESCE(pt BETWEEN 1.0 AND 1e9 AND nhits BETWEEN 3 AND 1e9 AND pdg_id NOT IN (11, -11), FALSE) AS target_mask FROM te""",
    ),
)
def f2_target_mask(spark, sf_dir):
    target = {"pt": [1.0, INF], "nhits": [3, INF], "pdg_id": ["not_in", [11, -11]]}
    return track_edges(spark, sf_dir).select(E, "track_edge_id", all_of(target).alias("target_mask"))


@query(
    "f3_fiducial_selection",
    with_tables(
        "hit_truth",
        body="""SELECT event_id, hit_id, COALESCE(pt >= 1.0, FALSE) AND COALESCE(pdg_id NOT IN (11, -11), TRUE)
AND COALESCE(eta_particle BETWEEN -3 AND 3, FALSE) AS is_reconstructable,
COALESCE(pdg_id NOT IN (11, -11), TRUE) AS passes_missing FROM hit_truth""",
    ),
)
def f3_fiducial_selection(spark, sf_dir):
    """A scalar means "at least"; a missing value passes the exclusion but no range."""
    exclusion = {"pdg_id": ["not_in", [11, -11]]}
    return truth_hits(spark, sf_dir).select(
        E,
        "hit_id",
        fiducial({"pt": 1.0, **exclusion, "eta_particle": [-3, 3]}).alias("is_reconstructable"),
        fiducial(exclusion).alias("passes_missing"),
    )


# ---- J13, W6, M1-M10 -----------------------------------------------------------
@query(
    "j13_graph_intersection",
    with_tables(
        "te",
        body="""
SELECT COALESCE(e.event_id, t.event_id) AS event_id, COALESCE(e.src, t.src) AS src, COALESCE(e.dst, t.dst) AS dst,
       COALESCE(t.track_edge_id, -1) AS pred_to_truth, COALESCE(e.edge_id, -1) AS truth_to_pred,
       e.edge_id IS NOT NULL AND t.track_edge_id IS NOT NULL AS y
FROM edges e FULL OUTER JOIN te t ON t.event_id = e.event_id AND t.src = e.src AND t.dst = e.dst""",
    ),
)
def j13_graph_intersection(spark, sf_dir):
    both = M.intersect_graphs(A.candidate_edges(spark, sf_dir), plain_track_edges(spark, sf_dir))
    return both.select(
        E,
        "src",
        "dst",
        F.coalesce("track_edge_id", F.lit(-1).cast("bigint")).alias("pred_to_truth"),
        F.coalesce("edge_id", F.lit(-1).cast("bigint")).alias("truth_to_pred"),
        (F.col("edge_id").isNotNull() & F.col("track_edge_id").isNotNull()).alias("y"),
    )


@query(
    "j13_intersection_with_duplicates",
    with_tables(
        "te",
        body="""
SELECT COALESCE(e.event_id, t.event_id) AS event_id, COALESCE(e.src, t.src) AS src, COALESCE(e.dst, t.dst) AS dst,
       e.edge_id, t.track_edge_id
FROM edges e FULL OUTER JOIN te t ON t.event_id = e.event_id AND t.src = e.src AND t.dst = e.dst""",
    ),
)
def j13_intersection_with_duplicates(spark, sf_dir):
    """Both sides given twice; the least id of each pair stays."""
    e = A.candidate_edges(spark, sf_dir)
    t = plain_track_edges(spark, sf_dir)
    twice_e = e.unionByName(e.withColumn("edge_id", F.col("edge_id") + 10**6))
    twice_t = t.unionByName(t.withColumn("track_edge_id", F.col("track_edge_id") + 10**6))
    return M.intersect_graphs(twice_e, twice_t, unique_pred=False, unique_truth=False)


@query(
    "w6_relink_after_filter",
    with_tables(
        "te",
        body="SELECT event_id, track_edge_id, CASE WHEN score >= 0.6 THEN edge_id END AS edge_id FROM te",
    ),
)
def w6_relink_after_filter(spark, sf_dir):
    """F7 too (classifier cut, at least)."""
    kept = C.score_cut(A.candidate_edges(spark, sf_dir), 0.6)
    return M.relink_after_filter(track_edges(spark, sf_dir), kept).select(E, "track_edge_id", "edge_id")


@query(
    "m1_j16_nodes_to_edges",
    with_tables(
        "edges",
        "hit_features",
        body="""
SELECT e.event_id, e.edge_id, round(a.r, 6) + 0.0 AS r_src, round(b.r, 6) + 0.0 AS r_dst,
       round((a.z + b.z) / 2, 6) + 0.0 AS z, (a.particle_id = 0 OR b.particle_id = 0) AS noisy
FROM edges e JOIN hit_features a ON a.event_id = e.event_id AND a.hit_id = e.src
JOIN hit_features b ON b.event_id = e.event_id AND b.hit_id = e.dst""",
    ),
)
def m1_j16_nodes_to_edges(spark, sf_dir):
    h = hit_features(spark, sf_dir).withColumn("noisy", F.col("particle_id") == 0)
    e = A.candidate_edges(spark, sf_dir)
    out = M.nodes_to_edges(M.nodes_to_edges(M.nodes_to_edges(e, h, "r"), h, "z", "mean"), h, "noisy", "any")
    return out.select(
        E, "edge_id", rnd("r_src").alias("r_src"), rnd("r_dst").alias("r_dst"), rnd("z").alias("z"), "noisy"
    )


@query(
    "m2_nodes_to_tracks",
    with_tables(
        "te",
        "hits",
        body="""SELECT t.event_id, t.track_edge_id, round(greatest(a.z, b.z), 6) + 0.0 AS z FROM te t
JOIN hits a ON a.event_id = t.event_id AND a.hit_id = t.src JOIN hits b ON b.event_id = t.event_id AND b.hit_id = t.dst""",
    ),
)
def m2_nodes_to_tracks(spark, sf_dir):
    """M7 too: through the dispatcher."""
    out = M.map_values(
        "z", "node", "track", hits=A.hits(spark, sf_dir), track_edges=plain_track_edges(spark, sf_dir), aggr="max"
    )
    return out.select(E, "track_edge_id", rnd("z").alias("z"))


@query(
    "m3_edges_to_nodes",
    with_tables(
        "hits",
        "edge_ends",
        body="""
SELECT h.event_id, h.hit_id, COALESCE(l.last_score, 0) AS last_score, round(COALESCE(s.sum_score, 0), 6) + 0.0 AS sum_score,
       COALESCE(s.max_score, 0) AS max_score
FROM hits h
LEFT JOIN (SELECT event_id, hit_id, arg_max(score, place * 1000000 + edge_id) AS last_score FROM edge_ends GROUP BY ALL) l
  USING (event_id, hit_id)
LEFT JOIN (SELECT event_id, dst AS hit_id, SUM(score) AS sum_score, MAX(score) AS max_score FROM edges GROUP BY ALL) s
  USING (event_id, hit_id)""",
    ),
)
def m3_edges_to_nodes(spark, sf_dir):
    e = A.candidate_edges(spark, sf_dir).selectExpr(
        "*", "score as last_score", "score as sum_score", "score as max_score"
    )
    h = A.hits(spark, sf_dir).select(E, "hit_id")
    out = M.edges_to_nodes(h, e, "last_score")
    out = M.edges_to_nodes(out, e, "sum_score", "sum")
    out = M.edges_to_nodes(out, e, "max_score", "max")
    return out.select(E, "hit_id", "last_score", rnd("sum_score").alias("sum_score"), "max_score")


@query(
    "m4_tracks_to_edges",
    with_tables(
        "ledges",
        "te",
        body="""SELECT e.event_id, e.edge_id, COALESCE(t.pt, 0) AS pt, COALESCE(t.nhits, 0) AS nhits
FROM edges e LEFT JOIN te t ON t.event_id = e.event_id AND t.edge_id = e.edge_id""",
    ),
)
def m4_tracks_to_edges(spark, sf_dir):
    e = A.candidate_edges(spark, sf_dir)
    return M.tracks_to_edges(e, track_edges(spark, sf_dir), ["pt", "nhits"]).select(E, "edge_id", "pt", "nhits")


@query(
    "m5_tracks_to_nodes",
    with_tables(
        "hits",
        "te_ends",
        body="""
SELECT h.event_id, h.hit_id, COALESCE(t.last_id, 0) AS track_edge_id, COALESCE(t.n, 0) AS n
FROM hits h LEFT JOIN (SELECT event_id, hit_id, arg_max(track_edge_id, place * 1000000 + track_edge_id) AS last_id,
  COUNT(*) AS n FROM te_ends GROUP BY ALL) t USING (event_id, hit_id)""",
    ),
)
def m5_tracks_to_nodes(spark, sf_dir):
    t = plain_track_edges(spark, sf_dir).withColumn("n", F.lit(1).cast("bigint"))
    t = t.withColumn("last_id", F.col("track_edge_id"))
    h = A.hits(spark, sf_dir).select(E, "hit_id")
    out = M.tracks_to_nodes(M.tracks_to_nodes(h, t, "last_id"), t, "n", "sum")
    return out.select(E, "hit_id", F.col("last_id").alias("track_edge_id"), "n")


@query(
    "m6_edges_to_tracks",
    with_tables("te", body="SELECT event_id, track_edge_id, score FROM te"),
)
def m6_edges_to_tracks(spark, sf_dir):
    linked = M.link_track_edges(plain_track_edges(spark, sf_dir), A.candidate_edges(spark, sf_dir))
    return M.edges_to_tracks(linked, A.candidate_edges(spark, sf_dir), "score").select(E, "track_edge_id", "score")


@query(
    "m6b_d6_undirected_values",
    with_tables(
        "edges",
        body="""SELECT event_id, src, dst, score FROM edges UNION ALL SELECT event_id, dst, src, score FROM edges""",
    ),
)
def m6b_d6_undirected_values(spark, sf_dir):
    """Reversed edges appended, then the half-length score repeated onto both directions."""
    e = A.candidate_edges(spark, sf_dir)
    both = ET.to_undirected(e.select(E, "src", "dst"))
    return M.edges_to_reversed(both, e, "score").select(E, "src", "dst", "score")


@query(
    "m7_every_move",
    with_tables(
        "edges", "te", "hits", "ledges",
        body="""
, ends AS (SELECT event_id, src AS hit_id, pt FROM te UNION ALL SELECT event_id, dst, pt FROM te)
SELECT 'node to edge' AS move, COUNT(*) AS n, round(SUM((a.z + b.z) / 2), 2) + 0.0 AS total FROM edges e
  JOIN hits a ON a.event_id = e.event_id AND a.hit_id = e.src JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.dst
UNION ALL SELECT 'node to track', COUNT(*), round(SUM(least(a.z, b.z)), 2) + 0.0 FROM te t
  JOIN hits a ON a.event_id = t.event_id AND a.hit_id = t.src JOIN hits b ON b.event_id = t.event_id AND b.hit_id = t.dst
UNION ALL SELECT 'edge to node', (SELECT COUNT(*) FROM hits), round(SUM(score), 2) + 0.0 FROM edges
UNION ALL SELECT 'track to node', (SELECT COUNT(*) FROM hits), round(SUM(pt), 2) + 0.0 FROM ends
UNION ALL SELECT 'track to edge', COUNT(*), round(SUM(COALESCE(t.pt, 0)), 2) + 0.0 FROM edges e
  LEFT JOIN te t ON t.event_id = e.event_id AND t.edge_id = e.edge_id
UNION ALL SELECT 'edge to track', COUNT(*), round(SUM(score), 2) + 0.0 FROM te""",
    ),
)
def m7_every_move(spark, sf_dir):
    """All six moves through the dispatcher, each as its number of rows and the sum of what was moved."""
    hits, edges = A.hits(spark, sf_dir).select(E, "hit_id", "z"), A.candidate_edges(spark, sf_dir)
    tracks = M.link_track_edges(plain_track_edges(spark, sf_dir), edges)
    tables = {"hits": hits, "edges": edges, "track_edges": tracks}
    moves = [("z", "node", "edge", "mean"), ("z", "node", "track", "min"), ("score", "edge", "node", "sum"),
             ("pt", "track", "node", "sum"), ("pt", "track", "edge", None), ("score", "edge", "track", None)]
    whole = None
    for column, source, target, aggr in moves:
        moved = M.map_values(column, source, target, aggr=aggr, **tables)
        row = moved.agg(F.count("*").alias("n"), rnd(F.sum(column), 2).alias("total"))
        row = row.select(F.lit(f"{source} to {target}").alias("move"), "n", "total")
        whole = row if whole is None else whole.unionByName(row)
    return whole


@query(
    "m8_edge_weights",
    with_tables("weighted", body="SELECT event_id, edge_id, y, weight FROM weighted"),
)
def m8_edge_weights(spark, sf_dir):
    """Q5 holds by construction: weights and truth are columns of one table."""
    return weighted_edges(spark, sf_dir).select(E, "edge_id", "y", "weight")


@query(
    "m9_true_nodes",
    with_tables(
        "hits",
        "te_ends",
        body="""SELECT h.event_id, h.hit_id, EXISTS (SELECT 1 FROM te_ends t WHERE t.event_id = h.event_id
AND t.hit_id = h.hit_id) AS y_node FROM hits h""",
    ),
)
def m9_true_nodes(spark, sf_dir):
    h = A.hits(spark, sf_dir).select(E, "hit_id")
    return M.mark_true_nodes(h, plain_track_edges(spark, sf_dir))


@query(
    "m10_edge_bundle",
    with_tables(
        "edges",
        "hit_features",
        "te",
        body="""
SELECT e.event_id, e.edge_id, round((a.r + b.r) / 2, 6) + 0.0 AS r, round((a.z + b.z) / 2, 6) + 0.0 AS z,
       COALESCE(t.pt, 0) AS pt
FROM edges e JOIN hit_features a ON a.event_id = e.event_id AND a.hit_id = e.src
JOIN hit_features b ON b.event_id = e.event_id AND b.hit_id = e.dst
LEFT JOIN te t ON t.event_id = e.event_id AND t.edge_id = e.edge_id
WHERE e.score >= 0.3""",
    ),
)
def m10_edge_bundle(spark, sf_dir):
    kept = C.score_cut(A.candidate_edges(spark, sf_dir), 0.3)
    out = M.bundle_to_edges(kept, hit_features(spark, sf_dir), track_edges(spark, sf_dir), ["r", "z"], ["pt"])
    return out.select(E, "edge_id", rnd("r").alias("r"), rnd("z").alias("z"), "pt")


# ---- F5-F10, P26 ---------------------------------------------------------------
@query(
    "f5_hard_edge_cut",
    with_tables(
        "te",
        "te_ends",
        body="""
, n AS (SELECT DISTINCT event_id, hit_id FROM te_ends WHERE pt BETWEEN 1.0 AND 1e9)
SELECT e.event_id, e.edge_id, e.score FROM edges e
WHERE EXISTS (SELECT 1 FROM n WHERE n.event_id = e.event_id AND n.hit_id = e.src)
  AND EXISTS (SELECT 1 FROM n WHERE n.event_id = e.event_id AND n.hit_id = e.dst)""",
    ),
)
def f5_hard_edge_cut(spark, sf_dir):
    kept, _ = C.hard_edge_cut(A.candidate_edges(spark, sf_dir), track_edges(spark, sf_dir), {"pt": [1.0, INF]})
    return kept.select(E, "edge_id", "score")


@query(
    "f5_hard_cut_tracks",
    with_tables("te", body="SELECT event_id, track_edge_id, edge_id FROM te WHERE pt BETWEEN 1.0 AND 1e9"),
)
def f5_hard_cut_tracks(spark, sf_dir):
    """Track edges that pass; all edges of theirs stay, so no link is lost."""
    _, kept = C.hard_edge_cut(A.candidate_edges(spark, sf_dir), track_edges(spark, sf_dir), {"pt": [1.0, INF]})
    return kept.select(E, "track_edge_id", "edge_id")


cte("passing_nodes", """
SELECT event_id, hit_id, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY hit_id) - 1 AS node_id FROM (
SELECT event_id, hit_id, arg_max(COALESCE(pt BETWEEN 1.0 AND 1e9 AND pdg_id NOT IN (11, -11), FALSE),
  place * 1000000 + track_edge_id) AS ok FROM te_ends GROUP BY ALL) WHERE ok""", "te_ends")


@query("f6_w5_hard_node_cut", with_tables("passing_nodes", body="SELECT event_id, hit_id, node_id FROM passing_nodes"))
def f6_w5_hard_node_cut(spark, sf_dir):
    cut = {"pt": [1.0, INF], "pdg_id": ["not_in", [11, -11]]}
    nodes, _ = C.hard_node_cut(A.hits(spark, sf_dir), plain_track_edges(spark, sf_dir), cut)
    return nodes.select(E, "hit_id", "node_id")


@query(
    "f6_hard_node_cut_tracks",
    with_tables(
        "passing_nodes",
        "te",
        body="""SELECT t.event_id, t.track_edge_id, a.node_id AS node_src, b.node_id AS node_dst FROM te t
JOIN passing_nodes a ON a.event_id = t.event_id AND a.hit_id = t.src
JOIN passing_nodes b ON b.event_id = t.event_id AND b.hit_id = t.dst""",
    ),
)
def f6_hard_node_cut_tracks(spark, sf_dir):
    cut = {"pt": [1.0, INF], "pdg_id": ["not_in", [11, -11]]}
    _, tracks = C.hard_node_cut(A.hits(spark, sf_dir), plain_track_edges(spark, sf_dir), cut)
    return tracks.select(E, "track_edge_id", "node_src", "node_dst")


@query(
    "f7_score_cuts",
    with_tables(
        "edges",
        body="""SELECT event_id, COUNT(*) FILTER (score >= 0.5) AS n_at_least, COUNT(*) FILTER (score > 0.5) AS n_above
FROM edges GROUP BY event_id""",
    ),
)
def f7_score_cuts(spark, sf_dir):
    """Both conventions beside each other; scores lie exactly on the cut."""
    e = A.candidate_edges(spark, sf_dir)
    low = C.score_cut(e, 0.5).groupBy(E).agg(F.count("*").alias("n_at_least"))
    high = C.score_cut(e, 0.5, "above").groupBy(E).agg(F.count("*").alias("n_above"))
    return low.join(high, E, "left").fillna(0)


@query(
    "f8_background_cut",
    with_tables(
        "edges",
        "hit_truth",
        body="""SELECT e.event_id, e.edge_id FROM edges e
JOIN hit_truth a ON a.event_id = e.event_id AND a.hit_id = e.src JOIN hit_truth b ON b.event_id = e.event_id AND b.hit_id = e.dst
WHERE COALESCE(a.pt > 3.0 AND a.particle_id <> 0, FALSE) OR COALESCE(b.pt > 3.0 AND b.particle_id <> 0, FALSE)""",
    ),
)
def f8_background_cut(spark, sf_dir):
    return C.background_cut(A.candidate_edges(spark, sf_dir), truth_hits(spark, sf_dir), 3.0).select(E, "edge_id")


@query(
    "f8_signal_pt_cut",
    with_tables(
        "te",
        "hit_truth",
        body="""SELECT t.event_id, t.track_edge_id FROM te t JOIN hit_truth a ON a.event_id = t.event_id AND a.hit_id = t.src
JOIN hit_truth b ON b.event_id = t.event_id AND b.hit_id = t.dst WHERE a.pt > 3.0 AND b.pt > 3.0""",
    ),
)
def f8_signal_pt_cut(spark, sf_dir):
    kept = C.signal_pt_cut(plain_track_edges(spark, sf_dir), truth_hits(spark, sf_dir), 3.0)
    return kept.select(E, "track_edge_id")


@query(
    "f9_drop_isolated",
    with_tables(
        "hits",
        "edge_ends",
        body="""SELECT h.event_id, h.hit_id, h.module_id FROM hits h WHERE EXISTS (SELECT 1 FROM edge_ends e
WHERE e.event_id = h.event_id AND e.hit_id = h.hit_id AND e.score > 0.7)""",
    ),
)
def f9_drop_isolated(spark, sf_dir):
    kept = C.score_cut(A.candidate_edges(spark, sf_dir), 0.7, "above")
    return C.drop_isolated(A.hits(spark, sf_dir), kept).select(E, "hit_id", "module_id")


@query(
    "f10_max_graph_size",
    with_tables(
        "edges",
        body="""SELECT event_id, COUNT(*) AS n_edges, round(SUM(score), 6) + 0.0 AS sum_score FROM edges GROUP BY event_id
HAVING COUNT(*) <= 2270""",
    ),
)
def f10_max_graph_size(spark, sf_dir):
    kept = C.drop_large_events(A.candidate_edges(spark, sf_dir), 2270)
    return kept.groupBy(E).agg(F.count("*").alias("n_edges"), rnd(F.sum("score")).alias("sum_score"))


@query(
    "p26_pair_truth",
    with_tables(
        "edges",
        "hits",
        "te_ends",
        body="""
, s AS (SELECT DISTINCT event_id, hit_id FROM te_ends WHERE pt > 1.0),
p AS (SELECT e.event_id, e.edge_id, a.particle_id = b.particle_id AND a.particle_id <> 0 AS y_pid,
  EXISTS (SELECT 1 FROM s WHERE s.event_id = e.event_id AND s.hit_id = e.src)
  AND EXISTS (SELECT 1 FROM s WHERE s.event_id = e.event_id AND s.hit_id = e.dst) AS on_signal
  FROM edges e JOIN hits a ON a.event_id = e.event_id AND a.hit_id = e.src
  JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.dst)
SELECT event_id, edge_id, y_pid, y_pid AND on_signal AS pid_signal FROM p""",
    ),
)
def p26_pair_truth(spark, sf_dir):
    signal = plain_track_edges(spark, sf_dir).where("pt > 1.0")
    out = C.pair_truth(A.candidate_edges(spark, sf_dir), A.hits(spark, sf_dir), signal)
    return out.select(E, "edge_id", "y_pid", "pid_signal")


# ---- P13-P28 -------------------------------------------------------------------
@query(
    "p13_p14_edge_features",
    with_tables(
        "edges",
        "hit_features",
        body="""
, f AS (SELECT e.event_id, e.edge_id, b.r - a.r AS dr, b.z - a.z AS dz, b.eta - a.eta AS deta, (a.r + b.r) / 2 AS rm,
  (b.phi / pi() - a.phi / pi()) * pi() AS d
  FROM edges e JOIN hit_features a ON a.event_id = e.event_id AND a.hit_id = e.src
  JOIN hit_features b ON b.event_id = e.event_id AND b.hit_id = e.dst),
g AS (SELECT *, CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END / pi() AS dphi FROM f),
h AS (SELECT *, greatest(-100.0, least(100.0, CASE WHEN dr = 0 THEN CASE WHEN dphi > 0 THEN 100.0 WHEN dphi < 0
  THEN -100.0 ELSE 0.0 END ELSE dphi / dr END)) AS phislope FROM g)
SELECT event_id, edge_id, round(dr, 6) + 0.0 AS dr, round(dphi, 6) + 0.0 AS dphi, round(dz, 6) + 0.0 AS dz,
       round(deta, 6) + 0.0 AS deta, round(phislope, 6) + 0.0 AS phislope, round(rm * phislope, 6) + 0.0 AS rphislope
FROM h""",
    ),
)
def p13_p14_edge_features(spark, sf_dir):
    h = hit_features(spark, sf_dir).withColumn("phi", F.col("phi") / math.pi)
    names = ["dr", "dphi", "dz", "deta", "phislope", "rphislope"]
    out = ET.add_edge_features(A.candidate_edges(spark, sf_dir), h, names)
    return out.select(E, "edge_id", *[rnd(n).alias(n) for n in names])


@query(
    "p15_feature_scaling",
    with_tables(
        "hit_features",
        body="""SELECT event_id, hit_id, round(r / 1000, 6) + 0.0 AS r, round(z / 500, 6) + 0.0 AS z,
round((phi / 3.14) * 3.14, 6) + 0.0 AS phi FROM hit_features""",
    ),
)
def p15_feature_scaling(spark, sf_dir):
    h = ET.scale(hit_features(spark, sf_dir), {"r": 1000.0, "z": 500.0, "phi": 3.14})
    return ET.unscale(h, {"phi": 3.14}).select(E, "hit_id", *[rnd(c).alias(c) for c in ("r", "z", "phi")])


@query(
    "p16_p17_p18_feature_vector",
    with_tables(
        "hit_truth",
        body="""
, v AS (SELECT event_id, hit_id, x, y, COALESCE(pt, 0) AS p FROM hit_truth),
n AS (SELECT *, greatest(sqrt(x * x + y * y + p * p), 1e-12) AS len FROM v)
SELECT event_id, hit_id, round(x / len, 6) + 0.0 AS v0, round(y / len, 6) + 0.0 AS v1, round(p / len, 6) + 0.0 AS v2
FROM n""",
    ),
)
def p16_p17_p18_feature_vector(spark, sf_dir):
    """Stacked features, missing pt as 0, scaled to unit length."""
    h = truth_hits(spark, sf_dir).select(E, "hit_id", V.stack(["x", "y", "pt"]).alias("v"))
    unit = h.withColumn("v", V.l2_normalise("v"))
    return unit.select(E, "hit_id", *[rnd(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(3)])


@query(
    "p19_p23_endpoint_distance",
    with_tables(
        "edges",
        "hits",
        body="""
, d AS (SELECT e.event_id, e.edge_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d
FROM edges e JOIN hits a ON a.event_id = e.event_id AND a.hit_id = e.src
JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.dst)
SELECT event_id, edge_id, round(d, 4) + 0.0 AS distance, round(exp(-2.0 * d / (500.0 * 500.0)), 6) + 0.0 AS weight FROM d""",
    ),
)
def p19_p23_endpoint_distance(spark, sf_dir):
    h = A.hits(spark, sf_dir).withColumn("v", V.stack(["x", "y", "z"]))
    both = gather(A.candidate_edges(spark, sf_dir), h, ["v"])
    d = both.withColumn("d", V.squared_distance("v_src", "v_dst"))
    return d.select(
        E, "edge_id", rnd("d", 4).alias("distance"), rnd(G.decay_weight("d", 2.0, 500.0)).alias("weight")
    )


TYPE_GROUPS = [{"id": [1, 2], "name": "inner"}, {"id": [3, 4, 5], "name": "middle"}, {"id": [6, 5], "name": "outer"}]
cte("typed_hits", """
SELECT *, CAST(CASE WHEN region IN (6, 5) THEN 2 WHEN region IN (3, 4, 5) THEN 1 ELSE 0 END AS BIGINT) AS node_type,
       CASE WHEN region IN (6, 5) THEN 'outer' WHEN region IN (3, 4, 5) THEN 'middle' ELSE 'inner' END AS node_type_name
FROM hits""", "hits")
cte("typed_edges", """
SELECT e.*, a.node_type_name || '__to__' || b.node_type_name AS edge_type_name,
  (SELECT COUNT(DISTINCT t.node_type) FROM typed_hits t WHERE t.event_id = e.event_id AND t.node_type < a.node_type)
  * (SELECT COUNT(DISTINCT t.node_type) FROM typed_hits t WHERE t.event_id = e.event_id)
  + (SELECT COUNT(DISTINCT t.node_type) FROM typed_hits t WHERE t.event_id = e.event_id AND t.node_type < b.node_type)
  AS edge_type
FROM edges e JOIN typed_hits a ON a.event_id = e.event_id AND a.hit_id = e.src
JOIN typed_hits b ON b.event_id = e.event_id AND b.hit_id = e.dst""", "edges", "typed_hits")


def typed_hits(spark, sf_dir):
    return ET.add_node_type(A.hits(spark, sf_dir), TYPE_GROUPS)


@query("p20_node_types", with_tables("typed_hits", body="SELECT event_id, hit_id, node_type, node_type_name FROM typed_hits"))
def p20_node_types(spark, sf_dir):
    return typed_hits(spark, sf_dir).select(E, "hit_id", "node_type", "node_type_name")


@query("p21_edge_types", with_tables("typed_edges", body="SELECT event_id, edge_id, edge_type, edge_type_name FROM typed_edges"))
def p21_edge_types(spark, sf_dir):
    typed = ET.add_edge_type(A.candidate_edges(spark, sf_dir), typed_hits(spark, sf_dir))
    return typed.select(E, "edge_id", "edge_type", "edge_type_name")


@query(
    "p28_typed_split",
    with_tables(
        "typed_edges",
        body="SELECT edge_type_name AS part, COUNT(*) AS n FROM typed_edges GROUP BY ALL"
        " UNION ALL SELECT node_type_name, COUNT(*) FROM typed_hits GROUP BY ALL",
    ),
)
def p28_typed_split(spark, sf_dir):
    """Sizes of the typed parts of the graph."""
    hits = typed_hits(spark, sf_dir)
    edges = ET.add_edge_type(A.candidate_edges(spark, sf_dir), hits)
    nodes, links = ET.split_by_type(hits, edges, [g["name"] for g in TYPE_GROUPS])
    parts = [df.select(F.lit(n).alias("part")) for n, df in nodes.items()]
    parts += [df.select(F.lit("__".join(k)).alias("part")) for k, df in links.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("part").agg(F.count("*").alias("n"))


@query(
    "p22_orient_outward",
    with_tables(
        "edges",
        "hit_features",
        body="""
, d AS (SELECT e.*, a.r * a.r + a.z * a.z > b.r * b.r + b.z * b.z AS inward FROM edges e
JOIN hit_features a ON a.event_id = e.event_id AND a.hit_id = e.src
JOIN hit_features b ON b.event_id = e.event_id AND b.hit_id = e.dst)
SELECT event_id, edge_id, CASE WHEN inward THEN dst ELSE src END AS src, CASE WHEN inward THEN src ELSE dst END AS dst
FROM d""",
    ),
)
def p22_orient_outward(spark, sf_dir):
    out = orient_outward(A.candidate_edges(spark, sf_dir), hit_features(spark, sf_dir))
    return out.select(E, "edge_id", "src", "dst")


@query(
    "p24_schedule_sweep",
    """
SELECT p_size AS epoch, round(0.1 + (0.5 - 0.1) * p_size / 50, 6) + 0.0 AS r2,
       round(CASE WHEN p_size < 25 THEN 10 + (20 - 10) * CAST(p_size AS DOUBLE) / 25.0
             ELSE 20 + (5 - 20) * (p_size - 25.0) / 25.0 END, 6) + 0.0 AS r3,
       CAST(trunc(10 + (30 - 10) * CAST(p_size AS DOUBLE) / 50) AS INTEGER) AS k, COUNT(*) AS n
FROM part GROUP BY p_size""",
)
def p24_schedule_sweep(spark, sf_dir):
    """Radius and k over epochs 1..50, read from the part sizes."""
    epochs = A.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("epoch")).agg(F.count("*").alias("n"))
    return epochs.select(
        "epoch",
        rnd(G.schedule([0.1, 0.5], "epoch", 50)).alias("r2"),
        rnd(G.schedule([10, 20, 5], "epoch", 50)).alias("r3"),
        G.schedule([10, 30], "epoch", 50, integer=True).alias("k"),
        "n",
    )


@query(
    "p25_sigmoid_score",
    with_tables(
        "edges",
        body="SELECT event_id, edge_id, round(1.0 / (1.0 + exp(-(score * 10 - 5))), 6) + 0.0 AS score FROM edges",
    ),
)
def p25_sigmoid_score(spark, sf_dir):
    e = A.candidate_edges(spark, sf_dir)
    return e.select(E, "edge_id", rnd(G.sigmoid(F.col("score") * 10 - 5)).alias("score"))


# ---- D5, G8, G13, A17 ----------------------------------------------------------
@query(
    "d5_undirected_unique",
    with_tables(
        "ledges",
        body="""SELECT event_id, least(src, dst) AS lo, greatest(src, dst) AS hi, MIN(edge_id) AS edge_id, bool_or(y) AS y
FROM ledges GROUP BY ALL""",
    ),
)
def d5_undirected_unique(spark, sf_dir):
    """Both directions given; the hash-drawn direction is left out of the comparison."""
    both = ET.to_undirected(labelled_edges(spark, sf_dir))
    kept, _ = ET.undirected_unique(both, plain_track_edges(spark, sf_dir))
    return kept.select(E, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "edge_id", "y")


@query(
    "d5_relinked_tracks",
    with_tables(
        "te",
        body="""SELECT t.event_id, t.track_edge_id, e.edge_id FROM te t LEFT JOIN edges e ON e.event_id = t.event_id
AND least(e.src, e.dst) = least(t.src, t.dst) AND greatest(e.src, e.dst) = greatest(t.src, t.dst)""",
    ),
)
def d5_relinked_tracks(spark, sf_dir):
    both = ET.to_undirected(labelled_edges(spark, sf_dir))
    _, tracks = ET.undirected_unique(both, plain_track_edges(spark, sf_dir))
    return tracks.select(E, "track_edge_id", "edge_id")


cte("two_way", """
SELECT event_id, src, dst, score FROM edges UNION ALL
SELECT event_id, dst, src, CAST((CAST(round(score * 1000) AS BIGINT) * 7) % 1000 AS DOUBLE) / 1000 FROM edges""", "edges")


def two_way_edges(spark, sf_dir):
    e = A.candidate_edges(spark, sf_dir).select(E, "src", "dst", "score")
    back = e.selectExpr(
        "event_id", "dst as src", "src as dst", "cast((cast(round(score * 1000) as bigint) * 7) % 1000 as double) / 1000 as score"
    )
    return e.unionByName(back)


@query(
    "g8_directed_decision",
    with_tables(
        "two_way",
        body="""SELECT event_id, least(src, dst) AS src, greatest(src, dst) AS dst, bool_or(score > 0.5) AS loose,
bool_and(score > 0.5) AS tight FROM two_way GROUP BY ALL""",
    ),
)
def g8_directed_decision(spark, sf_dir):
    """T7 too: pairs by (least, greatest) instead of a sort."""
    return ET.directed_decision(two_way_edges(spark, sf_dir), 0.5).select(E, "src", "dst", "loose", "tight")


@query(
    "g13_mean_of_directions",
    with_tables(
        "two_way",
        body="""SELECT event_id, least(src, dst) AS src, greatest(src, dst) AS dst, round(AVG(score), 6) + 0.0 AS score
FROM two_way GROUP BY ALL""",
    ),
)
def g13_mean_of_directions(spark, sf_dir):
    out = ET.mean_of_directions(two_way_edges(spark, sf_dir))
    return out.select(E, "src", "dst", rnd("score").alias("score"))


@query(
    "a17_degrees",
    with_tables(
        "edge_ends",
        body="""SELECT event_id, hit_id, COUNT(*) FILTER (place = 1) AS in_degree, COUNT(*) FILTER (place = 0) AS out_degree
FROM edge_ends WHERE score > 0.5 GROUP BY ALL""",
    ),
)
def a17_degrees(spark, sf_dir):
    return ET.degrees(C.score_cut(A.candidate_edges(spark, sf_dir), 0.5, "above"))


# ---- A14-A16 -------------------------------------------------------------------
def edge_vectors(spark, sf_dir):
    return A.candidate_edges(spark, sf_dir).withColumn("e", F.array(F.col("score"), F.col("score") * 2 - 1))


@query(
    "a14_message_passing",
    with_tables(
        "hits",
        "edges",
        body="""
, i AS (SELECT event_id, dst AS hit_id, SUM(score) AS s, AVG(score * 2 - 1) AS m, MAX(score) AS mx, stddev_pop(score) AS sd
  FROM edges GROUP BY ALL),
o AS (SELECT event_id, src AS hit_id, SUM(score) AS s, MIN(score * 2 - 1) AS mn FROM edges GROUP BY ALL)
SELECT h.event_id, h.hit_id, round(COALESCE(i.s, 0), 6) + 0.0 AS in_sum, round(COALESCE(i.m, 0), 6) + 0.0 AS in_mean,
       COALESCE(i.mx, 0) AS in_max, round(CASE WHEN i.sd > sqrt(1e-5) THEN i.sd ELSE 0 END, 6) + 0.0 AS in_std,
       round(COALESCE(o.s, 0), 6) + 0.0 AS out_sum, round(COALESCE(o.mn, 0), 6) + 0.0 AS out_min
FROM hits h LEFT JOIN i USING (event_id, hit_id) LEFT JOIN o USING (event_id, hit_id)""",
    ),
)
def a14_message_passing(spark, sf_dir):
    """Five aggregations of 2-vectors at dst and src, concatenated; six entries are shown."""
    h = A.hits(spark, sf_dir).select(E, "hit_id")
    out = MS.aggregate_messages(h, edge_vectors(spark, sf_dir), "e", 2, ["sum", "mean", "max", "min", "std"])
    entry = lambda i: F.get("message", F.lit(i))
    return out.select(
        E,
        "hit_id",
        rnd(entry(0)).alias("in_sum"),
        rnd(entry(3)).alias("in_mean"),
        entry(4).alias("in_max"),
        rnd(entry(8)).alias("in_std"),
        rnd(entry(10)).alias("out_sum"),
        rnd(entry(17)).alias("out_min"),
    )


@query(
    "a14b_edge_update",
    with_tables(
        "edges",
        "hits",
        body="""SELECT e.event_id, e.edge_id, a.x AS i0, a.y AS i1, b.x AS i2, b.y AS i3, e.score AS i4,
round(e.score + e.score, 6) + 0.0 AS e0, round(e.score * 2 - 1 + e.score * 2 - 1, 6) + 0.0 AS e1
FROM edges e JOIN hits a ON a.event_id = e.event_id AND a.hit_id = e.src
JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.dst""",
    ),
)
def a14b_edge_update(spark, sf_dir):
    """Gathered edge input and the residual update."""
    h = A.hits(spark, sf_dir).withColumn("x", V.stack(["x", "y"]))
    out = MS.edge_inputs(edge_vectors(spark, sf_dir), h, "x", "e").withColumn("f", F.col("e"))
    out = MS.residual_update(out, "e", "f")
    return out.select(
        E,
        "edge_id",
        *[F.get("edge_input", F.lit(i)).alias(f"i{i}") for i in range(5)],
        *[rnd(F.get("e", F.lit(i))).alias(f"e{i}") for i in range(2)],
    )


@query(
    "a15_weighted_pooling",
    with_tables(
        "hits",
        "edges",
        body="""
, p AS (SELECT e.event_id, e.dst AS hit_id, SUM(a.z * e.score) AS s, MAX(a.deposit * e.score) AS m
FROM edges e JOIN hits a ON a.event_id = e.event_id AND a.hit_id = e.src GROUP BY ALL)
SELECT h.event_id, h.hit_id, round(COALESCE(s, 0), 6) + 0.0 AS z_sum, round(COALESCE(m, 0), 6) + 0.0 AS deposit_max
FROM hits h LEFT JOIN p USING (event_id, hit_id)""",
    ),
)
def a15_weighted_pooling(spark, sf_dir):
    h = A.hits(spark, sf_dir).withColumn("v", V.stack(["z", "deposit"])).select(E, "hit_id", "v")
    out = MS.weighted_pooling(h, A.candidate_edges(spark, sf_dir), "v", 2, "score", ["sum", "max"])
    return out.select(
        E, "hit_id", rnd(F.get("pooled", F.lit(0))).alias("z_sum"), rnd(F.get("pooled", F.lit(3))).alias("deposit_max")
    )


@query(
    "a16_typed_aggregation",
    with_tables(
        "typed_edges",
        body="""SELECT event_id, dst, round(SUM(m), 6) + 0.0 AS score FROM (SELECT event_id, edge_type, dst, AVG(score) AS m
FROM typed_edges GROUP BY ALL) GROUP BY ALL""",
    ),
)
def a16_typed_aggregation(spark, sf_dir):
    typed = ET.add_edge_type(A.candidate_edges(spark, sf_dir), typed_hits(spark, sf_dir))
    out = MS.typed_aggregation(typed, "score", "mean", "sum")
    return out.select(E, "dst", rnd("score").alias("score"))
