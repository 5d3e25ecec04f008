"""Queries that build candidate graphs: module map, neighbours, sampling, networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.draws import draw_sql
from ..functions.inference import Mlp, embed_udf
from ..functions.geometry import decay_weight
from ..operators import edge_tables as ET
from ..operators import mapping as M
from ..operators import module_map as MM
from ..operators import neighbours as N
from ..operators import sampling as SM
from ..operators import scoring as SC
from ..operators import weighting as WT
from ..operators.joins import E
from ..plans import graphs as P
from ..session import cut_lineage
from ..sources import adapters as A
from ..sources import text_dumps
from .graph_tables import INF, RULES, plain_track_edges, weighted_edges
from .reading import module_map_lines
from .registry import query, rnd
from .sqltables import cte, with_tables
from .truth_tables import hit_features, truth_hits

WRAP = "CASE WHEN {0} > pi() THEN {0} - 2 * pi() WHEN {0} < -pi() THEN {0} + 2 * pi() ELSE {0} END"


def _doublet_sql(pair: str, inner: str, outer: str) -> str:
    return f"""
SELECT *, dphi / dr AS slope, z_a - (r_a * dz) / dr AS z0 FROM (
SELECT *, {WRAP.format('dphi0')} AS dphi FROM (
SELECT a.event_id, m.mid_1, m.mid_2, m.mid_3, a.hit_id AS hit_a, b.hit_id AS hit_b, a.x AS x_a, a.y AS y_a, a.z AS z_a,
       a.r AS r_a, b.x AS x_b, b.y AS y_b, b.z AS z_b, b.r AS r_b, a.eta - b.eta AS deta, b.z - a.z AS dz, b.r - a.r AS dr,
       b.phi - a.phi AS dphi0, m.*
FROM module_map m JOIN hit_features a ON a.module_id = m.{inner}
JOIN hit_features b ON b.event_id = a.event_id AND b.module_id = m.{outer})
WHERE dr <> 0)
WHERE deta < detamax_{pair} AND deta > detamin_{pair} AND z_a - (r_a * dz) / dr < z0max_{pair}
  AND z_a - (r_a * dz) / dr > z0min_{pair} AND dphi < dphimax_{pair} AND dphi > dphimin_{pair}
  AND dphi / dr < phiSlopemax_{pair} AND dphi / dr > phiSlopemin_{pair}"""


cte("doublets_12", _doublet_sql("12", "mid_1", "mid_2"), "module_map", "hit_features")
cte("doublets_23", _doublet_sql("23", "mid_2", "mid_3"), "module_map", "hit_features")
cte("triplets", """
SELECT event_id, hit_1, hit_2, hit_3 FROM (
SELECT f.event_id, f.hit_a AS hit_1, f.hit_b AS hit_2, s.hit_b AS hit_3,
       f.y_b - f.y_a AS dy12, f.y_b - s.y_b AS dy23, f.x_a - f.x_b AS dx12, f.x_b - s.x_b AS dx23,
       f.z_b - f.z_a AS dz12, s.z_b - f.z_b AS dz23, f.r_b - f.r_a AS dr12, s.r_b - f.r_b AS dr23,
       f.diff_dydx_max, f.diff_dydx_min, f.diff_dzdr_max, f.diff_dzdr_min
FROM doublets_12 f JOIN doublets_23 s ON s.event_id = f.event_id AND s.mid_1 = f.mid_1 AND s.mid_3 = f.mid_3
  AND s.hit_a = f.hit_b)
WHERE CASE WHEN dx12 = 0 AND dx23 = 0 THEN 0 WHEN dx12 = 0 OR dx23 = 0 THEN NULL ELSE dy12 / dx12 - dy23 / dx23 END
      BETWEEN diff_dydx_min AND diff_dydx_max
  AND CASE WHEN dx12 = 0 AND dx23 = 0 THEN 0 WHEN dx12 = 0 OR dx23 = 0 THEN NULL ELSE dy12 / dx12 - dy23 / dx23 END
      NOT IN (diff_dydx_min, diff_dydx_max)
  AND dz12 / dr12 - dz23 / dr23 < diff_dzdr_max AND dz12 / dr12 - dz23 / dr23 > diff_dzdr_min""",
    "doublets_12", "doublets_23")
cte("map_edges", """
SELECT event_id, hit_1 AS src, hit_2 AS dst FROM triplets UNION SELECT event_id, hit_2, hit_3 FROM triplets""", "triplets")


def parsed_map(spark, sf_dir):
    """The map as a table; written once, or the parsing would run inside the joins."""
    return cut_lineage(text_dumps.parse_module_map(module_map_lines(spark, sf_dir)))


@query(
    "j11_f11_first_doublets",
    with_tables("doublets_12", body="SELECT event_id, mid_3, hit_a AS hit_1, hit_b AS hit_2 FROM doublets_12"),
)
def j11_f11_first_doublets(spark, sf_dir):
    first, _, _ = text_dumps.module_map_parts(parsed_map(spark, sf_dir))
    found = MM.doublets(hit_features(spark, sf_dir), first, True)
    return found.select(E, "mid_3", F.col("hit_id_o").alias("hit_1"), F.col("hit_id_m").alias("hit_2"))


@query(
    "j11_f11_second_doublets",
    with_tables("doublets_23", body="SELECT event_id, mid_1, hit_a AS hit_2, hit_b AS hit_3 FROM doublets_23"),
)
def j11_f11_second_doublets(spark, sf_dir):
    _, second, _ = text_dumps.module_map_parts(parsed_map(spark, sf_dir))
    found = MM.doublets(hit_features(spark, sf_dir), second, False)
    return found.select(E, "mid_1", F.col("hit_id_m").alias("hit_2"), F.col("hit_id_o").alias("hit_3"))


@query("j12_f12_triplets", with_tables("triplets", body="SELECT event_id, hit_1, hit_2, hit_3 FROM triplets"))
def j12_f12_triplets(spark, sf_dir):
    first, second, triplet = text_dumps.module_map_parts(parsed_map(spark, sf_dir))
    h = hit_features(spark, sf_dir)
    found = MM.triplets(MM.doublets(h, first, True), MM.doublets(h, second, False), triplet)
    return found.select(E, "hit_1", "hit_2", "hit_3")


@query(
    "j11_f11_doublet_work",
    with_tables(
        "module_map",
        "hit_features",
        body="""
, p AS (SELECT mid_1, mid_2, greatest(MIN(dphimin_12 / 10), -pi()) AS lo, least(MAX(dphimax_12 / 10), pi()) AS hi
  FROM module_map GROUP BY ALL),
q AS (SELECT *, greatest(floor(4 * 2 * pi() / greatest(hi - lo + 2 * 1e-9, 2 * pi() / 4096)), 1) AS n FROM p),
x AS (SELECT m.event_id, n, floor((o.phi + pi()) / (2 * pi()) * n) AS own,
    floor((m.phi - hi - 1e-9 + pi()) / (2 * pi()) * n) AS lowest, floor((m.phi - lo + 1e-9 + pi()) / (2 * pi()) * n) AS highest
  FROM q JOIN hit_features m ON m.module_id = q.mid_2
  JOIN hit_features o ON o.event_id = m.event_id AND o.module_id = q.mid_1)
SELECT event_id, COUNT(*) FILTER (((own - lowest) % n + n) % n <= least(highest - lowest, n - 1)) AS n_compared, COUNT(*) AS n_all
FROM x GROUP BY event_id""",
    ),
)
def j11_f11_doublet_work(spark, sf_dir):
    """With a tenth of the map's range of angles: the pairs that its bins compare, of all pairs of the map's modules."""
    first = text_dumps.module_map_parts(parsed_map(spark, sf_dir))[0]
    first = first.withColumns({c: F.col(c) / 10 for c in ("dphimin_12", "dphimax_12")})
    return MM.doublet_work(hit_features(spark, sf_dir), first, True)


@query(
    "g9_module_map_graph",
    with_tables(
        "map_edges",
        "track_edges",
        body="""SELECT m.event_id, m.src, m.dst, t.src IS NOT NULL AS y FROM map_edges m
LEFT JOIN track_edges t ON t.event_id = m.event_id AND t.src = m.src AND t.dst = m.dst""",
    ),
)
def g9_module_map_graph(spark, sf_dir):
    """J11, J12, D3 and J13: doublets, triplets, distinct edges, truth."""
    built = MM.build_module_map_graph(
        hit_features(spark, sf_dir), parsed_map(spark, sf_dir), plain_track_edges(spark, sf_dir)
    )
    return built.select(E, "src", "dst", "y")


# ---- J14, J15 ------------------------------------------------------------------
def _brute(points: str, distance: str, r: float, k: int) -> str:
    """Brute-force neighbours: nearest k within r, ties by id, loops dropped last."""
    return f"""
SELECT event_id, src, dst, distance FROM (
SELECT event_id, src, dst, distance, ROW_NUMBER() OVER (PARTITION BY event_id, src ORDER BY d2, dst) AS n FROM (
SELECT a.event_id, a.hit_id AS src, b.hit_id AS dst, {distance} AS d2, round(sqrt({distance}), 6) + 0.0 AS distance
FROM {points} a JOIN {points} b ON a.event_id = b.event_id) WHERE d2 <= {r} * {r}) WHERE n <= {k}"""


XYZ = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
DOT = " + ".join(f"(a.embedding[{i}] - b.embedding[{i}]) * (a.embedding[{i}] - b.embedding[{i}])" for i in range(1, 65))
cte("near_hits", _brute("hits", XYZ, 150.0, 6), "hits")
cte("near_vectors", _brute("vectors", f"({DOT})", 1.25, 10), "vectors")


def space_hits(spark, sf_dir):
    return A.hits(spark, sf_dir).select(E, "hit_id", V.stack(["x", "y", "z"]).alias("v"))


@query(
    "j14_radius_hits",
    with_tables("near_hits", body="SELECT * FROM near_hits WHERE src <> dst"),
)
def j14_radius_hits(spark, sf_dir):
    """Up to six neighbours within 150 of each hit in space, itself counted and then dropped."""
    out = N.radius_neighbours(space_hits(spark, sf_dir), "v", 3, 150.0, 6)
    return out.select(E, "src", "dst", rnd("distance").alias("distance"))


@query(
    "j14_radius_embeddings",
    with_tables("near_vectors", body="SELECT * FROM near_vectors WHERE src <> dst"),
)
def j14_radius_embeddings(spark, sf_dir):
    """T3 too: nearest ten within 1.25 in 64 dimensions."""
    out = N.radius_neighbours(A.vectors(spark, sf_dir), "embedding", 64, 1.25, 10)
    return out.select(E, "src", "dst", rnd("distance").alias("distance"))


cte("whole_vectors", """
SELECT 0 AS event_id, vec_id AS hit_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""")
cte("near_whole_vectors", _brute("whole_vectors", f"({DOT})", 1.05, 8), "whole_vectors")


@query(
    "j14_all_embeddings",
    with_tables("near_whole_vectors", body="SELECT src, dst, distance FROM near_whole_vectors WHERE src <> dst"),
)
def j14_all_embeddings(spark, sf_dir):
    """All embeddings as one event: the nearest eight within 1.05 in 64 dimensions."""
    whole = A.vectors(spark, sf_dir).selectExpr("0L AS event_id", "event_id * 100 + hit_id AS hit_id", "embedding")
    out = N.radius_neighbours(whole, "embedding", 64, 1.05, 8)
    return out.select("src", "dst", rnd("distance").alias("distance"))


@query(
    "j14_radius_work",
    with_tables(
        "vectors", "hits",
        body="""SELECT 'embeddings' AS points, COUNT(*) AS n_sites, TRUE AS below_a_fifth FROM vectors
UNION ALL SELECT 'hits', COUNT(DISTINCT (event_id, x, y, z)), TRUE FROM hits""",
    ),
)
def j14_radius_work(spark, sf_dir):
    """Distances that the pivots leave to compute: less than a fifth of all pairs of an event's places."""
    whole = A.vectors(spark, sf_dir).selectExpr("0L AS event_id", "event_id * 100 + hit_id AS hit_id", "embedding")
    work = N.radius_work(whole, "embedding", 64, 0.1, 8).select(F.lit("embeddings").alias("points"), "*")
    work = work.unionByName(N.radius_work(space_hits(spark, sf_dir), "v", 3, 150.0, 6).select(F.lit("hits").alias("points"), "*"))
    sums = work.groupBy("points").agg(
        F.sum("n_sites").alias("n_sites"), F.sum("n_compared").alias("n"), F.sum(F.col("n_sites") * F.col("n_sites")).alias("all")
    )
    return sums.select("points", "n_sites", (F.col("n") * 5 < F.col("all")).alias("below_a_fifth"))


cte("nearest_hits", _brute("hits", XYZ, 1000000.0, 4), "hits")


@query("j15_nearest_hits", with_tables("nearest_hits", body="SELECT * FROM nearest_hits"))
def j15_nearest_hits(spark, sf_dir):
    """kNN graph with self loops at any distance, by a growing radius."""
    out = N.nearest_neighbours(space_hits(spark, sf_dir), "v", 3, 4)
    return out.select(E, "src", "dst", rnd("distance").alias("distance"))


@query(
    "j15_neighbourhood",
    with_tables(
        "near_hits",
        "nearest_hits",
        body="SELECT event_id, src, dst FROM near_hits WHERE src <> dst UNION SELECT event_id, src, dst FROM nearest_hits",
    ),
)
def j15_neighbourhood(spark, sf_dir):
    """Union of the radius graph and the kNN graph."""
    return N.neighbourhood(space_hits(spark, sf_dir), "v", 3, r=150.0, max_neighbours=6, knn=4)


def _unit(seed: int) -> str:
    return f"CAST({draw_sql('event_id', 'hit_id', seed=seed)} % {1 << 52} AS DOUBLE) / {float(1 << 52)}"


cte("drawn_positions", f"SELECT event_id, hit_id, {_unit(7)} AS x, {_unit(8)} AS y, 0.0 AS z FROM hits", "hits")
cte("random_nearest", _brute("drawn_positions", XYZ, 10.0, 3), "drawn_positions")


@query(
    "j15_random_neighbourhood",
    with_tables("random_nearest", body="SELECT event_id, src, dst FROM random_nearest"),
)
def j15_random_neighbourhood(spark, sf_dir):
    """kNN graph of drawn positions."""
    return N.neighbourhood(space_hits(spark, sf_dir), "v", 3, random_k=3, seed=7)


@query(
    "a15_p23_gravity_pooling",
    with_tables(
        "near_hits",
        "hits",
        body="""
, w AS (SELECT n.event_id, n.dst AS hit_id, s.deposit * exp(-2.0 * """
        + XYZ.replace("a.", "s.").replace("b.", "d.")
        + """ / (150.0 * 150.0)) AS v
FROM near_hits n JOIN hits s ON s.event_id = n.event_id AND s.hit_id = n.src
JOIN hits d ON d.event_id = n.event_id AND d.hit_id = n.dst WHERE n.src <> n.dst)
SELECT h.event_id, h.hit_id, round(COALESCE(SUM(v), 0), 4) + 0.0 AS pooled
FROM hits h LEFT JOIN w USING (event_id, hit_id) GROUP BY ALL""",
    ),
)
def a15_p23_gravity_pooling(spark, sf_dir):
    """Neighbours weighted by exp(-g d^2 / r^2), pooled at the destination."""
    from ..operators.messages import weighted_pooling

    near = N.radius_neighbours(space_hits(spark, sf_dir), "v", 3, 150.0, 6)
    weighted = near.withColumn("w", decay_weight(F.col("distance") * F.col("distance"), 2.0, 150.0))
    h = A.hits(spark, sf_dir).select(E, "hit_id", V.stack(["deposit"]).alias("x"))
    out = weighted_pooling(h, weighted, "x", 1, "w", ["sum"])
    return out.select(E, "hit_id", rnd(F.get("pooled", F.lit(0)), 4).alias("pooled"))


# ---- D7, T6, G11 ---------------------------------------------------------------
cte("query_points_50", f"""
SELECT event_id, hit_id, particle_id FROM (SELECT *, ROW_NUMBER() OVER (
  PARTITION BY event_id ORDER BY {draw_sql('event_id', 'hit_id', seed=3)}, hit_id) AS n FROM hits) WHERE n <= 50""", "hits")
cte("query_points_100", f"""
SELECT event_id, hit_id, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY hit_id) - 1 AS i, COUNT(*) OVER (PARTITION BY event_id) AS n
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY {draw_sql('event_id', 'hit_id', seed=0)}, hit_id) AS o FROM hits)
WHERE o <= 100""", "hits")


@query("t6_query_points", with_tables("query_points_50", body="SELECT event_id, hit_id, particle_id FROM query_points_50"))
def t6_query_points(spark, sf_dir):
    """Fifty drawn query points per event (a sampling operator)."""
    return SM.query_points(A.hits(spark, sf_dir).select(E, "hit_id", "particle_id"), 50, seed=3)


@query(
    "t6_sample_sizes",
    with_tables(
        "hits", body="SELECT event_id, least(COUNT(*), 50) AS n, least(COUNT(*), 50) AS n_distinct FROM hits GROUP BY event_id"
    ),
)
def t6_sample_sizes(spark, sf_dir):
    drawn = SM.query_points(A.hits(spark, sf_dir), 50, seed=3)
    return drawn.groupBy(E).agg(F.count("*").alias("n"), F.count_distinct("hit_id").alias("n_distinct"))


@query(
    "d7_training_edges",
    with_tables(
        "query_points_100",
        "near_hits",
        "te",
        body=f"""
, p AS (SELECT event_id, hit_id, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY hit_id) - 1 AS i FROM hits),
m AS (SELECT event_id, COUNT(*) AS n FROM hits GROUP BY event_id),
w AS (SELECT q.event_id, i, {draw_sql('q.event_id', 'i', seed=0)} % q.n AS a, {draw_sql('q.event_id', 'i', seed=1)} % m.n AS b
  FROM query_points_100 q JOIN m USING (event_id) WHERE i < floor(q.n * 0.5)),
s AS (SELECT event_id, src, dst FROM te WHERE COALESCE(pt BETWEEN 1 AND 1e9, FALSE) AND COALESCE(nhits BETWEEN 3 AND 1e9, FALSE))
SELECT n.event_id, src, dst FROM near_hits n JOIN query_points_100 q ON q.event_id = n.event_id AND q.hit_id = n.src WHERE src <> dst
UNION SELECT w.event_id, q.hit_id, p.hit_id FROM w JOIN query_points_100 q ON q.event_id = w.event_id AND q.i = w.a
  JOIN p ON p.event_id = w.event_id AND p.i = w.b
UNION SELECT event_id, src, dst FROM s UNION SELECT event_id, dst, src FROM s""",
    ),
)
def d7_training_edges(spark, sf_dir):
    """Near pairs of sampled queries, random pairs and signal edges both ways, distinct."""
    signal = WT.signal_edges(plain_track_edges(spark, sf_dir), RULES)
    return SM.training_edges(space_hits(spark, sf_dir), "v", 3, signal, 100, 150.0, 6, 0.5)


@query(
    "d7_signal_in_training",
    with_tables(
        "te",
        body="""SELECT event_id, 2 * COUNT(*) AS n_signal FROM te WHERE COALESCE(pt BETWEEN 1 AND 1e9, FALSE)
AND COALESCE(nhits BETWEEN 3 AND 1e9, FALSE) GROUP BY event_id""",
    ),
)
def d7_signal_in_training(spark, sf_dir):
    """Every signal edge, in both directions, is among the training edges."""
    signal = WT.signal_edges(plain_track_edges(spark, sf_dir), RULES).select(E, "src", "dst")
    both = signal.unionByName(signal.select(E, F.col("dst").alias("src"), F.col("src").alias("dst")))
    training = SM.training_edges(space_hits(spark, sf_dir), "v", 3, signal, 100, 150.0, 6, 0.5)
    return training.join(both, [E, "src", "dst"], "left_semi").groupBy(E).agg(F.count("*").alias("n_signal"))


cte("negatives", """
SELECT event_id, edge_id, c AS class, ROW_NUMBER() OVER (PARTITION BY event_id, c ORDER BY edge_id) - 1 AS place,
  COUNT(*) OVER (PARTITION BY event_id, c) AS size
FROM (SELECT event_id, edge_id, unnest([CAST(score > 0.5 AS INTEGER), 2]) AS c FROM weighted
  WHERE (NOT y AND weight <> 0) OR weight < 0)""", "weighted")
cte("negative_draws", f"""
SELECT t.event_id, t.edge_id, turn, hard, CASE WHEN EXISTS (SELECT 1 FROM negatives n WHERE n.event_id = t.event_id
  AND n.class = hard) THEN hard ELSE 2 END AS class
FROM weighted t, (SELECT unnest([0, 1]) AS turn), (SELECT unnest([1, 0]) AS hard) WHERE t.y AND t.weight > 0""",
    "weighted", "negatives")


@query(
    "g11_negative_subsample",
    with_tables(
        "negative_draws",
        body=f"""
, d AS (SELECT DISTINCT ON (d.event_id, d.edge_id, turn, hard) d.event_id, hard, n.class, n.size,
    {draw_sql('d.event_id', 'd.class', 'd.edge_id', 'turn', 'hard', seed=0)} AS h
  FROM negative_draws d JOIN negatives n ON n.event_id = d.event_id AND n.class = d.class)
SELECT event_id, edge_id, y, weight, score, 'true' AS sample FROM weighted WHERE y AND weight > 0 UNION ALL
SELECT w.event_id, w.edge_id, w.y, w.weight, w.score, CASE WHEN d.hard = 1 THEN 'hard' ELSE 'easy' END
FROM d JOIN negatives n ON n.event_id = d.event_id AND n.class = d.class AND n.place = d.h % d.size
JOIN weighted w ON w.event_id = n.event_id AND w.edge_id = n.edge_id""",
    ),
)
def g11_negative_subsample(spark, sf_dir):
    """All signal edges and hash-drawn hard and easy negatives."""
    out = SM.subsample_negatives(weighted_edges(spark, sf_dir), 2, 0.5)
    return out.select(E, "edge_id", "y", "weight", "score", "sample")


@query(
    "g11_subsample_sizes",
    with_tables(
        "weighted",
        body="""
, n AS (SELECT event_id, COUNT(*) FILTER (y AND weight > 0) AS t FROM weighted GROUP BY event_id)
SELECT event_id, 'true' AS sample, t AS n FROM n UNION ALL SELECT event_id, 'hard', 2 * t FROM n
UNION ALL SELECT event_id, 'easy', 2 * t FROM n""",
    ),
)
def g11_subsample_sizes(spark, sf_dir):
    out = SM.subsample_negatives(weighted_edges(spark, sf_dir), 2, 0.5)
    return out.groupBy(E, "sample").agg(F.count("*").alias("n"))


def _sizes_sql(edges: str) -> str:
    """Signal edges and twice as many of either kind of negative, for events that have any negative."""
    return f"""
, b AS ({edges}),
n AS (SELECT event_id, COUNT(*) FILTER (y AND weight > 0) AS t, COUNT(*) FILTER ((NOT y AND weight <> 0) OR weight < 0) AS f
  FROM b GROUP BY event_id)
SELECT event_id, 'true' AS sample, t AS n, t AS n_signal FROM n WHERE t > 0 UNION ALL
SELECT event_id, s, 2 * t, 0 FROM n, (SELECT unnest(['hard', 'easy']) AS s) WHERE t > 0 AND f > 0"""


def _sample_sizes(edges):
    out = SM.subsample_negatives(edges, 2, 0.5)
    signal = F.count_if(F.col("y") & (F.col("weight") > 0))
    return out.groupBy(E, "sample").agg(F.count("*").alias("n"), signal.alias("n_signal"))


# ---- U1, U2, G10, G12, G14 -----------------------------------------------------
EMBEDDING = Mlp(
    layers=(
        (np.array([[0.002, 0.001], [-0.001, 0.002], [0.0005, -0.0005]]), np.array([0.1, -0.2])),
        (np.array([[1.0, 0.5], [-0.5, 1.0]]), np.array([0.0, 0.25])),
    ),
    hidden="tanh",
)
cte("embedded", """
SELECT event_id, hit_id, particle_id, h0 - 0.5 * h1 AS e0, 0.5 * h0 + h1 + 0.25 AS e1 FROM (
SELECT *, tanh(0.002 * x - 0.001 * y + 0.0005 * z + 0.1) AS h0, tanh(0.001 * x + 0.002 * y - 0.0005 * z - 0.2) AS h1
FROM hits)""", "hits")


@query(
    "u1_embedding",
    with_tables("embedded", body="SELECT event_id, hit_id, round(e0, 6) + 0.0 AS e0, round(e1, 6) + 0.0 AS e1 FROM embedded"),
)
def u1_embedding(spark, sf_dir):
    """A small network over the stacked hit features, in Arrow batches."""
    out = space_hits(spark, sf_dir).withColumn("e", embed_udf(EMBEDDING)("v"))
    return out.select(E, "hit_id", *[rnd(F.get("e", F.lit(i))).alias(f"e{i}") for i in range(2)])


SCORER = Mlp(layers=((np.array([[0.001], [0.0], [-0.001], [0.002]]), np.array([0.3])),))


@query(
    "u2_g12_edge_scores",
    with_tables(
        "edges",
        "hits",
        body="""SELECT e.event_id, e.edge_id, round(1.0 / (1.0 + exp(-(0.001 * a.x - 0.001 * b.x + 0.002 * b.z + 0.3))), 6) + 0.0
AS score FROM edges e JOIN hits a ON a.event_id = e.event_id AND a.hit_id = e.src
JOIN hits b ON b.event_id = e.event_id AND b.hit_id = e.dst""",
    ),
)
def u2_g12_edge_scores(spark, sf_dir):
    """Network on the gathered endpoint features, then the sigmoid."""
    out = SC.score_edges(A.candidate_edges(spark, sf_dir), A.hits(spark, sf_dir), ["x", "z"], SCORER)
    return out.select(E, "edge_id", rnd("score").alias("score"))


cte("unit_vectors", """
SELECT event_id, hit_id, particle_id, e0 / sqrt(e0 * e0 + e1 * e1) AS x, e1 / sqrt(e0 * e0 + e1 * e1) AS y FROM embedded
""", "embedded")
cte("embedding_edges", _brute("unit_vectors", "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))", 0.05, 8), "unit_vectors")


@query(
    "g10_embedding_graph",
    with_tables(
        "embedding_edges",
        "te",
        body="""
, p AS (SELECT event_id, least(src, dst) AS lo, greatest(src, dst) AS hi FROM embedding_edges WHERE src <> dst GROUP BY ALL),
t AS (SELECT event_id, least(src, dst) AS lo, greatest(src, dst) AS hi, MAX(pt) AS pt, MAX(nhits) AS nhits FROM te
      GROUP BY ALL)
SELECT p.event_id, p.lo, p.hi, t.lo IS NOT NULL AS y FROM p LEFT JOIN t USING (event_id, lo, hi)""",
    ),
)
def g10_embedding_graph(spark, sf_dir):
    """Embed, normalise, radius graph, truth both ways, one edge per pair."""
    h = A.hits(spark, sf_dir)
    edges, _ = P.embedding_graph(
        h, ["x", "y", "z"], EMBEDDING, 2, plain_track_edges(spark, sf_dir), RULES[:2], r=0.05, k=8, undirected=True
    )
    return edges.select(E, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "y")


@query(
    "g9_m8_g11_module_map_negatives",
    with_tables(
        "map_edges",
        "te",
        body=_sizes_sql("""
SELECT m.event_id, t.src IS NOT NULL AS y, CASE WHEN t.src IS NULL THEN 1.0 WHEN COALESCE(pdg_id IN (11, -11), FALSE) THEN -1.0
  WHEN COALESCE(pt BETWEEN 1 AND 1e9, FALSE) AND COALESCE(nhits BETWEEN 3 AND 1e9, FALSE) THEN 2.0 ELSE 0.0 END AS weight
FROM map_edges m LEFT JOIN te t ON t.event_id = m.event_id AND t.src = m.src AND t.dst = m.dst"""),
    ),
)
def g9_m8_g11_module_map_negatives(spark, sf_dir):
    """Module-map graph with its own edge ids, weighted, then sampled; scores from the hit numbers of the ends."""
    true = cut_lineage(plain_track_edges(spark, sf_dir))
    built = cut_lineage(MM.build_module_map_graph(hit_features(spark, sf_dir), parsed_map(spark, sf_dir), true))
    score = F.pmod(F.col("src") + F.col("dst"), F.lit(10)) / 10
    weighted = WT.weight_edges(built.withColumn("score", score), RULES[:2], M.link_track_edges(true, built))
    return _sample_sizes(weighted)


@query(
    "g10_g11_embedding_negatives",
    with_tables(
        "embedding_edges",
        "te",
        body=_sizes_sql("""
SELECT p.event_id, t.lo IS NOT NULL AS y, 1.0 AS weight FROM (SELECT event_id, least(src, dst) AS lo, greatest(src, dst) AS hi FROM embedding_edges WHERE src <> dst GROUP BY ALL) p
LEFT JOIN (SELECT DISTINCT event_id, least(src, dst) AS lo, greatest(src, dst) AS hi FROM te) t USING (event_id, lo, hi)"""),
    ),
)
def g10_g11_embedding_negatives(spark, sf_dir):
    """The sampler on the embedding graph as built, with its own edge ids; scores from the hit numbers of the ends."""
    edges, _ = P.embedding_graph(
        A.hits(spark, sf_dir), ["x", "y", "z"], EMBEDDING, 2, plain_track_edges(spark, sf_dir), RULES[:2], r=0.05, k=8
    )
    score = F.pmod(F.col("src") + F.col("dst"), F.lit(10)) / 10
    return _sample_sizes(edges.withColumns({"score": score, "weight": F.lit(1.0)}))


@query("g14_fitted_edge_scores")
def g14_fitted_edge_scores(spark, sf_dir):
    """Distributed weighted fit on the whole edge table, then its scores."""
    h = hit_features(spark, sf_dir)
    h = ET.scale(h, {"r": 1000.0, "phi": 3.14, "z": 1000.0})
    edges = weighted_edges(spark, sf_dir)
    model = SC.fit_edge_classifier(edges, h, ["r", "phi", "z"])
    return SC.apply_edge_classifier(model, edges, h, ["r", "phi", "z"]).select(E, "edge_id", "y", "score")


@query(
    "g14_fit_gradient",
    with_tables("weighted", body="SELECT COUNT(*) FILTER (weight <> 0) AS n_used, 0.0::DOUBLE AS worst FROM weighted"),
)
def g14_fit_gradient(spark, sf_dir):
    """The fit of g14 is an optimum: its weighted mean gradient is 0."""
    h = ET.scale(hit_features(spark, sf_dir), {"r": 1000.0, "phi": 3.14, "z": 1000.0})
    edges = weighted_edges(spark, sf_dir)
    model = SC.fit_edge_classifier(edges, h, ["r", "phi", "z"], max_iter=100)
    scored = SC.apply_edge_classifier(model, edges, h, ["r", "phi", "z"])
    return SC.mean_gradient(scored, h, ["r", "phi", "z"]).select("n_used", rnd("worst", 3).alias("worst"))
