"""Queries that build, match and evaluate tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.binomial import interval_udf
from ..functions.conditions import all_of
from ..operators import components as CC
from ..operators import cuts as C
from ..operators import evaluation as EV
from ..operators import matching as MT
from ..operators import paths as PT
from ..operators.joins import E, gather
from ..operators.ranking import successive_pairs
from ..operators.truth_edges import orient_outward
from ..plans import tracks as P
from ..session import cut_lineage
from ..sources import adapters as A
from ..sources import sinks
from .graph_tables import graph, plain_track_edges, track_edges, weighted_edges
from .registry import query, rnd
from .sqltables import cte, with_tables
from .truth_tables import hit_features

INF = float("inf")

# ---- components ----------------------------------------------------------------
cte("linked", """
SELECT event_id, src, dst FROM edges WHERE score > 0.55 UNION SELECT event_id, dst, src FROM edges WHERE score > 0.55""",
    "edges")
REACH = """
, reach(event_id, a, b) AS (
  SELECT event_id, hit_id, hit_id FROM hits UNION
  SELECT r.event_id, r.a, l.dst FROM reach r JOIN linked l ON l.event_id = r.event_id AND l.src = r.b),
comp AS (SELECT event_id, a AS hit_id, MIN(b) AS component, COUNT(*) AS n_hits FROM reach GROUP BY ALL)"""


@query(
    "g1_connected_components",
    with_tables("linked", recursive=True, body=REACH + " SELECT event_id, hit_id, component AS track_id FROM comp"),
)
def g1_connected_components(spark, sf_dir):
    """Every hit labelled by the least hit of its component; hits alone label themselves."""
    return CC.connected_components(A.hits(spark, sf_dir), A.candidate_edges(spark, sf_dir), 0.55)


@query(
    "g2_weak_components",
    with_tables(
        "linked",
        recursive=True,
        body=REACH + " SELECT event_id, hit_id, CASE WHEN n_hits > 1 THEN component ELSE -1 END AS track_id FROM comp",
    ),
)
def g2_weak_components(spark, sf_dir):
    return CC.weak_components(A.hits(spark, sf_dir), A.candidate_edges(spark, sf_dir), 0.55)


PATHS = REACH + """
, deg AS (SELECT event_id, hit_id, SUM(i) AS n_in, SUM(o) AS n_out FROM (
  SELECT event_id, dst AS hit_id, 1 AS i, 0 AS o FROM edges WHERE score > 0.55 UNION ALL
  SELECT event_id, src, 0, 1 FROM edges WHERE score > 0.55) GROUP BY ALL),
shape AS (SELECT event_id, component, COUNT(*) AS n_hits, MAX(greatest(n_in, n_out)) <= 1 AS is_path
  FROM deg JOIN comp USING (event_id, hit_id) GROUP BY ALL)"""


@query(
    "g3_component_shapes",
    with_tables("linked", recursive=True, body=PATHS + " SELECT event_id, component, COUNT(*) AS n_hits,"
                " MAX(greatest(n_in, n_out)) <= 1 AS is_path FROM deg JOIN comp USING (event_id, hit_id) GROUP BY ALL"),
)
def g3_component_shapes(spark, sf_dir):
    kept = C.score_cut(A.candidate_edges(spark, sf_dir), 0.55, "above")
    return CC.component_shapes(kept, CC.component_labels(kept))


@query(
    "g3_simple_path_tracks",
    with_tables(
        "linked",
        recursive=True,
        body=PATHS
        + """ SELECT c.event_id, c.hit_id, c.component AS track_id FROM comp c JOIN shape s
ON s.event_id = c.event_id AND s.component = c.component WHERE s.is_path AND s.n_hits > 2""",
    ),
)
def g3_simple_path_tracks(spark, sf_dir):
    kept = C.score_cut(A.candidate_edges(spark, sf_dir), 0.55, "above")
    labels = CC.component_labels(kept)
    return CC.simple_path_tracks(kept, labels, CC.component_shapes(kept, labels))[0]


# ---- walkthrough ---------------------------------------------------------------
#: One road after another, in steps: the open roads of a start grow by the choices of their last hit; when none
#: grows any more the longest, of several the last, is taken; then the earliest free hit starts.
WALK = """
, a AS (SELECT t.event_id, t.edge_id, t.score, a.r * a.r + a.z * a.z AS da, b.r * b.r + b.z * b.z AS db, t.src, t.dst
  FROM ({graph}) t JOIN hit_features a ON a.event_id = t.event_id AND a.hit_id = t.src
  JOIN hit_features b ON b.event_id = t.event_id AND b.hit_id = t.dst WHERE t.score > {cut} AND t.src <> t.dst),
o AS (SELECT event_id, edge_id, score, da > db OR (da = db AND src > dst) AS inward, src, dst FROM a),
g AS MATERIALIZED (SELECT event_id, CASE WHEN inward THEN dst ELSE src END AS src, CASE WHEN inward THEN src ELSE dst END AS dst,
  arg_max(score, edge_id) AS score FROM o GROUP BY ALL),
u AS (SELECT event_id, src, dst FROM g UNION SELECT event_id, dst, src FROM g),
reach(event_id, x, y) AS (SELECT event_id, src, src FROM u UNION SELECT r.event_id, r.x, u.dst FROM reach r
  JOIN u ON u.event_id = r.event_id AND u.src = r.y),
comp AS MATERIALIZED (SELECT event_id, x AS hit_id, MIN(y) AS component, COUNT(*) AS n_hits FROM reach GROUP BY ALL),
deg AS (SELECT event_id, hit_id, SUM(i) AS n_in, SUM(k) AS n_out FROM (
  SELECT event_id, dst AS hit_id, 1 AS i, 0 AS k FROM g UNION ALL SELECT event_id, src, 0, 1 FROM g) GROUP BY ALL),
shape AS (SELECT event_id, component, MAX(greatest(n_in, n_out)) <= 1 AS is_path FROM deg JOIN comp USING (event_id, hit_id) GROUP BY ALL),
w AS MATERIALIZED (SELECT g.* FROM g JOIN comp c ON c.event_id = g.event_id AND c.hit_id = g.src
  JOIN shape s ON s.event_id = c.event_id AND s.component = c.component WHERE NOT s.is_path),
lev(event_id, hit_id, level) AS (SELECT event_id, src, 0 FROM w UNION SELECT event_id, dst, 0 FROM w
  UNION SELECT v.event_id, w.dst, level + 1 FROM lev v JOIN w ON w.event_id = v.event_id AND w.src = v.hit_id),
turns AS MATERIALIZED (SELECT event_id, hit_id, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY level, hit_id) AS turn
  FROM (SELECT event_id, hit_id, MAX(level) AS level FROM lev GROUP BY ALL)),
walk(event_id, kind, hit_id, track_id, path, ranks) AS (
  SELECT event_id, 'open', hit_id, hit_id, [hit_id], [0::BIGINT] FROM turns WHERE turn = 1
  UNION ALL
  (WITH busy AS (SELECT DISTINCT event_id FROM walk WHERE kind = 'open'),
  grown AS (
    SELECT p.event_id, p.track_id, p.path, p.ranks, w.dst, w.score,
      ROW_NUMBER() OVER (PARTITION BY p.event_id, p.path ORDER BY w.score DESC, w.dst) AS n,
      MAX(w.score) OVER (PARTITION BY p.event_id, p.path) AS best
    FROM walk p JOIN w ON w.event_id = p.event_id AND w.src = p.hit_id
    WHERE p.kind = 'open' AND NOT EXISTS (
      SELECT 1 FROM walk q WHERE q.kind = 'used' AND q.event_id = w.event_id AND q.hit_id = w.dst)),
  longer AS (SELECT event_id, track_id, list_append(path, dst) AS path, list_append(ranks, n) AS ranks, path AS old, dst
    FROM grown WHERE best > {low} AND (n = 1 OR score > {add})),
  ended AS (SELECT p.event_id, p.track_id, p.path, p.ranks FROM walk p WHERE p.kind = 'open' AND NOT EXISTS (
    SELECT 1 FROM longer l WHERE l.event_id = p.event_id AND l.old = p.path)),
  best AS (SELECT event_id, arg_max(path, (len(path), ranks)) AS path FROM walk
    WHERE kind = 'ended' AND event_id NOT IN (SELECT event_id FROM busy) GROUP BY event_id),
  rest AS (SELECT t.event_id, arg_min(t.hit_id, t.turn) AS hit_id FROM turns t
    WHERE t.event_id IN (SELECT event_id FROM walk WHERE kind = 'used')
      AND t.event_id NOT IN (SELECT event_id FROM walk WHERE kind <> 'used')
      AND NOT EXISTS (SELECT 1 FROM walk q WHERE q.kind = 'used' AND q.event_id = t.event_id AND q.hit_id = t.hit_id)
    GROUP BY t.event_id),
  live AS (SELECT event_id FROM walk WHERE kind <> 'used' UNION SELECT event_id FROM rest)
  SELECT event_id, 'open', dst, track_id, path, ranks FROM longer
  UNION ALL SELECT event_id, 'ended', NULL, track_id, path, ranks FROM ended
  UNION ALL SELECT event_id, 'ended', NULL, track_id, path, ranks FROM walk
    WHERE kind = 'ended' AND event_id IN (SELECT event_id FROM busy)
  UNION ALL SELECT event_id, 'used', unnest(path), path[1], NULL, NULL FROM best
  UNION ALL SELECT event_id, 'open', hit_id, hit_id, [hit_id], [0::BIGINT] FROM rest
  UNION ALL SELECT event_id, 'used', hit_id, track_id, NULL, NULL FROM walk
    WHERE kind = 'used' AND event_id IN (SELECT event_id FROM live))),
tracks AS (SELECT c.event_id, c.hit_id, c.component AS track_id, 'cc' AS reco_method FROM comp c
  JOIN shape s ON s.event_id = c.event_id AND s.component = c.component WHERE s.is_path AND c.n_hits > 2
  UNION ALL SELECT DISTINCT event_id, hit_id, track_id, 'walk' FROM walk WHERE kind = 'used')
SELECT event_id, hit_id, track_id, reco_method FROM tracks"""


def _walk_sql(graph_sql: str, cut: float, low: float, add: float) -> str:
    return with_tables("edges", "hit_features", recursive=True, body=WALK.format(graph=graph_sql, cut=cut, low=low, add=add))


@query("g4_g5_cc_and_walk", _walk_sql("SELECT event_id, edge_id, src, dst, score FROM edges", 0.3, 0.35, 0.7))
def g4_g5_cc_and_walk(spark, sf_dir):
    """Components, simple paths and the walkthrough on branched components."""
    return P.cc_and_walk(hit_features(spark, sf_dir), A.candidate_edges(spark, sf_dir), 0.3, 0.35, 0.7)


@query(
    "g5_walk_coverage",
    with_tables(
        "edge_ends",
        body="""SELECT event_id, COUNT(DISTINCT hit_id) AS n_hits FROM edge_ends WHERE score > 0.3 GROUP BY event_id""",
    ),
)
def g5_walk_coverage(spark, sf_dir):
    """J18 and D10 too: hits on a track, plus hits of unbranched pairs, are the hits with an edge."""
    h, e = hit_features(spark, sf_dir), A.candidate_edges(spark, sf_dir)
    on_track = P.cc_and_walk(h, e, 0.3, 0.35, 0.7).select(E, "hit_id")
    graph = P.outward_graph(h, e, 0.3)
    labels = CC.component_labels(graph)
    pairs = CC.component_shapes(graph, labels).where("is_path and n_hits = 2").select(E, "component")
    short = labels.join(pairs, [E, "component"], "left_semi").select(E, "hit_id")
    return on_track.unionByName(short).groupBy(E).agg(F.count("*").alias("n_hits"))


@query(
    "g4_roads_are_joined",
    with_tables("hits", body="SELECT DISTINCT event_id, 0::BIGINT AS n_double, 0::BIGINT AS n_broken FROM hits"),
)
def g4_roads_are_joined(spark, sf_dir):
    """No hit is on two tracks, and hits that follow each other outward on a walked track share an edge above the lower cut."""
    h, e = hit_features(spark, sf_dir), A.candidate_edges(spark, sf_dir)
    found = cut_lineage(P.cc_and_walk(h, e, 0.3, 0.35, 0.7))
    double = found.groupBy(E, "hit_id").count().groupBy(E).agg(F.count_if(F.col("count") > 1).alias("n_double"))
    distance = (F.col("r") * F.col("r") + F.col("z") * F.col("z")).alias("d")
    walked = found.where("reco_method = 'walk'").join(h.select(E, "hit_id", distance), [E, "hit_id"])
    along = Window.partitionBy(E, "track_id").orderBy("d", "hit_id")  # one road
    steps = walked.select(E, F.col("hit_id").alias("src"), F.lead("hit_id").over(along).alias("dst")).where("dst is not null")
    joined = P.outward_graph(h, e, 0.35).select(E, "src", "dst")
    broken = steps.join(joined, [E, "src", "dst"], "left_anti").groupBy(E).agg(F.count("*").alias("n_broken"))
    events = h.select(E).distinct().join(double, E, "left").join(broken, E, "left")
    return events.select(E, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_double", "n_broken")])


@query(
    "g5_cc_and_walk_true_graph",
    _walk_sql("SELECT event_id, edge_id, src, dst, CAST(y AS DOUBLE) AS score FROM edges", 0.0, 0.35, 0.7),
)
def g5_cc_and_walk_true_graph(spark, sf_dir):
    """The same on the true graph: truth as score, cut 0."""
    return P.cc_and_walk(
        hit_features(spark, sf_dir), A.candidate_edges(spark, sf_dir), 0.3, 0.35, 0.7, on_true_graph=True
    )


@query(
    "d10_j18_hit_labels",
    with_tables(
        "hits",
        body="""
, t AS (SELECT event_id, hit_id, 'cc' AS m, module_id AS track_id FROM hits WHERE particle_id > 20 UNION ALL
  SELECT event_id, hit_id, 'walk', eta_module FROM hits WHERE particle_id > 10 UNION ALL
  SELECT event_id, hit_id, 'walk', eta_module + 1 FROM hits WHERE particle_id > 10),
f AS (SELECT event_id, hit_id, track_id, ROW_NUMBER() OVER (PARTITION BY event_id, hit_id ORDER BY m, track_id) AS n FROM t)
SELECT h.event_id, h.hit_id, COALESCE(f.track_id, -1) AS track_id FROM hits h LEFT JOIN f
ON f.event_id = h.event_id AND f.hit_id = h.hit_id AND f.n = 1""",
    ),
)
def d10_j18_hit_labels(spark, sf_dir):
    h = A.hits(spark, sf_dir)
    cc = h.where("particle_id > 20").selectExpr("event_id", "hit_id", "module_id as track_id", "'cc' as reco_method")
    walk = h.where("particle_id > 10").selectExpr(
        "event_id", "hit_id", "explode(array(eta_module, eta_module + 1)) as track_id", "'walk' as reco_method"
    )
    return P.label_hits(h, P.first_track_per_hit(walk.unionByName(cc)))


# ---- paths ---------------------------------------------------------------------
@query(
    "g6_long_paths",
    with_tables(
        "edges",
        recursive=True,
        body="""
, r AS (SELECT event_id, src, dst FROM edges WHERE score > 0.3 AND score < 0.42),
s AS (SELECT DISTINCT event_id, src AS hit_id FROM r WHERE NOT EXISTS (
  SELECT 1 FROM r q WHERE q.event_id = r.event_id AND q.dst = r.src)),
p(event_id, path, tip, n) AS (
  SELECT event_id, [hit_id], hit_id, 1 FROM s UNION ALL
  SELECT p.event_id, list_append(p.path, r.dst), r.dst, n + 1 FROM p JOIN r ON r.event_id = p.event_id AND r.src = p.tip
  WHERE n < 26),
w AS (SELECT event_id, path FROM p WHERE n >= 4 AND NOT EXISTS (
  SELECT 1 FROM r WHERE r.event_id = p.event_id AND r.src = p.tip)),
h AS (SELECT event_id, hit_id, MAX(path) AS path FROM (SELECT event_id, path, unnest(path) AS hit_id FROM w) GROUP BY ALL),
n AS (SELECT event_id, src AS hit_id FROM r UNION SELECT event_id, dst FROM r)
SELECT n.event_id, n.hit_id, array_to_string(h.path, ' ') AS path FROM n LEFT JOIN h USING (event_id, hit_id)""",
    ),
)
def g6_long_paths(spark, sf_dir):
    """Last path of at least four hits through every hit of the residual graph."""
    residual = A.candidate_edges(spark, sf_dir).where("score > 0.3 and score < 0.42")
    out = PT.long_path_labels(residual, min_nodes=4)
    text = F.array_join(F.transform("path", lambda h: h.cast("string")), " ")
    return out.select(E, "hit_id", text.alias("path"))


CYCLIC = """
SELECT event_id, src, dst FROM edges WHERE score > 0.3 AND score < 0.39 UNION
SELECT event_id, dst, src FROM edges WHERE score > 0.3 AND score < 0.39 AND (src + dst) % 4 = 0"""


@query(
    "g6_paths_with_cycles",
    with_tables(
        "edges",
        recursive=True,
        body=f"""
, r AS MATERIALIZED ({CYCLIC}),
s AS (SELECT DISTINCT event_id, src AS hit_id FROM r WHERE NOT EXISTS (
  SELECT 1 FROM r q WHERE q.event_id = r.event_id AND q.dst = r.src)),
p(event_id, path, tip) AS (
  SELECT event_id, [hit_id], hit_id FROM s UNION ALL
  SELECT p.event_id, list_append(p.path, r.dst), r.dst FROM p JOIN r ON r.event_id = p.event_id AND r.src = p.tip
  WHERE len(p.path) < 26 AND NOT list_contains(p.path, r.dst)),
w AS (SELECT event_id, path FROM p WHERE len(path) >= 3 AND NOT EXISTS (
  SELECT 1 FROM r WHERE r.event_id = p.event_id AND r.src = p.tip)),
h AS (SELECT event_id, hit_id, MAX(path) AS path FROM (SELECT event_id, path, unnest(path) AS hit_id FROM w) GROUP BY ALL),
n AS (SELECT event_id, src AS hit_id FROM r UNION SELECT event_id, dst FROM r)
SELECT n.event_id, n.hit_id, array_to_string(h.path, ' ') AS path FROM n LEFT JOIN h USING (event_id, hit_id)""",
    ),
)
def g6_paths_with_cycles(spark, sf_dir):
    """The same where every fourth edge runs both ways, so that hits lie on cycles."""
    residual = A.candidate_edges(spark, sf_dir).where("score > 0.3 and score < 0.39").select(E, "src", "dst")
    back = residual.where("(src + dst) % 4 = 0").select(E, F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = PT.long_path_labels(residual.unionByName(back), min_nodes=3)
    text = F.array_join(F.transform("path", lambda h: h.cast("string")), " ")
    return out.select(E, "hit_id", text.alias("path"))


@query("g6_all_simple_path_tracks")
def g6_all_simple_path_tracks(spark, sf_dir):
    """Component labels above 0.55, overwritten by long paths of the residual graph (more than seven hits)."""
    h, e = A.hits(spark, sf_dir), A.candidate_edges(spark, sf_dir)
    return PT.all_simple_path_tracks(CC.weak_components(h, e, 0.55), e, 0.1, 0.55)


@query(
    "g6_residual_track_labels",
    with_tables(
        "linked",
        recursive=True,
        body=REACH
        + """
, r AS (SELECT event_id, src, dst FROM edges WHERE score > 0.3 AND score < 0.55),
s AS (SELECT DISTINCT event_id, src AS hit_id FROM r WHERE NOT EXISTS (
  SELECT 1 FROM r q WHERE q.event_id = r.event_id AND q.dst = r.src)),
p(event_id, path, tip, n) AS (
  SELECT event_id, [hit_id], hit_id, 1 FROM s UNION ALL
  SELECT p.event_id, list_append(p.path, r.dst), r.dst, n + 1 FROM p JOIN r ON r.event_id = p.event_id AND r.src = p.tip
  WHERE n < 26),
w AS (SELECT event_id, path FROM p WHERE n >= 8 AND NOT EXISTS (
  SELECT 1 FROM r WHERE r.event_id = p.event_id AND r.src = p.tip)),
h AS (SELECT event_id, hit_id, MAX(path) AS path FROM (SELECT event_id, path, unnest(path) AS hit_id FROM w) GROUP BY ALL),
l AS (SELECT event_id, path, MIN(hit_id) AS first FROM h GROUP BY ALL),
m AS (SELECT event_id, MAX(hit_id) + 1 AS shift FROM hits GROUP BY event_id),
n AS (SELECT event_id, src AS hit_id FROM r UNION SELECT event_id, dst FROM r)
SELECT c.event_id, c.hit_id, CASE WHEN l.first IS NOT NULL THEN l.first + m.shift WHEN n.hit_id IS NOT NULL THEN -1
  WHEN c.n_hits > 1 THEN c.component ELSE -1 END AS track_id
FROM comp c JOIN m ON m.event_id = c.event_id
LEFT JOIN n ON n.event_id = c.event_id AND n.hit_id = c.hit_id
LEFT JOIN h ON h.event_id = c.event_id AND h.hit_id = c.hit_id
LEFT JOIN l ON l.event_id = h.event_id AND l.path = h.path""",
    ),
)
def g6_residual_track_labels(spark, sf_dir):
    """The same with a narrower residual window, whose paths SQL can list."""
    h, e = A.hits(spark, sf_dir), A.candidate_edges(spark, sf_dir)
    return PT.all_simple_path_tracks(CC.weak_components(h, e, 0.55), e, 0.3, 0.55)


cte("strong", "SELECT event_id, src, dst FROM edges WHERE score > 0.57", "edges")
SHORTEST = """
, s AS (SELECT DISTINCT event_id, src AS hit_id FROM strong WHERE NOT EXISTS (
  SELECT 1 FROM strong q WHERE q.event_id = strong.event_id AND q.dst = strong.src)),
p(event_id, first, path, tip, n) AS (
  SELECT event_id, hit_id, [hit_id], hit_id, 1 FROM s UNION ALL
  SELECT p.event_id, first, list_append(p.path, r.dst), r.dst, n + 1 FROM p
  JOIN strong r ON r.event_id = p.event_id AND r.src = p.tip),
w AS (SELECT event_id, first, tip, MIN((n, path)) AS best FROM p WHERE n > 1 AND NOT EXISTS (
  SELECT 1 FROM strong r WHERE r.event_id = p.event_id AND r.src = p.tip) GROUP BY ALL)"""


@query(
    "g7_shortest_paths",
    with_tables(
        "strong",
        recursive=True,
        body=SHORTEST
        + """ SELECT event_id, first AS start, tip AS "end", array_to_string(struct_extract(best, 2), ' ') AS path FROM w""",
    ),
)
def g7_shortest_paths(spark, sf_dir):
    out = PT.shortest_paths(A.candidate_edges(spark, sf_dir), 0.57)
    text = F.array_join(F.transform("path", lambda h: h.cast("string")), " ")
    return out.select(E, "start", "end", text.alias("path"))


@query(
    "g7_all_paths",
    with_tables(
        "edges",
        recursive=True,
        body="""
, r AS MATERIALIZED (SELECT DISTINCT event_id, src, dst FROM edges WHERE score > 0.55),
s AS (SELECT DISTINCT event_id, src AS hit_id FROM r WHERE NOT EXISTS (
  SELECT 1 FROM r q WHERE q.event_id = r.event_id AND q.dst = r.src)),
p(event_id, first, path, tip) AS (
  SELECT event_id, hit_id, [hit_id], hit_id FROM s UNION ALL
  SELECT p.event_id, first, list_append(p.path, r.dst), r.dst FROM p JOIN r ON r.event_id = p.event_id AND r.src = p.tip)
SELECT event_id, first AS start, tip AS "end", array_to_string(path, ' ') AS path FROM p WHERE NOT EXISTS (
  SELECT 1 FROM r WHERE r.event_id = p.event_id AND r.src = p.tip)""",
    ),
)
def g7_all_paths(spark, sf_dir):
    """Every path from a hit without incoming to one without outgoing edges."""
    out = PT.all_paths(A.candidate_edges(spark, sf_dir), 0.55)
    text = F.array_join(F.transform("path", lambda h: h.cast("string")), " ")
    return out.select(E, "start", "end", text.alias("path"))


@query(
    "g7_shortest_path_labels",
    with_tables(
        "strong",
        recursive=True,
        body=SHORTEST
        + """
, u AS (SELECT event_id, first, tip, unnest(struct_extract(best, 2)) AS hit_id FROM w),
m AS (SELECT event_id, hit_id, MIN((first, tip)) AS t FROM u GROUP BY ALL)
SELECT event_id, hit_id, struct_extract(t, 1) AS start, struct_extract(t, 2) AS "end" FROM m""",
    ),
)
def g7_shortest_path_labels(spark, sf_dir):
    return PT.shortest_path_labels(PT.shortest_paths(A.candidate_edges(spark, sf_dir), 0.57))


# ---- matching ------------------------------------------------------------------
cte("labelled", """
SELECT event_id, hit_id, CASE WHEN phi_module = 9 THEN -1 ELSE (module_id % 10) * 100 + eta_module * 10 + barrel_endcap + 1 END
  AS track_id FROM hits""", "hits")
cte("reco", """
SELECT l.event_id, l.hit_id, l.track_id, COALESCE(t.particle_id, 0) AS particle_id
FROM labelled l LEFT JOIN (SELECT event_id, hit_id, arg_max(particle_id, place * 1000000 + track_edge_id) AS particle_id
  FROM te_ends GROUP BY ALL) t USING (event_id, hit_id)""", "labelled", "te_ends")
cte("track_particles", """
SELECT event_id, particle_id, MIN(pt) AS pt, MIN(pdg_id) AS pdg_id, MIN(eta_particle) AS eta_particle FROM te
GROUP BY ALL""", "te")
cte("matching", """
SELECT s.*, r.n_reco_hits, t.n_true_hits, p.pt, p.pdg_id, p.eta_particle, r.n_reco_hits >= 3 AS is_matchable,
  COALESCE(p.pt >= 1.0, FALSE) AND COALESCE(p.pdg_id NOT IN (11, -11), TRUE)
  AND COALESCE(p.eta_particle BETWEEN -3.5 AND 3.5, FALSE) AS is_reconstructable
FROM (SELECT event_id, track_id, particle_id, COUNT(*) AS n_shared FROM reco GROUP BY ALL) s
JOIN (SELECT event_id, track_id, COUNT(*) AS n_reco_hits FROM reco GROUP BY ALL) r USING (event_id, track_id)
JOIN (SELECT event_id, particle_id, COUNT(DISTINCT hit_id) AS n_true_hits FROM reco GROUP BY ALL) t
  USING (event_id, particle_id)
LEFT JOIN track_particles p USING (event_id, particle_id)""", "reco", "track_particles")
cte("matched_tracks", """
SELECT *, CAST(n_shared AS DOUBLE) / n_reco_hits AS purity_reco, CAST(n_shared AS DOUBLE) / n_true_hits AS eff_true,
  CAST(n_shared AS DOUBLE) / n_reco_hits >= 0.500001 AS pure, CAST(n_shared AS DOUBLE) / n_true_hits >= 0.500001 AS whole
FROM matching""", "matching")
SELECTION = {"pt": 1.0, "pdg_id": ["not_in", [11, -11]], "eta_particle": [-3.5, 3.5]}


def labelled(spark, sf_dir):
    return A.hits(spark, sf_dir).selectExpr(
        "event_id", "hit_id",
        "case when phi_module = 9 then -1L else (module_id % 10) * 100 + eta_module * 10 + barrel_endcap + 1 end as track_id",
    )


def matched(spark, sf_dir, style="purity"):
    return P.evaluate_tracks(
        labelled(spark, sf_dir), plain_track_edges(spark, sf_dir), SELECTION, min_track_length=3, style=style
    )


@query(
    "j17b_reconstruction_table",
    with_tables("reco", body="SELECT event_id, hit_id, track_id, particle_id FROM reco"),
)
def j17b_reconstruction_table(spark, sf_dir):
    return MT.reconstruction_table(labelled(spark, sf_dir), plain_track_edges(spark, sf_dir))


@query(
    "j17c_particle_table",
    with_tables("track_particles", body="SELECT event_id, particle_id, pt, pdg_id, eta_particle FROM track_particles"),
)
def j17c_particle_table(spark, sf_dir):
    return MT.particle_table(plain_track_edges(spark, sf_dir), SELECTION)


@query(
    "j17_a8_a9_matching_table",
    with_tables(
        "matching",
        body="""SELECT event_id, track_id, particle_id, n_shared, CAST(n_reco_hits AS BIGINT) AS n_reco_hits, n_true_hits,
is_matchable, is_reconstructable FROM matching""",
    ),
)
def j17_a8_a9_matching_table(spark, sf_dir):
    """Shared-hit counts of every (track, particle), track -1 and particle 0 included."""
    return matched(spark, sf_dir).select(
        E, "track_id", "particle_id", "n_shared", "n_reco_hits", "n_true_hits", "is_matchable", "is_reconstructable"
    )


for _style, _matched, _reconstructed in (
    ("purity", "pure", "pure"),
    ("one_way", "pure", "whole"),
    ("two_way", "pure AND whole", "pure AND whole"),
):

    @query(
        f"a10_matching_{_style.lower()}",
        with_tables(
            "matched_tracks",
            body=f"""SELECT event_id, track_id, particle_id, round(purity_reco, 6) + 0.0 AS purity_reco,
round(eff_true, 6) + 0.0 AS eff_true, {_matched} AS is_matched, {_reconstructed} AS is_reconstructed FROM matched_tracks""",
        ),
    )
    def _a10(spark, sf_dir, style=_style):
        return matched(spark, sf_dir, style).select(
            E,
            "track_id",
            "particle_id",
            rnd("purity_reco").alias("purity_reco"),
            rnd("eff_true").alias("eff_true"),
            "is_matched",
            "is_reconstructed",
        )


cte("summary", """
SELECT COUNT(DISTINCT (event_id, particle_id)) FILTER (is_reconstructable) AS n_particles,
  COUNT(DISTINCT (event_id, particle_id)) FILTER (is_reconstructable AND pure AND is_matchable)
    AS n_reconstructed_particles,
  COUNT(DISTINCT (event_id, track_id)) FILTER (is_matchable) AS n_tracks,
  COUNT(DISTINCT (event_id, track_id)) FILTER (is_matchable AND pure) AS n_matched_tracks,
  COUNT(*) FILTER (is_reconstructable AND pure AND is_matchable)
    - COUNT(DISTINCT (event_id, particle_id)) FILTER (is_reconstructable AND pure AND is_matchable) AS n_duplicates
FROM matched_tracks""", "matched_tracks")
cte("summary_rates", """
SELECT *, CAST(n_reconstructed_particles AS DOUBLE) / n_particles AS efficiency,
  1 - CAST(n_matched_tracks AS DOUBLE) / n_tracks AS fake_rate,
  CAST(n_duplicates AS DOUBLE) / n_reconstructed_particles AS duplication_rate FROM summary""", "summary")


@query(
    "a11_tracking_summary",
    with_tables(
        "summary_rates",
        body="""SELECT n_particles, n_reconstructed_particles, n_tracks, n_matched_tracks, n_duplicates,
round(efficiency, 6) + 0.0 AS efficiency, round(fake_rate, 6) + 0.0 AS fake_rate,
round(duplication_rate, 6) + 0.0 AS duplication_rate FROM summary_rates""",
    ),
)
def a11_tracking_summary(spark, sf_dir):
    out = MT.tracking_summary(matched(spark, sf_dir))
    rates = ["efficiency", "fake_rate", "duplication_rate"]
    return out.select(*[c for c in out.columns if c not in rates], *[rnd(c).alias(c) for c in rates])


@query(
    "s18_result_summary",
    with_tables(
        "summary_rates",
        body="""
SELECT 0::BIGINT AS line, 'Number of reconstructed particles: ' || n_reconstructed_particles AS value FROM summary_rates
UNION ALL SELECT 1, 'Number of particles: ' || n_particles FROM summary_rates
UNION ALL SELECT 2, 'Number of matched tracks: ' || n_matched_tracks FROM summary_rates
UNION ALL SELECT 3, 'Number of tracks: ' || n_tracks FROM summary_rates
UNION ALL SELECT 4, 'Number of duplicate reconstructed particles: ' || n_duplicates FROM summary_rates
UNION ALL SELECT 5, 'Efficiency: ' || format('{:.3f}', efficiency) FROM summary_rates
UNION ALL SELECT 6, 'Fake rate: ' || format('{:.3f}', fake_rate) FROM summary_rates
UNION ALL SELECT 7, 'Duplication rate: ' || format('{:.3f}', duplication_rate) FROM summary_rates""",
    ),
)
def s18_result_summary(spark, sf_dir):
    return sinks.summary_lines(MT.tracking_summary(matched(spark, sf_dir)))


cte("reco_particles", """
SELECT event_id, particle_id, MIN(pt) AS pt, MIN(eta_particle) AS eta_particle, bool_or(pure) AS is_reconstructed
FROM matched_tracks WHERE is_reconstructable GROUP BY ALL""", "matched_tracks")


def reco_particles(spark, sf_dir):
    return MT.reconstructed_particles(matched(spark, sf_dir), ["pt", "eta_particle"])


@query(
    "a12_reconstructed_particles",
    with_tables(
        "reco_particles", body="SELECT event_id, particle_id, pt, eta_particle, is_reconstructed FROM reco_particles"
    ),
)
def a12_reconstructed_particles(spark, sf_dir):
    return reco_particles(spark, sf_dir)


def _binned_sql(table: str, value: str, edges: list[float], passed: str, total: str = "TRUE") -> str:
    inner = " + ".join(f"CAST({value} >= {e!r}::DOUBLE AS INTEGER)" for e in edges[1:-1])
    lows = ", ".join(f"{float(e)!r}::DOUBLE" for e in edges)
    return f"""
, b AS (SELECT CAST({inner} AS BIGINT) AS bin, {passed} AS p, {total} AS t FROM {table}
  WHERE {value} >= {edges[0]!r}::DOUBLE AND {value} <= {edges[-1]!r}::DOUBLE)
SELECT i.bin, round(list_extract([{lows}], i.bin + 1), 6) + 0.0 AS low, round(list_extract([{lows}], i.bin + 2), 6) + 0.0 AS high,
  COUNT(*) FILTER (t) AS n_total, COUNT(*) FILTER (t AND p) AS n_passed,
  round(CASE WHEN COUNT(*) FILTER (t) = 0 THEN 0 ELSE CAST(COUNT(*) FILTER (t AND p) AS DOUBLE) / COUNT(*) FILTER (t) END, 6)
    + 0.0 AS efficiency
FROM (SELECT unnest(range({len(edges) - 1})) AS bin) i LEFT JOIN b USING (bin) GROUP BY i.bin"""


def _rounded_bins(binned):
    return binned.select(
        "bin", rnd("low").alias("low"), rnd("high").alias("high"), "n_total", "n_passed",
        rnd("efficiency").alias("efficiency"), *[c for c in binned.columns if c.startswith("err_")],
    )


PT_BINS = [0.5, 1.0, 2.0, 3.0, 4.0, 4.9]
ETA_BINS = [-4.0 + 0.8 * i for i in range(11)]


@query("a18_efficiency_by_pt", with_tables("reco_particles", body=_binned_sql("reco_particles", "pt", PT_BINS, "is_reconstructed")))
def a18_efficiency_by_pt(spark, sf_dir):
    """Explicit bins; the last one holds its upper edge."""
    return _rounded_bins(EV.binned_efficiency(reco_particles(spark, sf_dir), "pt", PT_BINS, F.col("is_reconstructed")))


@query(
    "a18_efficiency_by_eta",
    with_tables("reco_particles", body=_binned_sql("reco_particles", "eta_particle", ETA_BINS, "is_reconstructed")),
)
def a18_efficiency_by_eta(spark, sf_dir):
    binned = EV.binned_efficiency(reco_particles(spark, sf_dir), "eta_particle", ETA_BINS, F.col("is_reconstructed"))
    return _rounded_bins(binned)


LOG_BINS = EV.log_bins(1, 50, 10)


@query(
    "a18_construction_efficiency",
    with_tables("te", body=_binned_sql("te", "pt", LOG_BINS, "edge_id IS NOT NULL", "pdg_id NOT IN (11, -11)")),
)
def a18_construction_efficiency(spark, sf_dir):
    """Target track edges found by the graph, in logarithmic pt bins."""
    return _rounded_bins(
        EV.binned_efficiency(
            track_edges(spark, sf_dir), "pt", LOG_BINS, F.col("edge_id").isNotNull(), all_of({"pdg_id": ["not_in", [11, -11]]})
        )
    )


@query("a19_efficiency_with_interval")
def a19_efficiency_with_interval(spark, sf_dir):
    """Clopper-Pearson bars on the binned table; checked against known quantiles in the tests."""
    binned = EV.binned_efficiency(reco_particles(spark, sf_dir), "pt", PT_BINS, F.col("is_reconstructed"))
    return EV.add_interval(binned)


@query(
    "a19_interval_tails",
    with_tables(
        "reco_particles",
        body=_binned_sql("reco_particles", "pt", PT_BINS, "is_reconstructed").replace("\nSELECT i.bin", ",\nx AS (SELECT i.bin")
        + """)
SELECT bin, n_total, n_passed, CASE WHEN n_passed > 0 THEN 0.16 ELSE 0.0 END::DOUBLE AS lower_tail,
  CASE WHEN n_passed < n_total THEN 0.16 ELSE 0.0 END::DOUBLE AS upper_tail FROM x""",
    ),
)
def a19_interval_tails(spark, sf_dir):
    """At either end of the interval the counts seen, or more extreme ones, have a chance of 0.16; no tail where the end is 0 or 1."""
    binned = EV.add_interval(EV.binned_efficiency(reco_particles(spark, sf_dir), "pt", PT_BINS, F.col("is_reconstructed")))
    tails = {}
    for name, bound, upper, open_end in (
        ("lower_tail", F.col("efficiency") - F.col("err_low"), True, F.col("n_passed") > 0),
        ("upper_tail", F.col("efficiency") + F.col("err_high"), False, F.col("n_passed") < F.col("n_total")),
    ):
        tails[name] = F.when(open_end, rnd(EV.binomial_tail("n_passed", "n_total", bound, upper), 4)).otherwise(0.0)
    return binned.select("bin", "n_total", "n_passed", *[column.alias(name) for name, column in tails.items()])


INNER = """CASE WHEN a.r * a.r + a.z * a.z > b.r * b.r + b.z * b.z THEN b.{c} ELSE a.{c} END / 1000 AS {c}"""
cte("te_rz", f"""
SELECT t.*, {INNER.format(c='r')}, {INNER.format(c='z')} FROM te t
JOIN hit_features a ON a.event_id = t.event_id AND a.hit_id = t.src
JOIN hit_features b ON b.event_id = t.event_id AND b.hit_id = t.dst""", "te", "hit_features")
cte("edges_rz", f"""
SELECT t.*, {INNER.format(c='r')}, {INNER.format(c='z')} FROM ledges t
JOIN hit_features a ON a.event_id = t.event_id AND a.hit_id = t.src
JOIN hit_features b ON b.event_id = t.event_id AND b.hit_id = t.dst""", "ledges", "hit_features")
Z_GRID, R_GRID = (-3.0, 3.0, 24), (0.0, 2.0, 16)
GRID = """CASE WHEN z = 3 THEN 23 ELSE CAST(floor((z - -3.0) / {zw!r}::DOUBLE) AS BIGINT) END AS z_bin,
  CASE WHEN r = 2 THEN 15 ELSE CAST(floor((r - 0.0) / {rw!r}::DOUBLE) AS BIGINT) END AS r_bin""".format(zw=6 / 24, rw=2 / 16)


def _grid_sql(rows: str) -> str:
    """Ratio per grid cell of rows that carry the flags hit and total."""
    return f"""
, x AS ({rows})
SELECT zs.z_bin, rs.r_bin, COUNT(*) FILTER (hit) AS n_numerator, COUNT(*) FILTER (total) AS n_denominator,
  round(CASE WHEN COUNT(*) FILTER (total) > 0 THEN CAST(COUNT(*) FILTER (hit) AS DOUBLE) / COUNT(*) FILTER (total) END, 6)
    + 0.0 AS ratio
FROM (SELECT unnest(range({Z_GRID[2]})) AS z_bin) zs CROSS JOIN (SELECT unnest(range({R_GRID[2]})) AS r_bin) rs
LEFT JOIN (SELECT *, {GRID} FROM x WHERE z BETWEEN -3 AND 3 AND r BETWEEN 0 AND 2) g
  ON g.z_bin = zs.z_bin AND g.r_bin = rs.r_bin GROUP BY zs.z_bin, rs.r_bin"""


TARGET_SQL = "pt BETWEEN 1.0 AND 1e9"
FOUND_SQL = "edge_id IS NOT NULL AND score >= 0.5"
TARGET = {"pt": [1.0, INF]}

for _name, _cumulative, _total in (
    ("a20_efficiency_rz", False, "edge_id IS NOT NULL"),
    ("a20_cumulative_efficiency_rz", True, "TRUE"),
):

    @query(
        _name,
        with_tables(
            "te_rz",
            body=_grid_sql(f"SELECT z, r, {FOUND_SQL} AS hit, {_total} AS total FROM te_rz WHERE {TARGET_SQL}"),
        ),
    )
    def _a20(spark, sf_dir, cumulative=_cumulative):
        out = EV.efficiency_rz(
            track_edges(spark, sf_dir), hit_features(spark, sf_dir), 0.5, all_of(TARGET), Z_GRID, R_GRID, cumulative
        )
        return out.withColumn("ratio", rnd("ratio"))


for _kind, _found, _all, _positive in (
    ("total", FOUND_SQL, "FALSE", "score >= 0.5"),
    ("target", f"{FOUND_SQL} AND {TARGET_SQL}", "FALSE", "score >= 0.5"),
    ("masked", f"{FOUND_SQL} AND {TARGET_SQL}", "TRUE", "score >= 0.5 AND NOT y"),
):

    @query(
        f"a20_{_kind}_purity_rz",
        with_tables(
            "te_rz",
            "edges_rz",
            body=_grid_sql(
                f"SELECT z, r, TRUE AS hit, {_all} AS total FROM te_rz WHERE {_found}"
                f" UNION ALL SELECT z, r, FALSE, TRUE FROM edges_rz WHERE {_positive}"
            ),
        ),
    )
    def _a20_purity(spark, sf_dir, kind=_kind):
        edges, true = graph(spark, sf_dir)
        out = EV.purity_rz(edges, true, hit_features(spark, sf_dir), 0.5, all_of(TARGET), kind, Z_GRID, R_GRID)
        return out.withColumn("ratio", rnd("ratio"))


@query(
    "a20_purity_rz",
    with_tables(
        "ledges",
        "hit_features",
        body=_grid_sql(
            "SELECT h.z / 1000 AS z, h.r / 1000 AS r, score >= 0.5 AND l.y AS hit, score >= 0.5 AS total FROM ledges l"
            " JOIN hit_features h ON h.event_id = l.event_id AND h.hit_id = l.src"
        ),
    ),
)
def a20_purity_rz(spark, sf_dir):
    """Purity by the source hit as the edge was built, without turning it outward."""
    h = hit_features(spark, sf_dir).select(
        E, F.col("hit_id").alias("src"), (F.col("r") / 1000).alias("r"), (F.col("z") / 1000).alias("z")
    )
    positive = F.col("score") >= 0.5
    placed = graph(spark, sf_dir)[0].join(h, [E, "src"])
    out = EV.binned_ratio_2d(placed, positive & F.col("y"), positive, Z_GRID, R_GRID)
    return out.withColumn("ratio", rnd("ratio"))


@query(
    "a21_region_efficiency_purity",
    with_tables(
        "edges",
        "hit_features",
        body="""
, x AS (SELECT region, MIN(r) AS r_min, MAX(r) AS r_max, MIN(z) AS z_min, MAX(z) AS z_max FROM hit_features GROUP BY region)
SELECT h.region, COUNT(*) FILTER (e.y) AS n_true, COUNT(*) FILTER (score > 0.5) AS n_positive,
  COUNT(*) FILTER (e.y AND score > 0.5) AS n_true_positive,
  round(CAST(COUNT(*) FILTER (e.y AND score > 0.5) AS DOUBLE) / COUNT(*) FILTER (e.y), 6) + 0.0 AS efficiency,
  round(CAST(COUNT(*) FILTER (e.y AND score > 0.5) AS DOUBLE) / COUNT(*) FILTER (score > 0.5), 6) + 0.0 AS purity,
  round(MIN(r_min), 6) + 0.0 AS r_min, round(MIN(r_max), 6) + 0.0 AS r_max, round(MIN(z_min), 6) + 0.0 AS z_min,
  round(MIN(z_max), 6) + 0.0 AS z_max
FROM edges e JOIN hit_features h ON h.event_id = e.event_id AND h.hit_id = e.src JOIN x ON x.region = h.region
GROUP BY h.region HAVING COUNT(*) FILTER (e.y) > 0 AND COUNT(*) FILTER (score > 0.5) > 0""",
    ),
)
def a21_region_efficiency_purity(spark, sf_dir):
    out = EV.region_efficiency_purity(A.candidate_edges(spark, sf_dir), hit_features(spark, sf_dir), F.col("score") > 0.5)
    floats = ["efficiency", "purity", "r_min", "r_max", "z_min", "z_max"]
    return out.select(*[c for c in out.columns if c not in floats], *[rnd(c).alias(c) for c in floats])


# ---- ROC and score tables ------------------------------------------------------
cte("roc", """
SELECT -o AS threshold, pos, neg, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER () AS p, SUM(neg) OVER () AS n
FROM (SELECT -score AS o, COUNT(*) FILTER (y AND weight > 0) AS pos, COUNT(*) FILTER (NOT (y AND weight > 0)) AS neg
  FROM weighted GROUP BY score) WINDOW w AS (ORDER BY o ROWS UNBOUNDED PRECEDING)""", "weighted")


@query(
    "a22_w9_roc_curve",
    with_tables(
        "roc",
        body="""SELECT threshold, round(CAST(tp AS DOUBLE) / p, 6) + 0.0 AS tpr, round(CAST(fp AS DOUBLE) / n, 6) + 0.0 AS fpr
FROM roc""",
    ),
)
def a22_w9_roc_curve(spark, sf_dir):
    target = F.col("y") & (F.col("weight") > 0)
    curve = EV.roc_curve(weighted_edges(spark, sf_dir), target)
    return curve.select("threshold", rnd("tpr").alias("tpr"), rnd("fpr").alias("fpr"))


@query(
    "a22_auc",
    with_tables(
        "weighted",
        body="""
, g AS (SELECT FALSE AS masked, score, y AND weight > 0 AS t FROM weighted UNION ALL
  SELECT TRUE, score, y AND weight > 0 FROM weighted WHERE weight > 0),
s AS (SELECT masked, score, COUNT(*) FILTER (t) AS pos, COUNT(*) FILTER (NOT t) AS neg FROM g GROUP BY ALL),
c AS (SELECT *, SUM(pos) OVER (PARTITION BY masked ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM s)
SELECT masked, round(CAST(SUM(neg * (tp - pos / 2.0)) AS DOUBLE) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)), 6) + 0.0 AS auc
FROM c GROUP BY masked""",
    ),
)
def a22_auc(spark, sf_dir):
    """Full area (all edges) and masked area (positive weight)."""
    target = F.col("y") & (F.col("weight") > 0)
    edges = cut_lineage(weighted_edges(spark, sf_dir))
    full = EV.area_under_curve(EV.roc_curve(edges, target)).withColumn("masked", F.lit(False))
    part = EV.area_under_curve(EV.roc_curve(edges.where("weight > 0"), target)).withColumn("masked", F.lit(True))
    return full.unionByName(part).select("masked", rnd("auc").alias("auc"))


@query(
    "a22_label_auc",
    with_tables(
        "scored_labels",
        body="""
, s AS (SELECT score, COUNT(*) FILTER (y) AS pos, COUNT(*) FILTER (NOT y) AS neg FROM scored_labels GROUP BY ALL),
c AS (SELECT *, SUM(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM s)
SELECT round(CAST(SUM(neg * (tp - pos / 2.0)) AS DOUBLE) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)), 6) + 0.0 AS auc FROM c""",
    ),
)
def a22_label_auc(spark, sf_dir):
    """Area on another table: labelled documents with a score."""
    curve = EV.roc_curve(A.scored_labels(spark, sf_dir), F.col("y"))
    return EV.area_under_curve(curve).select(rnd("auc").alias("auc"))


@query(
    "a23_score_histogram",
    with_tables(
        "weighted",
        "hits",
        body="""
, s AS (SELECT MIN(score) AS lo, MAX(score) AS hi FROM weighted),
ev AS (SELECT COUNT(DISTINCT event_id) AS n_events FROM hits),
c AS (SELECT least(CAST(floor((score - lo) / ((hi - lo) / 100)) AS BIGINT), 99) AS bin,
  CASE WHEN weight <= 0 THEN 'Non-target True' WHEN y THEN 'Target True' ELSE 'Fake' END AS kind, COUNT(*) AS n
  FROM weighted, s GROUP BY 1, 2),
a AS (SELECT bin, kind FROM (SELECT unnest(range(100)) AS bin)
  CROSS JOIN (SELECT unnest(['Non-target True', 'Target True', 'Fake']) AS kind))
SELECT a.bin, a.kind, COALESCE(c.n, 0) AS n, round(CAST(COALESCE(c.n, 0) AS DOUBLE) / n_events, 6) + 0.0 AS n_per_event
FROM a CROSS JOIN ev LEFT JOIN c ON c.bin = a.bin AND c.kind = a.kind""",
    ),
)
def a23_score_histogram(spark, sf_dir):
    """All 100 bins of the three kinds, per event of the hit table."""
    out = EV.score_histogram(weighted_edges(spark, sf_dir), events=A.hits(spark, sf_dir))
    return out.withColumn("n_per_event", rnd("n_per_event"))


@query(
    "a24_graph_size",
    with_tables(
        "edges",
        "hits",
        body="""SELECT round(AVG(n), 6) + 0.0 AS mean_size, round(stddev_pop(n), 6) + 0.0 AS std_size FROM (
SELECT COUNT(e.event_id) AS n FROM (SELECT DISTINCT event_id FROM hits) h
LEFT JOIN (SELECT event_id FROM edges WHERE score > 0.58) e USING (event_id) GROUP BY h.event_id)""",
    ),
)
def a24_graph_size(spark, sf_dir):
    """Edges above a cut, over all events of the hit table, with or without such edges."""
    edges = A.candidate_edges(spark, sf_dir).where("score > 0.58")
    out = EV.graph_size(edges, A.hits(spark, sf_dir))
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query(
    "a24_scoring_summary",
    with_tables(
        "te",
        "hits",
        body="""
, t AS (SELECT COUNT(*) AS n_target, COUNT(edge_id) AS n_built, COUNT(*) FILTER (score >= 0.5) AS n_found FROM te
  WHERE pt BETWEEN 1.0 AND 1e9),
e AS (SELECT CAST(SUM(n) AS BIGINT) AS n_positive, AVG(n) AS mean_graph_size FROM (
  SELECT COUNT(*) FILTER (score >= 0.5) AS n FROM (SELECT DISTINCT event_id FROM hits) h LEFT JOIN edges USING (event_id)
  GROUP BY event_id))
SELECT n_target, n_built, n_found, n_positive, round(mean_graph_size, 6) + 0.0 AS mean_graph_size,
  round(CAST(n_found AS DOUBLE) / n_built, 6) + 0.0 AS target_efficiency,
  round(CAST(n_found AS DOUBLE) / n_positive, 6) + 0.0 AS target_purity,
  round(CAST(n_found AS DOUBLE) / n_target, 6) + 0.0 AS cumulative_efficiency,
  round(CAST(n_built AS DOUBLE) / n_target, 6) + 0.0 AS construction_efficiency
FROM t, e""",
    ),
)
def a24_scoring_summary(spark, sf_dir):
    out = EV.scoring_summary(
        track_edges(spark, sf_dir), A.candidate_edges(spark, sf_dir), 0.5, all_of({"pt": [1.0, INF]}),
        A.hits(spark, sf_dir),
    )
    counts = ["n_target", "n_built", "n_found", "n_positive"]
    return out.select(*counts, *[rnd(c).alias(c) for c in out.columns if c not in counts])


@query(
    "a25_classifier_metrics",
    with_tables(
        "weighted",
        body="""
, c AS (SELECT COUNT(*) FILTER (score > 0.5) AS n_positive, COUNT(*) FILTER (y AND weight > 0) AS n_target,
  COUNT(*) FILTER (y AND weight > 0 AND score > 0.5) AS n_target_positive,
  COUNT(*) FILTER (y AND score > 0.5) AS n_true_positive FROM weighted)
SELECT *, round(CAST(n_target_positive AS DOUBLE) / n_target, 6) + 0.0 AS eff,
  round(CAST(n_target_positive AS DOUBLE) / n_positive, 6) + 0.0 AS target_pur,
  round(CAST(n_true_positive AS DOUBLE) / n_positive, 6) + 0.0 AS total_pur,
  round(CAST(n_target_positive AS DOUBLE) / (n_positive - (n_true_positive - n_target_positive)), 6) + 0.0 AS pur
FROM c""",
    ),
)
def a25_classifier_metrics(spark, sf_dir):
    out = EV.classifier_metrics(weighted_edges(spark, sf_dir), 0.5)
    rates = ["eff", "target_pur", "total_pur", "pur"]
    return out.select(*[c for c in out.columns if c not in rates], *[rnd(c).alias(c) for c in rates])


@query(
    "a26_construction_metrics",
    with_tables(
        "weighted",
        "te",
        body="""
, c AS (SELECT COUNT(*) AS n_pred, COUNT(*) FILTER (y) AS n_true_pred, COUNT(*) FILTER (y AND weight > 0) AS n_signal_pred
  FROM weighted),
t AS (SELECT COUNT(*) AS n_true, COUNT(*) FILTER (COALESCE(pt BETWEEN 1 AND 1e9, FALSE)
  AND COALESCE(nhits BETWEEN 3 AND 1e9, FALSE)) AS n_signal FROM te),
r AS (SELECT *, CAST(n_true_pred AS DOUBLE) / n_true AS te_, CAST(n_signal_pred AS DOUBLE) / n_signal AS se,
  CAST(n_true_pred AS DOUBLE) / n_pred AS tp, CAST(n_signal_pred AS DOUBLE) / n_pred AS sp FROM c, t)
SELECT n_pred, n_true_pred, n_signal_pred, n_true, n_signal, round(te_, 6) + 0.0 AS total_eff, round(se, 6) + 0.0 AS signal_eff,
  round(tp, 6) + 0.0 AS total_pur, round(sp, 6) + 0.0 AS signal_pur, round(2 * se * sp / (se + sp), 6) + 0.0 AS f1 FROM r""",
    ),
)
def a26_construction_metrics(spark, sf_dir):
    from ..operators.weighting import signal_edges
    from .graph_tables import RULES

    true = plain_track_edges(spark, sf_dir)
    out = EV.construction_metrics(weighted_edges(spark, sf_dir), true, signal_edges(true, RULES))
    rates = ["total_eff", "signal_eff", "total_pur", "signal_pur", "f1"]
    return out.select(*[c for c in out.columns if c not in rates], *[rnd(c).alias(c) for c in rates])


LOSS_SQL = """
, o AS (SELECT *, score * 8 - 4 AS x, abs(weight) AS w, y AND weight > 0 AS pos, (NOT y AND weight <> 0) OR weight < 0 AS neg
  FROM weighted),
s AS (SELECT COUNT(*) FILTER (pos) AS n_pos, COUNT(*) FILTER (neg) AS n_neg,
  SUM((greatest(x, 0) - x + ln(1 + exp(-abs(x)))) * w) FILTER (pos) AS p,
  SUM((greatest(x, 0) + ln(1 + exp(-abs(x)))) * w) FILTER (neg) AS n FROM o)
SELECT n_pos, n_neg, round({loss}, 6) + 0.0 AS loss, round(p / (n_pos + n_neg), 6) + 0.0 AS pos_loss,
  round(n / (n_pos + n_neg), 6) + 0.0 AS neg_loss FROM s"""

for _balance, _loss in (("proportional", "(p + n) / (n_pos + n_neg)"), ("equal", "p / n_pos + n / n_neg")):

    @query(f"a27_log_loss_{_balance}", with_tables("weighted", body=LOSS_SQL.format(loss=_loss)))
    def _a27(spark, sf_dir, balance=_balance):
        edges = weighted_edges(spark, sf_dir).withColumn("output", F.col("score") * 8 - 4)
        out = EV.weighted_log_loss(edges, balance=balance)
        return out.select("n_pos", "n_neg", *[rnd(c).alias(c) for c in ("loss", "pos_loss", "neg_loss")])


@query(
    "a28_hinge_loss",
    with_tables(
        "weighted",
        "hits",
        body="""
, d AS (SELECT w.y, w.weight, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 100000 AS d FROM weighted w
  JOIN hits a ON a.event_id = w.event_id AND a.hit_id = w.src JOIN hits b ON b.event_id = w.event_id AND b.hit_id = w.dst),
s AS (SELECT AVG(d * abs(weight)) FILTER (y AND weight > 0) AS pos_loss,
  AVG(greatest(0.0, 0.6 * 0.6 - d) * abs(weight)) FILTER ((NOT y AND weight <> 0) OR weight < 0) AS neg_loss FROM d)
SELECT round(pos_loss, 6) + 0.0 AS pos_loss, round(neg_loss, 6) + 0.0 AS neg_loss,
  round(pos_loss + neg_loss, 6) + 0.0 AS loss FROM s""",
    ),
)
def a28_hinge_loss(spark, sf_dir):
    h = A.hits(spark, sf_dir).selectExpr("event_id", "hit_id", "x as px", "y as py")
    both = gather(weighted_edges(spark, sf_dir), h, ["px", "py"])
    dx, dy = F.col("px_src") - F.col("px_dst"), F.col("py_src") - F.col("py_dst")
    out = EV.weighted_hinge_loss(both.withColumn("distance", (dx * dx + dy * dy) / 100000), 0.6)
    return out.select(*[rnd(c).alias(c) for c in ("pos_loss", "neg_loss", "loss")])


CUTS = [0.3, 0.5, 0.7, 0.9]


@query(
    "a29_efficiency_by_cut",
    with_tables(
        "te",
        body="""
, c AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS score_cut),
b AS (SELECT CAST(CAST(pt >= 1.0 AS INTEGER) + CAST(pt >= 2.0 AS INTEGER) + CAST(pt >= 3.0 AS INTEGER)
  + CAST(pt >= 4.0 AS INTEGER) AS BIGINT) AS bin, score FROM te WHERE edge_id IS NOT NULL AND pt BETWEEN 0.5 AND 4.9)
SELECT i.bin, score_cut, COUNT(b.bin) AS n_total, COUNT(*) FILTER (score >= score_cut) AS n_passed,
  round(CASE WHEN COUNT(b.bin) > 0 THEN CAST(COUNT(*) FILTER (score >= score_cut) AS DOUBLE) / COUNT(b.bin) END, 6) + 0.0
  AS efficiency
FROM (SELECT unnest(range(5)) AS bin) i CROSS JOIN c LEFT JOIN b ON b.bin = i.bin GROUP BY i.bin, score_cut""",
    ),
)
def a29_efficiency_by_cut(spark, sf_dir):
    """Four score cuts in one pass."""
    out = EV.efficiency_by_cut(track_edges(spark, sf_dir), "pt", PT_BINS, CUTS)
    return out.withColumn("efficiency", rnd("efficiency"))


@query(
    "w8_successive_pairs",
    with_tables(
        "hits",
        body="""SELECT * FROM (SELECT event_id, particle_id, hit_id AS src,
LEAD(hit_id) OVER (PARTITION BY event_id, particle_id, layer ORDER BY hit_id) AS dst FROM hits WHERE particle_id <> 0)
WHERE dst IS NOT NULL""",
    ),
)
def w8_successive_pairs(spark, sf_dir):
    """Pairwise of the ordered hits of one track in one layer."""
    h = A.hits(spark, sf_dir).where("particle_id <> 0")
    pairs = successive_pairs(h, [E, "particle_id", "layer"], "hit_id")
    return pairs.select(E, "particle_id", F.col("first").alias("src"), F.col("second").alias("dst"))
