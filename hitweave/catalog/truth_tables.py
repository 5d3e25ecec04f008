"""Queries from clusters and particles to truth hits and truth-track edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import detector as D
from ..operators import truth as T
from ..operators import truth_edges as W
from ..operators.joins import E
from ..operators.ranking import dense_index
from ..session import cut_lineage
from ..plans.simulation import build_simulation
from ..sources import adapters as A
from ..sources import text_dumps
from ..sources.simulation import SimulationTables
from .registry import query, rnd
from .sqltables import cte, with_tables

cte("p_ids", """
SELECT p.*, CAST(subevent || lpad(CAST(barcode AS VARCHAR), w, '0') AS BIGINT) AS particle_id
FROM raw_particles p JOIN (SELECT event_id, CAST(length(CAST(MAX(barcode) AS VARCHAR)) AS INTEGER) AS w FROM raw_particles
GROUP BY event_id) USING (event_id)""", "raw_particles")
cte("clusters", """
SELECT c.event_id, c.cluster_id - 1 AS cluster_id, c.hardware, c.barrel_endcap, c.layer_disk, c.eta_module, c.phi_module,
       COALESCE(p.particle_id, 0) AS particle_id
FROM raw_clusters c JOIN cluster_links l USING (event_id, cluster_id)
LEFT JOIN p_ids p ON p.event_id = l.event_id AND p.subevent = l.subevent AND p.barcode = l.barcode
""", "raw_clusters", "cluster_links", "p_ids")
cte("spacepoints", "SELECT event_id, hit_id, x, y, z, cluster_index_1,"
    " COALESCE(cluster_index_2, cluster_index_1) AS cluster_index_2 FROM raw_spacepoints", "raw_spacepoints")
cte("matched", """
SELECT s.*, a.hardware, a.barrel_endcap, a.layer_disk, a.eta_module, a.phi_module,
       a.particle_id AS particle_id_1, b.particle_id AS particle_id_2,
       CASE WHEN a.particle_id = b.particle_id THEN a.particle_id ELSE 0 END AS particle_id
FROM spacepoints s
LEFT JOIN clusters a ON a.event_id = s.event_id AND a.cluster_id = s.cluster_index_1
LEFT JOIN clusters b ON b.event_id = s.event_id AND b.cluster_id = s.cluster_index_2""", "spacepoints", "clusters")
cte("unique_points", """
SELECT DISTINCT event_id, hit_id, x, y, z, cluster_index_1, COALESCE(cluster_index_2, -1) AS cluster_index_2,
       particle_id, hardware, barrel_endcap, layer_disk, eta_module, phi_module
FROM matched""", "matched")
cte("truth", """
SELECT * FROM unique_points WHERE particle_id <> 0
UNION ALL
SELECT u.* FROM unique_points u WHERE particle_id = 0 AND NOT EXISTS (
  SELECT 1 FROM unique_points s WHERE s.event_id = u.event_id AND s.hit_id = u.hit_id AND s.particle_id <> 0)
""", "unique_points")
cte("detectable", """
SELECT p.*, n.num_clusters FROM p_ids p JOIN (
  SELECT event_id, particle_id, COUNT(cluster_id) AS num_clusters FROM clusters GROUP BY ALL) n
USING (event_id, particle_id) WHERE abs(charge) > 0 AND num_clusters > 0""", "p_ids", "clusters")
POINT = ["event_id", "hit_id", "x", "y", "z", "cluster_index_1", "cluster_index_2", "particle_id", "hardware",
         "barrel_endcap", "layer_disk", "eta_module", "phi_module"]


def numbered_particles(spark, sf_dir):
    return T.particle_ids(A.raw_particles(spark, sf_dir))


def clusters(spark, sf_dir):
    """Stage table: both clusters of a spacepoint, and the particle counts, read it."""
    raw = A.raw_clusters(spark, sf_dir)
    return cut_lineage(T.expand_clusters(raw, T.split_links(raw), numbered_particles(spark, sf_dir)))


def spacepoints(spark, sf_dir):
    return A.raw_spacepoints(spark, sf_dir).withColumn(
        "cluster_index_2", F.coalesce("cluster_index_2", "cluster_index_1")
    )


def truth_points(spark, sf_dir):
    return T.clean_spacepoints(T.match_spacepoints(spacepoints(spark, sf_dir), clusters(spark, sf_dir)))


REGIONS = {
    1: {"hardware": ["PIXEL", "STRIP"]},
    2: {"hardware": "STRIP", "barrel_endcap": -1},
    3: {"hardware": "PIXEL", "barrel_endcap": 0},
    4: {"hardware": "STRIP", "barrel_endcap": [0, 1], "layer_disk": [0, 1, 2]},
    5: {"hardware": "PIXEL", "barrel_endcap": 1},
}
REGION_SQL = """CAST(CASE WHEN hardware = 'PIXEL' AND barrel_endcap = 1 THEN 5
     WHEN hardware = 'STRIP' AND barrel_endcap IN (0, 1) AND layer_disk IN (0, 1, 2) THEN 4
     WHEN hardware = 'PIXEL' AND barrel_endcap = 0 THEN 3
     WHEN hardware = 'STRIP' AND barrel_endcap = -1 THEN 2 ELSE 1 END AS BIGINT)"""


@query(
    "p1_particle_id",
    with_tables("p_ids", body="SELECT event_id, subevent, barcode, particle_id FROM p_ids"),
)
def p1_particle_id(spark, sf_dir):
    return numbered_particles(spark, sf_dir).select(E, "subevent", "barcode", "particle_id")


@query(
    "j1_cluster_particles",
    with_tables("clusters", body="SELECT event_id, cluster_id, hardware, particle_id FROM clusters"),
)
def j1_cluster_particles(spark, sf_dir):
    """P12 too: the 1-based ids of the dump are shifted."""
    return clusters(spark, sf_dir).select(E, "cluster_id", "hardware", "particle_id")


@query(
    "j1_nested_cluster_particles",
    with_tables("clusters", body="SELECT event_id, cluster_id, hardware, particle_id FROM clusters"),
)
def j1_nested_cluster_particles(spark, sf_dir):
    """The same expansion from two parallel link arrays, as the nested format has them."""
    from ..sources.nested import link_arrays

    raw = A.raw_clusters(spark, sf_dir)
    pairs = F.expr("filter(split(links, '\\\\),\\\\('), p -> p <> '')")
    part = lambda i: F.transform(pairs, lambda p: F.get(F.split(F.translate(p, "()", ""), ","), F.lit(i)).cast("bigint"))
    arrays = raw.select("*", part(0).alias("subevent"), part(1).alias("barcode"))
    out = T.expand_clusters(arrays, link_arrays(arrays), numbered_particles(spark, sf_dir))
    return out.select(E, "cluster_id", "hardware", "particle_id")


@query(
    "j2_spacepoint_truth",
    with_tables(
        "matched",
        body="SELECT event_id, hit_id, cluster_index_1, cluster_index_2, hardware, particle_id_1, particle_id_2,"
        " particle_id FROM matched",
    ),
)
def j2_spacepoint_truth(spark, sf_dir):
    matched = T.match_spacepoints(spacepoints(spark, sf_dir), clusters(spark, sf_dir))
    return matched.select(
        E, "hit_id", "cluster_index_1", "cluster_index_2", "hardware", "particle_id_1", "particle_id_2", "particle_id"
    )


@query(
    "j2b_cluster_truth",
    with_tables(
        "clusters",
        "module_lookup",
        body=f"""
, d AS (SELECT DISTINCT * FROM clusters),
t AS (SELECT * FROM d WHERE particle_id <> 0 UNION ALL
      SELECT d.* FROM d WHERE particle_id = 0 AND NOT EXISTS (SELECT 1 FROM d s WHERE s.event_id = d.event_id
        AND s.cluster_id = d.cluster_id AND s.particle_id <> 0))
SELECT t.event_id, t.cluster_id AS hit_id, t.particle_id, {REGION_SQL} AS region, m.module_id
FROM t LEFT JOIN module_lookup m USING (hardware, barrel_endcap, layer_disk, eta_module, phi_module)""",
    ),
)
def j2b_cluster_truth(spark, sf_dir):
    """Clusters as hits: J1, D2, P8 and J5 in a row."""
    hits = T.cluster_truth(clusters(spark, sf_dir)).withColumn("region", T.region_label(REGIONS))
    lookup = text_dumps.clean_module_lookup(A.module_lookup(spark, sf_dir))
    return T.add_module_id(hits, lookup).select(E, "hit_id", "particle_id", "region", "module_id")


@query(
    "f4_j3_detectable_particles",
    with_tables("detectable", body="SELECT event_id, particle_id, charge, num_clusters FROM detectable"),
)
def f4_j3_detectable_particles(spark, sf_dir):
    """A1 too: clusters per particle."""
    found = T.detectable_particles(numbered_particles(spark, sf_dir), clusters(spark, sf_dir))
    return found.select(E, "particle_id", "charge", "num_clusters")


@query("d1_d2_clean_spacepoints", with_tables("truth", body=f"SELECT {', '.join(POINT)} FROM truth"))
def d1_d2_clean_spacepoints(spark, sf_dir):
    """J19 too: the noise anti-join."""
    return truth_points(spark, sf_dir).select(*POINT)


@query(
    "j4_mask_undetectable",
    with_tables(
        "truth",
        "detectable",
        body="""
SELECT t.event_id, t.hit_id, CASE WHEN d.particle_id IS NULL THEN 0 ELSE t.particle_id END AS particle_id
FROM truth t LEFT JOIN (SELECT DISTINCT event_id, particle_id FROM detectable) d
ON d.event_id = t.event_id AND d.particle_id = t.particle_id""",
    ),
)
def j4_mask_undetectable(spark, sf_dir):
    found = T.detectable_particles(numbered_particles(spark, sf_dir), clusters(spark, sf_dir))
    return T.mask_undetectable(truth_points(spark, sf_dir), found).select(E, "hit_id", "particle_id")


@query(
    "p8_region_labels",
    with_tables(
        "raw_clusters",
        body=f"SELECT event_id, {REGION_SQL} AS region, COUNT(*) AS n FROM raw_clusters GROUP BY ALL",
    ),
)
def p8_region_labels(spark, sf_dir):
    labelled = A.raw_clusters(spark, sf_dir).withColumn("region", T.region_label(REGIONS))
    return labelled.groupBy(E, "region").agg(F.count("*").alias("n"))


@query(
    "j5_module_lookup",
    with_tables(
        "raw_clusters",
        "module_lookup",
        body="""SELECT event_id, cluster_id, module_id FROM raw_clusters
LEFT JOIN module_lookup USING (hardware, barrel_endcap, layer_disk, eta_module, phi_module)""",
    ),
)
def j5_module_lookup(spark, sf_dir):
    lookup = text_dumps.clean_module_lookup(A.module_lookup(spark, sf_dir))
    return T.add_module_id(A.raw_clusters(spark, sf_dir), lookup).select(E, "cluster_id", "module_id")


@query(
    "j6_hits_with_particles",
    with_tables(
        "hit_truth",
        body="""SELECT event_id, hit_id, particle_id, pt, pdg_id, is_primary, nhits, round(big_r, 6) + 0.0 AS big_r
FROM hit_truth""",
    ),
)
def j6_hits_with_particles(spark, sf_dir):
    """A2, P5 and P6 too: hits per particle, distance from production, primary flag."""
    return truth_hits(spark, sf_dir).select(
        E, "hit_id", "particle_id", "pt", "pdg_id", "is_primary", "nhits", rnd("big_r").alias("big_r")
    )


def truth_hits(spark, sf_dir):
    joined = T.add_particles(
        A.hits(spark, sf_dir), A.particles(spark, sf_dir), ["pt", "charge", "pdg_id", "is_primary", "eta_particle"]
    )
    # Read three times by the edge builder: a stage table.
    return cut_lineage(T.add_production_distance(joined))


EDGE_FEATURES = ["pt", "nhits", "is_primary", "pdg_id", "eta_particle", "module_id"]


def truth_edges(spark, sf_dir):
    return W.build_truth_edges(truth_hits(spark, sf_dir), ["module_id"], EDGE_FEATURES)


@query(
    "w1_truth_edges",
    with_tables("track_edges", body="SELECT event_id, src, dst, particle_id, pt, nhits, is_primary FROM track_edges"),
)
def w1_truth_edges(spark, sf_dir):
    """W3 and T2 too: edges of consecutive modules with the particle features of the source."""
    return truth_edges(spark, sf_dir).select(E, "src", "dst", "particle_id", "pt", "nhits", "is_primary")


@query(
    "w1_event_summary",
    with_tables(
        "track_edges",
        body="""
SELECT event_id, COUNT(*) AS n_edges, COUNT(DISTINCT particle_id) AS n_particles,
       SUM(CASE WHEN pt > 1.0 THEN 1 ELSE 0 END)::BIGINT AS n_edges_above_1gev,
       round(AVG(src_r), 6) + 0.0 AS mean_src_r
FROM track_edges GROUP BY event_id""",
    ),
)
def w1_event_summary(spark, sf_dir):
    """Flagship: truth-track edges of every event, summarised."""
    return (
        truth_edges(spark, sf_dir)
        .groupBy(E)
        .agg(
            F.count("*").alias("n_edges"),
            F.count_distinct("particle_id").alias("n_particles"),
            F.count_if(F.col("pt") > 1.0).alias("n_edges_above_1gev"),
            rnd(F.avg("src_r")).alias("mean_src_r"),
        )
    )


@query(
    "w2_redundant_split_edges",
    with_tables(
        "track_edges",
        body="""SELECT event_id, src, dst, particle_id, ROW_NUMBER() OVER (
PARTITION BY event_id, particle_id, dst_module ORDER BY src_r, dst_r, src, dst) > 1 AS redundant_split_edges
FROM track_edges""",
    ),
)
def w2_redundant_split_edges(spark, sf_dir):
    """J10 too."""
    marked = W.mark_redundant(truth_edges(spark, sf_dir))
    return marked.select(E, "src", "dst", "particle_id", "redundant_split_edges")


@query(
    "w4_dense_remap",
    with_tables(
        "truth",
        body="""
SELECT event_id, hit_id, DENSE_RANK() OVER (PARTITION BY event_id ORDER BY hit_id) - 1 AS node_id, COUNT(*) AS n_rows
FROM truth WHERE particle_id <> 0 GROUP BY event_id, hit_id""",
    ),
)
def w4_dense_remap(spark, sf_dir):
    """Dense node numbers of the hits left when noise is dropped; T1's order by id is in them."""
    signal = truth_points(spark, sf_dir).where("particle_id <> 0")
    counted = signal.groupBy(E, "hit_id").agg(F.count("*").alias("n_rows"))
    return dense_index(counted, [E], "hit_id", "node_id").select(E, "hit_id", "node_id", "n_rows")


@query(
    "d4_unique_edges",
    with_tables(
        "hits",
        body="""
SELECT a.event_id, a.hit_id AS src, b.hit_id AS dst, MIN(a.particle_id) AS particle_id
FROM hits a JOIN hits b ON a.event_id = b.event_id AND a.particle_id = b.particle_id AND b.layer = a.layer + 1
WHERE a.particle_id <> 0 GROUP BY ALL""",
    ),
)
def d4_unique_edges(spark, sf_dir):
    """Layer-to-layer edges of a particle, given twice, made unique."""
    h = A.hits(spark, sf_dir).where("particle_id <> 0").select(E, "hit_id", "particle_id", "layer")
    dst = h.select(E, F.col("hit_id").alias("dst"), "particle_id", (F.col("layer") - 1).alias("layer"))
    edges = h.withColumnRenamed("hit_id", "src").join(dst, [E, "particle_id", "layer"])
    twice = edges.unionByName(edges.withColumn("particle_id", F.col("particle_id") + 1000))
    return W.unique_edges(twice.select(E, "src", "dst", "particle_id"))


# ---- cylindrical features -----------------------------------------------------
@query(
    "p2_p3_hit_features",
    with_tables(
        "hit_features",
        body="""SELECT event_id, hit_id, round(r, 6) + 0.0 AS r, round(phi, 6) + 0.0 AS phi, round(eta, 6) + 0.0 AS eta
FROM hit_features""",
    ),
)
def p2_p3_hit_features(spark, sf_dir):
    return cylindrical_hits(spark, sf_dir).select(E, "hit_id", rnd("r").alias("r"), rnd("phi").alias("phi"), rnd("eta").alias("eta"))


def hit_features(spark, sf_dir):
    """Stage table of hits with cylindrical features, the input of graph construction."""
    return cut_lineage(cylindrical_hits(spark, sf_dir))


def cylindrical_hits(spark, sf_dir):
    h = A.hits(spark, sf_dir).withColumns({"r": G.radius("x", "y"), "phi": G.azimuth("x", "y")})
    return h.withColumn("eta", G.pseudorapidity("r", "z"))


@query(
    "p4_cluster_features",
    with_tables(
        "hit_features",
        body="""
, c AS (SELECT *, x * 1.5 + 2 AS cx, y * 1.5 - 3 AS cy, z + 1 AS cz FROM hit_features),
d AS (SELECT *, region IN (1, 3, 5) AS px, CASE WHEN region IN (1, 3, 5) THEN r ELSE sqrt(cx * cx + cy * cy) END AS cr
      FROM c)
SELECT event_id, hit_id, round(cr, 6) + 0.0 AS cluster_r,
       round(CASE WHEN px THEN phi ELSE atan2(cy, cx) END, 6) + 0.0 AS cluster_phi,
       round(CASE WHEN px THEN eta ELSE -ln(tan(atan2(cr, cz) * 0.5)) END, 6) + 0.0 AS cluster_eta
FROM d""",
    ),
)
def p4_cluster_features(spark, sf_dir):
    """Strip hits take the cluster's cylindrical features, pixel regions the hit's own."""
    c = cylindrical_hits(spark, sf_dir).selectExpr("*", "x * 1.5 + 2 as cx", "y * 1.5 - 3 as cy", "z + 1 as cz")
    out = G.cluster_features(c, ["cx", "cy", "cz"], F.col("region").isin(1, 3, 5), "cluster_")
    return out.select(E, "hit_id", *[rnd(f"cluster_{f}").alias(f"cluster_{f}") for f in ("r", "phi", "eta")])


# ---- detector and cells -------------------------------------------------------
cte("cell_hits", """
SELECT event_id, hit_id, COUNT(value) AS cell_count, SUM(value) AS cell_val, MAX(ch0) - MIN(ch0) + 1 AS nu,
       MAX(ch1) - MIN(ch1) + 1 AS nv FROM cells GROUP BY event_id, hit_id""", "cells")


def decoded_hits(spark, sf_dir):
    geometry = A.detector(spark, sf_dir).select("geometry_id", *D.MODULE_KEY)
    return A.measurements(spark, sf_dir).withColumnRenamed("measurement_id", "hit_id").join(geometry, "geometry_id")


@query(
    "a4_cell_statistics",
    with_tables(
        "cell_hits",
        body="SELECT event_id, hit_id, CAST(cell_count AS DOUBLE) AS cell_count, CAST(CAST(cell_val AS FLOAT) AS DOUBLE)"
        " AS cell_val FROM cell_hits",
    ),
)
def a4_cell_statistics(spark, sf_dir):
    stats = D.cell_statistics(A.cells(spark, sf_dir))
    return stats.select(E, "hit_id", F.col("cell_count").cast("double"), F.col("cell_val").cast("double"))


@query("a5_cell_extents", with_tables("cell_hits", body="SELECT event_id, hit_id, nu AS n_u, nv AS n_v FROM cell_hits"))
def a5_cell_extents(spark, sf_dir):
    return D.cell_extents(A.cells(spark, sf_dir))


@query(
    "a6_extreme_cells",
    with_tables(
        "cells",
        body="""SELECT event_id, hit_id, ch0, ch1, value,
ch0 = MIN(ch0) OVER (PARTITION BY event_id, hit_id) AS is_min, ch0 = MAX(ch0) OVER (PARTITION BY event_id, hit_id) AS is_max
FROM cells""",
    ),
)
def a6_extreme_cells(spark, sf_dir):
    return D.mark_extreme_cells(A.cells(spark, sf_dir)).select(E, "hit_id", "ch0", "ch1", "value", "is_min", "is_max")


@query(
    "a7_p9_cell_directions",
    with_tables(
        "cell_hits",
        "measurements",
        "detector",
        body="""
, l AS (
SELECT m.event_id, m.measurement_id AS hit_id, c.cell_count, d.*, c.nu * pitch_u AS lx, c.nv * pitch_v AS ly,
       module_t * 2.0 AS lz
FROM measurements m JOIN detector d USING (geometry_id)
JOIN cell_hits c ON c.event_id = m.event_id AND c.hit_id = m.measurement_id),
g AS (SELECT *, rot_xu * lx + rot_xv * ly + rot_xw * lz AS gx, rot_yu * lx + rot_yv * ly + rot_yw * lz AS gy,
       rot_zu * lx + rot_zv * ly + rot_zw * lz AS gz FROM l)
SELECT event_id, hit_id, CAST(cell_count AS DOUBLE) AS cell_count, round(lx, 6) + 0.0 AS lx, round(ly, 6) + 0.0 AS ly,
       round(lz, 6) + 0.0 AS lz,
       round(-ln(tan(acos(lz / sqrt(lx * lx + ly * ly + lz * lz)) * 0.5)), 4) + 0.0 AS leta,
       round(atan2(ly, lx), 4) + 0.0 AS lphi,
       round(-ln(tan(acos(gz / sqrt(gx * gx + gy * gy + gz * gz)) * 0.5)), 4) + 0.0 AS geta,
       round(atan2(gy, gx), 4) + 0.0 AS gphi
FROM g""",
    ),
)
def a7_p9_cell_directions(spark, sf_dir):
    """A4, A5, P9 and S10 together: cell counts, extents, rotation, spherical angles."""
    out = D.add_cell_directions(decoded_hits(spark, sf_dir), A.cells(spark, sf_dir), A.detector(spark, sf_dir))
    return out.select(
        E,
        "hit_id",
        F.col("cell_count").cast("double"),
        *[rnd(c).alias(c) for c in ("lx", "ly", "lz")],
        *[rnd(c, 4).alias(c) for c in ("leta", "lphi", "geta", "gphi")],
    )


@query(
    "j8_p10_measurements_to_hits",
    with_tables(
        "measurements",
        "detector",
        body="""
SELECT m.event_id, m.measurement_id, h.hit_id, h.hit_id % 50 AS particle_id, volume_id, layer_id, module_id,
       round(cx + (rot_xu * local0 + rot_xv * local1 + rot_xw * 0.0), 6) + 0.0 AS x,
       round(cy + (rot_yu * local0 + rot_yv * local1 + rot_yw * 0.0), 6) + 0.0 AS y,
       round(cz + (rot_zu * local0 + rot_zv * local1 + rot_zw * 0.0), 6) + 0.0 AS z
FROM measurements m JOIN detector USING (geometry_id)
LEFT JOIN (SELECT l_orderkey // 250 AS event_id, l_orderkey % 250 AS measurement_id, MAX(l_partkey) AS hit_id
           FROM lineitem GROUP BY ALL) h USING (event_id, measurement_id)""",
    ),
)
def j8_p10_measurements_to_hits(spark, sf_dir):
    """Module decode, global position and the measurement -> hit -> particle map (last entry wins)."""
    pairs = A.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey div 250 as event_id", "l_orderkey % 250 as measurement_id", "l_partkey as hit_id"
    )
    truth = pairs.select(E, "hit_id").distinct().withColumn("particle_id", F.col("hit_id") % 50)
    out = D.measurements_to_hits(A.measurements(spark, sf_dir), A.detector(spark, sf_dir), pairs, truth)
    return out.select(
        E, "measurement_id", "hit_id", "particle_id", *D.MODULE_KEY, *[rnd(c).alias(c) for c in "xyz"]
    )


@query(
    "p11_true_hits",
    with_tables(
        "measurements",
        "detector",
        body="""
SELECT event_id, local0 AS x, local1 AS y, 0.0::DOUBLE AS z, 1.0::DOUBLE AS t, volume_id, layer_id, module_id,
       ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY measurement_id) - 1 AS hit_id,
       ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY measurement_id) - 1 AS measurement_id
FROM measurements JOIN detector USING (geometry_id)""",
    ),
)
def p11_true_hits(spark, sf_dir):
    sim = A.measurements(spark, sf_dir).selectExpr(
        "event_id", "geometry_id", "measurement_id as index", "local0 as tx", "local1 as ty",
        "cast(0 as double) as tz", "cast(1 as double) as tt",
    )
    return D.true_hits(sim, A.detector(spark, sf_dir)).select(
        E, "x", "y", "z", "t", *D.MODULE_KEY, "hit_id", "measurement_id"
    )


@query(
    "j7_truth_with_hits",
    with_tables(
        "measurements",
        "detector",
        body="""
SELECT t.event_id, t.hit_id - 1 AS hit_id, t.c % 61 AS particle_id, m.local0, d.geometry_id AS module_index
FROM (SELECT o_orderkey // 250 AS event_id, o_orderkey % 250 + 1 AS hit_id, o_custkey AS c FROM orders) t
LEFT JOIN measurements m ON m.event_id = t.event_id AND m.measurement_id = t.hit_id
LEFT JOIN detector d ON d.geometry_id = m.geometry_id""",
    ),
)
def j7_truth_with_hits(spark, sf_dir):
    """Truth, hits and module index by left joins; 1-based hit ids shifted."""
    truth = A.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 250 as event_id", "o_orderkey % 250 + 1 as hit_id", "o_custkey % 61 as particle_id"
    )
    modules = A.detector(spark, sf_dir).select(*D.MODULE_KEY, F.col("geometry_id").alias("module_index"))
    hits = decoded_hits(spark, sf_dir).drop("geometry_id")
    return D.truth_with_hits(truth, hits, modules).select(E, "hit_id", "particle_id", "local0", "module_index")


@query(
    "j9_restrict_to_cells",
    with_tables(
        "measurements",
        "cells",
        body="""SELECT event_id, measurement_id, local0 FROM measurements m WHERE EXISTS (
SELECT 1 FROM cells c WHERE c.event_id = m.event_id AND c.hit_id = m.measurement_id)""",
    ),
)
def j9_restrict_to_cells(spark, sf_dir):
    kept = D.restrict_to_cells(A.measurements(spark, sf_dir), A.cells(spark, sf_dir))
    return kept.select(E, "measurement_id", "local0")


@query(
    "j9_strict_restriction",
    with_tables(
        "measurements",
        "cells",
        body="""SELECT event_id, measurement_id, local0 FROM measurements m WHERE EXISTS (
SELECT 1 FROM cells c WHERE c.event_id = m.event_id AND c.hit_id = m.measurement_id)""",
    ),
)
def j9_strict_restriction(spark, sf_dir):
    """Only cells of measurements in the event, which the strict form demands."""
    measurements = A.measurements(spark, sf_dir)
    known = measurements.select(E, F.col("measurement_id").alias("hit_id"))
    cells = A.cells(spark, sf_dir).join(known, [E, "hit_id"], "left_semi")
    return D.restrict_to_cells(measurements, cells, strict=True).select(E, "measurement_id", "local0")


@query(
    "p7_a3_particle_kinematics",
    with_tables(
        "p_ids",
        "truth",
        body="""
SELECT p.event_id, p.particle_id, round(sqrt(vx * vx + vy * vy), 6) + 0.0 AS radius,
       round(sqrt(px * px + py * py), 6) + 0.0 AS pt,
       round(CASE WHEN px = 0 AND py = 0 THEN NULL ELSE atanh(pz / sqrt(px * px + py * py + pz * pz)) END, 6) + 0.0
         AS particle_eta,
       COALESCE(n.nhits, 0) AS nhits
FROM p_ids p LEFT JOIN (SELECT event_id, particle_id, COUNT(*) AS nhits FROM truth GROUP BY ALL) n
USING (event_id, particle_id)""",
    ),
)
def p7_a3_particle_kinematics(spark, sf_dir):
    """Radius, pt, eta and hits per particle (0 when none); eta along the beam axis is left null."""
    out = D.particle_kinematics(numbered_particles(spark, sf_dir), truth_points(spark, sf_dir))
    eta = F.when(F.col("pt") > 0, rnd("particle_eta"))
    return out.select(
        E, "particle_id", rnd("radius").alias("radius"), rnd("pt").alias("pt"), eta.alias("particle_eta"), "nhits"
    )


# ---- the simulation reader as a chain ------------------------------------------
VOLUMES = {1: {"volume_id": 0}, 2: {"volume_id": [1, 2]}, 3: {"volume_id": 3}}
REGION_OF_VOLUME = "CAST(CASE WHEN volume_id = 0 THEN 1 WHEN volume_id IN (1, 2) THEN 2 WHEN volume_id = 3 THEN 3 END AS BIGINT)"
cte("simulated", """
SELECT event_id, geometry_id, (geometry_id % 2) * 61 + geometry_id % 61 AS particle_id, local0 AS tx, local1 AS ty,
       local0 + local1 AS tz, local0 * local1 AS tt, measurement_id,
       ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY measurement_id) - 1 AS hit_id
FROM measurements""", "measurements")
cte("measured_hits", """
SELECT s.event_id, s.measurement_id, s.hit_id, s.particle_id, d.*, {region} AS region,
       cx + (rot_xu * m.local0 + rot_xv * m.local1) AS x, cy + (rot_yu * m.local0 + rot_yv * m.local1) AS y,
       cz + (rot_zu * m.local0 + rot_zv * m.local1) AS z, c.cell_count, c.nu * pitch_u AS lx, c.nv * pitch_v AS ly
FROM simulated s JOIN measurements m USING (event_id, measurement_id) JOIN detector d ON d.geometry_id = s.geometry_id
JOIN cell_hits c ON c.event_id = s.event_id AND c.hit_id = s.measurement_id""".format(region=REGION_OF_VOLUME),
    "simulated", "detector", "cell_hits")


def simulation_tables(spark, sf_dir, with_cells):
    measurements = A.measurements(spark, sf_dir)
    hits = measurements.selectExpr(
        "event_id", "geometry_id", "(geometry_id % 2) * 61 + geometry_id % 61 as particle_id", "local0 as tx", "local1 as ty",
        "local0 + local1 as tz", "local0 * local1 as tt", "measurement_id as index",
    )
    place = dense_index(measurements.select(E, "measurement_id"), [E], "measurement_id", "hit_id")
    particles = A.raw_particles(spark, sf_dir).withColumn("particle_id", F.col("subevent") * 61 + F.col("barcode"))
    cells = A.cells(spark, sf_dir) if with_cells else None
    return SimulationTables(hits, measurements, place, particles, cells)


@query(
    "chain_simulation_true_hits",
    with_tables(
        "simulated",
        "detector",
        body=f"""
SELECT event_id, hit_id, hit_id AS measurement_id, particle_id, tx AS x, ty AS y, tz AS z, tt AS t, volume_id, layer_id, module_id,
  {REGION_OF_VOLUME} AS region FROM simulated JOIN detector USING (geometry_id)""",
    ),
)
def chain_simulation_true_hits(spark, sf_dir):
    """P11 and P8 in a row: simulated hits as they are."""
    hits, _ = build_simulation(simulation_tables(spark, sf_dir, False), A.detector(spark, sf_dir), VOLUMES, True)
    return hits.select(E, "hit_id", "measurement_id", "particle_id", "x", "y", "z", "t", *D.MODULE_KEY, "region")


@query(
    "chain_simulation_measured",
    with_tables(
        "measured_hits",
        body="""
SELECT event_id, measurement_id, hit_id, particle_id, region, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z,
  CAST(cell_count AS DOUBLE) AS cell_count, round(lx, 6) + 0.0 AS lx, round(ly, 6) + 0.0 AS ly FROM measured_hits""",
    ),
)
def chain_simulation_measured(spark, sf_dir):
    """J8, P10, J9, A4 to A7 and P8 in a row: measurements in space, with their cells."""
    hits, _ = build_simulation(simulation_tables(spark, sf_dir, True), A.detector(spark, sf_dir), VOLUMES, False)
    return hits.select(
        E, "measurement_id", "hit_id", "particle_id", "region", *[rnd(c).alias(c) for c in "xyz"],
        F.col("cell_count").cast("double"), *[rnd(c).alias(c) for c in ("lx", "ly")],
    )


@query(
    "chain_simulation_particles",
    with_tables(
        "measured_hits",
        "raw_particles",
        body="""
SELECT p.event_id, p.subevent * 61 + p.barcode AS particle_id, round(sqrt(vx * vx + vy * vy), 6) + 0.0 AS radius,
  round(sqrt(px * px + py * py), 6) + 0.0 AS pt, COALESCE(n.nhits, 0) AS nhits
FROM raw_particles p LEFT JOIN (SELECT event_id, particle_id, COUNT(*) AS nhits FROM measured_hits GROUP BY ALL) n
ON n.event_id = p.event_id AND n.particle_id = p.subevent * 61 + p.barcode""",
    ),
)
def chain_simulation_particles(spark, sf_dir):
    """P7 and A3 at the end of the chain."""
    _, particles = build_simulation(simulation_tables(spark, sf_dir, True), A.detector(spark, sf_dir), VOLUMES, False)
    return particles.select(E, "particle_id", rnd("radius").alias("radius"), rnd("pt").alias("pt"), "nhits")
