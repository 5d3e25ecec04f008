"""Queries over sources: text and nested formats, discovery, splits and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..operators.joins import E
from ..session import checkpoint_root
from ..sources import adapters as A
from ..sources import files, nested, sinks, text_dumps
from ..sources.schemas import MODULE_MAP_COLUMNS, SPACEPOINT_TYPES, coerce
from .registry import query, rnd
from .sqltables import cte, with_tables


# ---- S1: event-file discovery -------------------------------------------------
@query(
    "s1_event_files",
    with_tables(
        body="""
, named AS (
  SELECT page_id // 3 AS event_id, CASE page_id % 3 WHEN 0 THEN 'truth' WHEN 1 THEN 'cells' ELSE 'particles' END AS term,
         page_id FROM pages),
whole AS (SELECT event_id FROM named GROUP BY event_id HAVING COUNT(DISTINCT term) = 3)
SELECT event_id, term, '/data/run7/event' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '-' || term || '.csv' AS path
FROM named WHERE event_id IN (SELECT event_id FROM whole)"""
    ).replace("WITH \n,", "WITH", 1),
)
def s1_event_files(spark, sf_dir):
    """File names made from the pages table; an event needs all three terms."""
    paths = A.table(spark, sf_dir, "pages").selectExpr(
        "concat('/data/run7/event', lpad(cast(page_id div 3 as string), 9, '0'), '-',"
        " case page_id % 3 when 0 then 'truth' when 1 then 'cells' else 'particles' end, '.csv') as path"
    )
    return files.complete_events(paths, ["truth", "cells", "particles"]).select(E, "term", "path")


# ---- S2-S5: text dumps --------------------------------------------------------
PARTICLE_LINE = (
    "concat_ws(',', subevent, barcode, px, py, pz, px + py, pz / 4, vx, vy, vz, vx * vx, 1, charge, pdg_id, 'OK',"
    " 1, 2, 3, barcode + 1)"
)


@query(
    "s2_particle_dump",
    with_tables(
        "raw_particles",
        body="""
SELECT event_id, subevent, barcode, px, pz, px + py AS pt, pz / 4 AS eta, 1 AS status, charge,
       CAST(pdg_id AS INTEGER) AS pdg_id, 'OK' AS pass, barcode + 1 AS prod_barcode
FROM raw_particles""",
    ),
)
def s2_particle_dump(spark, sf_dir):
    """Lines of the particle dump, written by Spark from the given tables and parsed back."""
    lines = A.raw_particles(spark, sf_dir).select(
        E, F.concat(F.expr(PARTICLE_LINE), F.lit(",#,7,8,#")).alias("value")
    )
    p = text_dumps.parse_particles(lines)
    return p.selectExpr(
        "event_id", "subevent", "barcode", "cast(px as double) as px", "cast(pz as double) as pz",
        "cast(pt as double) as pt", "cast(eta as double) as eta", "status", "cast(charge as double) as charge",
        "pdgId as pdg_id", "pass", "vProdBarcode as prod_barcode",
    )


CLUSTER_LINE = (
    "concat(concat_ws(',', cluster_id, hardware, cluster_id * 2, barrel_endcap, layer_disk), ',#,',"
    " concat_ws(',', barrel_endcap, layer_disk, eta_module, phi_module, 0), ',#,', links, ',#,', '1,2', ',#,',"
    " case when hardware = 'PIXEL' then '1,2,3,4,5,6,7,8,9,10,11,12,13,14' else '13,14' end, ',#,',"
    " concat_ws(',', phi_module, eta_module, 1), ',#,', '0,0')"
)


@query(
    "s3_s4_cluster_dump",
    with_tables(
        "raw_clusters",
        body="""
SELECT event_id, cluster_id, hardware, CAST(cluster_id * 2 AS DOUBLE) AS cluster_x, eta_module, phi_module,
       CASE WHEN hardware = 'PIXEL' THEN 1.0::DOUBLE END AS count, 13.0::DOUBLE AS eta_angle, 14.0::DOUBLE AS phi_angle,
       CAST(phi_module AS DOUBLE) AS norm_x,
       CASE n_links WHEN 0 THEN '' ELSE '(' || (c % 2) || ',' || (c % 61) || ')' END
       || CASE WHEN n_links > 1 THEN ',(' || (c % 2) || ',' || ((c + 1) % 61) || ')' ELSE '' END
       || CASE WHEN n_links > 2 THEN ',(' || ((c + 1) % 2) || ',' || ((c * 3) % 61) || ')' ELSE '' END AS links
FROM raw_clusters""",
    ),
)
def s3_s4_cluster_dump(spark, sf_dir):
    """Cluster lines with the long (14) and the short (2) shape group."""
    lines = A.raw_clusters(spark, sf_dir).select(E, F.expr(CLUSTER_LINE).alias("value"))
    return text_dumps.parse_clusters(lines).select(
        E, "cluster_id", "hardware", "cluster_x", "eta_module", "phi_module", "count", "eta_angle", "phi_angle",
        "norm_x", "links",
    )


@query(
    "s5_spacepoint_dump",
    with_tables(
        "raw_spacepoints",
        body="""
SELECT event_id, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY hit_id) - 1 AS hit_id, x, y, z, cluster_index_1,
       COALESCE(cluster_index_2, cluster_index_1) AS cluster_index_2
FROM raw_spacepoints""",
    ),
)
def s5_spacepoint_dump(spark, sf_dir):
    """Spacepoint lines whose ids have gaps; they come back dense, pixel points with one cluster."""
    lines = A.raw_spacepoints(spark, sf_dir).select(
        E,
        F.expr(
            "concat_ws(',', hit_id * 3 + 5, x, y, z, cluster_index_1, coalesce(cast(cluster_index_2 as string), ''))"
        ).alias("value"),
    )
    return text_dumps.renumber_spacepoints(text_dumps.parse_spacepoints(lines)).select(
        E, "hit_id", "x", "y", "z", "cluster_index_1", "cluster_index_2"
    )


# ---- S6-S7: nested branches ---------------------------------------------------
@query(
    "s6_s7_nested_branches",
    with_tables(
        "raw_spacepoints",
        body="SELECT event_id, hit_id, x, y, z, cluster_index_1,"
        " COALESCE(cluster_index_2, cluster_index_1) AS cluster_index_2 FROM raw_spacepoints",
    ),
)
def s6_s7_nested_branches(spark, sf_dir):
    """One row of parallel arrays per block of points, flattened, renamed and cleaned."""
    branch = {
        "SPindex": "hit_id", "SPx": "x", "SPy": "y", "SPz": "z", "SPCL1_index": "cluster_index_1",
        "SPCL2_index": "coalesce(cluster_index_2, -1L)",
    }
    packed = (
        A.raw_spacepoints(spark, sf_dir)
        .groupBy(E, F.expr("hit_id div 50").alias("_block"))
        .agg(F.sort_array(F.collect_list(F.struct(*[F.expr(v).alias(k) for k, v in branch.items()]))).alias("_rows"))
        .select(E, *[F.col(f"_rows.{k}").alias(k) for k in branch])
    )
    points = nested.clean_nested_spacepoints(nested.flatten_branches(packed))
    return points.select(E, "hit_id", "x", "y", "z", "cluster_index_1", "cluster_index_2")


# ---- S9, S11, S12, S13, S14 ---------------------------------------------------
@query(
    "s9_module_lookup",
    with_tables(
        "module_lookup",
        body="SELECT hardware, barrel_endcap, layer_disk, eta_module, phi_module, module_id FROM module_lookup",
    ),
)
def s9_module_lookup(spark, sf_dir):
    lookup = text_dumps.clean_module_lookup(A.module_lookup(spark, sf_dir))
    return lookup.selectExpr(
        "hardware", "barrel_endcap", "layer_disk", "eta_module", "phi_module", "cast(ID as bigint) as module_id"
    )


# Rows of the module map: every module with the modules of the next two layers in its sector.
MAP_PAIRS = {"12": 1.0, "23": 1.5}
cte("module_map", """
SELECT DISTINCT module_id AS mid_1, module_id + 10 AS mid_2, module_id + 20 AS mid_3, 1 AS occurence,
       CAST(400 + module_id % 7 * 20 AS DOUBLE) AS z0max_12, CAST(-400 - module_id % 5 * 20 AS DOUBLE) AS z0min_12,
       1.0::DOUBLE AS dphimax_12, -1.0::DOUBLE AS dphimin_12,
       0.05::DOUBLE AS phiSlopemax_12, -0.05::DOUBLE AS phiSlopemin_12,
       0.8::DOUBLE AS detamax_12, -0.8::DOUBLE AS detamin_12,
       CAST(500 + module_id % 7 * 20 AS DOUBLE) AS z0max_23, CAST(-500 - module_id % 5 * 20 AS DOUBLE) AS z0min_23,
       1.5::DOUBLE AS dphimax_23, -1.5::DOUBLE AS dphimin_23,
       0.05::DOUBLE AS phiSlopemax_23, -0.05::DOUBLE AS phiSlopemin_23,
       0.9::DOUBLE AS detamax_23, -0.9::DOUBLE AS detamin_23,
       1.5::DOUBLE AS diff_dzdr_max, -1.5::DOUBLE AS diff_dzdr_min,
       30.0::DOUBLE AS diff_dydx_max, -30.0::DOUBLE AS diff_dydx_min
FROM hits""", "hits")


def module_map_lines(spark, sf_dir):
    """The map as whitespace-separated lines, one per module seen."""
    fields = [
        "module_id", "module_id + 10", "module_id + 20", "1",
        "400 + module_id % 7 * 20", "-400 - module_id % 5 * 20", "'1.0'", "'-1.0'", "'0.05'", "'-0.05'", "'0.8'", "'-0.8'",
        "500 + module_id % 7 * 20", "-500 - module_id % 5 * 20", "'1.5'", "'-1.5'", "'0.05'", "'-0.05'", "'0.9'", "'-0.9'",
        "'1.5'", "'-1.5'", "'30.0'", "'-30.0'",
    ]
    modules = A.hits(spark, sf_dir).select("module_id").distinct()
    return modules.selectExpr(f"concat_ws('  ', {', '.join(fields)}) as value")


@query(
    "s11_module_map",
    with_tables("module_map", body=f"SELECT {', '.join(MODULE_MAP_COLUMNS)} FROM module_map"),
)
def s11_module_map(spark, sf_dir):
    """Parsed map, put together again from its three parts."""
    first, second, triplet = text_dumps.module_map_parts(text_dumps.parse_module_map(module_map_lines(spark, sf_dir)))
    ids = ["mid_1", "mid_2", "mid_3"]
    joined = first.join(second, ids).join(triplet, ids).withColumn("occurence", F.lit(1))
    return joined.select(*MODULE_MAP_COLUMNS)


EVENT_LINES = "concat_ws(' ', 410000, o_orderkey, o_orderkey % 100, concat('f', o_custkey % 10, '.root')) as value"


@query(
    "s12_event_assignment",
    """
WITH entries AS (
  SELECT o_orderkey AS event_id, 'trainset' AS dataset, o_orderkey % 100 AS entry,
         'f' || (o_custkey % 10) || '.root' AS file, 1 AS ordinal FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT o_orderkey, 'valset', o_orderkey % 100, 'f' || (o_custkey % 10) || '.root', 2 FROM orders
  WHERE o_orderpriority = '5-LOW'
  UNION ALL
  SELECT o_orderkey, 'testset', o_orderkey % 100, 'f' || (o_custkey % 10) || '.root', 3 FROM orders
  WHERE o_orderpriority = '1-URGENT')
SELECT a.event_id, a.dataset, a.entry, a.file, n.n_datasets
FROM (SELECT event_id, arg_max(dataset, ordinal) AS dataset, arg_max(entry, ordinal) AS entry,
             arg_max(file, ordinal) AS file FROM entries GROUP BY event_id) a
JOIN (SELECT event_id, COUNT(DISTINCT dataset) AS n_datasets FROM entries GROUP BY event_id) n USING (event_id)""",
)
def s12_event_assignment(spark, sf_dir):
    """Three event lists; the later one wins, overlaps are counted (D8)."""
    orders = A.table(spark, sf_dir, "orders")
    lists = {
        "trainset": "o_orderstatus = 'F'",
        "valset": "o_orderpriority = '5-LOW'",
        "testset": "o_orderpriority = '1-URGENT'",
    }
    entries = None
    for ordinal, (dataset, rule) in enumerate(lists.items()):
        lines = orders.where(rule).selectExpr(EVENT_LINES, f"{ordinal} as ordinal")
        part = text_dumps.parse_event_list(lines, dataset)
        entries = part if entries is None else entries.unionByName(part)
    overlap = files.overlapping_events(entries)
    return (
        files.assign_events(entries)
        .join(overlap, E, "left")
        .withColumn("n_datasets", F.coalesce("n_datasets", F.lit(1).cast("bigint")))
    )


@query(
    "d8_split_overlap",
    """
SELECT o_orderkey AS event_id, 2::BIGINT AS n_datasets FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('5-LOW', '1-URGENT')""",
)
def d8_split_overlap(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders")
    train = orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey as event_id", "'trainset' as dataset")
    test = orders.where("o_orderpriority in ('5-LOW', '1-URGENT')").selectExpr(
        "o_orderkey as event_id", "'testset' as dataset"
    )
    return files.overlapping_events(train.unionByName(test))


@query(
    "s13_split_sizes",
    """
WITH n AS (SELECT COUNT(DISTINCT o_orderkey // 250) AS n FROM orders)
SELECT 'trainset' AS dataset, CAST(floor(n * 0.8) AS BIGINT) AS n_events FROM n UNION ALL
SELECT 'valset', CAST(floor(n * 0.1) AS BIGINT) FROM n UNION ALL
SELECT 'testset', n - CAST(floor(n * 0.8) AS BIGINT) - CAST(floor(n * 0.1) AS BIGINT) FROM n""",
)
def s13_split_sizes(spark, sf_dir):
    """Exact sizes of the seeded random split, the rest going to the test set."""
    events = A.measurements(spark, sf_dir)
    split = files.split_events(events, {"trainset": 0.8, "valset": 0.1, "testset": None})
    sizes = split.agg(*[F.count_if(F.col("dataset") == d).alias(d) for d in ("trainset", "valset", "testset")])
    return sizes.unpivot([], ["trainset", "valset", "testset"], "dataset", "n_events")


@query(
    "s13_split_members",
    f"""
WITH e AS (SELECT DISTINCT o_orderkey // 250 AS event_id FROM orders),
r AS (SELECT event_id, ROW_NUMBER() OVER (ORDER BY {draw_sql('event_id', seed=42)}, event_id) AS n, COUNT(*) OVER () AS size FROM e)
SELECT event_id, CASE WHEN n <= floor(size * 0.8) THEN 'trainset' WHEN n <= floor(size * 0.8) + floor(size * 0.1) THEN 'valset'
  ELSE 'testset' END AS dataset FROM r""",
)
def s13_split_members(spark, sf_dir):
    """Which event went where."""
    return files.split_events(A.measurements(spark, sf_dir), {"trainset": 0.8, "valset": 0.1, "testset": None})


@query(
    "s14_first_events",
    with_tables(
        "hits",
        body="""SELECT event_id, COUNT(*) AS n_hits FROM hits
WHERE event_id IN (SELECT DISTINCT event_id FROM hits ORDER BY event_id LIMIT 8) GROUP BY event_id""",
    ),
)
def s14_first_events(spark, sf_dir):
    """T5 too: the first eight events, the feature being the limit."""
    return files.first_events(A.hits(spark, sf_dir), 8).groupBy(E).agg(F.count("*").alias("n_hits"))


# ---- S17: track lines ---------------------------------------------------------
@query(
    "s17_track_lines",
    with_tables(
        "hits",
        body="""
SELECT event_id, particle_id - 1 AS track_id,
       string_agg(CAST(hit_id AS VARCHAR), ' ' ORDER BY hit_id) AS value
FROM hits WHERE particle_id - 1 >= 0 GROUP BY event_id, particle_id""",
    ),
)
def s17_track_lines(spark, sf_dir):
    """A13 too: hits of each track as one line, untracked hits (-1) left out."""
    labelled = A.hits(spark, sf_dir).selectExpr("event_id", "hit_id", "particle_id - 1 as track_id")
    return sinks.track_lines(labelled)


# ---- P27: type coercion -------------------------------------------------------
@query(
    "p27_type_coercion",
    with_tables(
        "raw_spacepoints",
        body="""
SELECT event_id, hit_id, CAST(cluster_index_1 AS BIGINT) AS cluster_index_1,
       CAST(CAST(x / 3 AS FLOAT) AS DOUBLE) AS cluster_x_1, CAST(z AS INTEGER) AS layer_disk
FROM raw_spacepoints""",
    ),
)
def p27_type_coercion(spark, sf_dir):
    raw = A.raw_spacepoints(spark, sf_dir).selectExpr(
        "event_id", "hit_id", "cast(cluster_index_1 as string) as cluster_index_1", "x / 3 as cluster_x_1",
        "z as layer_disk",
    )
    typed = coerce(raw, SPACEPOINT_TYPES)
    return typed.withColumn("cluster_x_1", F.col("cluster_x_1").cast("double"))


# ---- S8, S15, S16: files out and in again --------------------------------------
def scratch(spark) -> str:
    return f"{checkpoint_root(spark)}/files/{uuid.uuid4().hex}"


@query("s8_s15_event_csv", with_tables("hits", body="SELECT event_id, hit_id, particle_id, z, hardware FROM hits"))
def s8_s15_event_csv(spark, sf_dir):
    """Hits written as CSV by dataset and event, read back with a schema and the event from the path."""
    path = scratch(spark)
    hits = A.hits(spark, sf_dir).select(E, "hit_id", "particle_id", "z", "hardware")
    sinks.write_event_csv(hits.withColumn("dataset", F.lit("trainset")), path)
    columns = "hit_id bigint, particle_id bigint, z double, hardware string"
    return files.read_event_csv(spark, f"{path}/dataset=*/event_id=*", columns, number="event_id=([0-9]+)")


@query(
    "s15_event_files",
    with_tables(
        "hits",
        body="""SELECT event_id, 'event' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '-truth.csv' AS file, COUNT(*) AS n_hits,
CAST(SUM(hit_id) AS BIGINT) AS hit_ids, round(SUM(z), 3) + 0.0 AS z FROM hits GROUP BY event_id""",
    ),
)
def s15_event_files(spark, sf_dir):
    """S1 too: one CSV file per event under its own name, found in the folder again and read back."""
    path = scratch(spark)
    hits = A.hits(spark, sf_dir).select(E, "hit_id", "particle_id", "z")
    sinks.write_event_files(hits, path, "event{:09d}-truth.csv", "csv", order=["hit_id"])
    sinks.write_event_files(hits.select(E, "particle_id").distinct(), path, "event{:09d}-particles.csv", "csv", order=["particle_id"])
    named = files.event_files(spark, path, ["truth", "particles"]).where("term = 'truth'")
    read = files.read_event_csv(spark, f"{path}/*-truth.csv", "hit_id bigint, particle_id bigint, z double", number="event([0-9]+)-truth")
    sums = read.groupBy(E).agg(F.count("*").alias("n_hits"), F.sum("hit_id").alias("hit_ids"), rnd(F.sum("z"), 3).alias("z"))
    return named.select(E, F.element_at(F.split("path", "/"), -1).alias("file")).join(sums, E)


@query(
    "s17_event_track_files",
    with_tables(
        "hits",
        body="""
, t AS (SELECT event_id, particle_id - 1 AS track_id, string_agg(CAST(hit_id AS VARCHAR), ' ' ORDER BY hit_id) AS line
  FROM hits WHERE particle_id > 0 GROUP BY event_id, particle_id)
SELECT event_id, 'event' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.txt' AS file,
  string_agg(line, chr(10) ORDER BY track_id) || chr(10) AS content FROM t GROUP BY event_id""",
    ),
)
def s17_event_track_files(spark, sf_dir):
    """One text file per event, a line for each track in the order of their ids, read back whole."""
    path = scratch(spark)
    sinks.write_track_files(A.hits(spark, sf_dir).selectExpr("event_id", "hit_id", "particle_id - 1 as track_id"), path)
    whole = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("content"))
    number = F.regexp_extract("path", "event([0-9]+)[.]txt$", 1).cast("bigint")
    return whole.select(number.alias(E), F.element_at(F.split("path", "/"), -1).alias("file"), "content")


@query(
    "s16_graph_tables",
    with_tables(
        "hits",
        "edges",
        body="""SELECT h.event_id, h.n AS n_nodes, e.n AS n_edges, '{"cut": 0.3}' AS config FROM (
SELECT event_id, COUNT(*) AS n FROM hits GROUP BY event_id) h JOIN (
SELECT event_id, COUNT(*) AS n FROM edges WHERE score >= 0.3 GROUP BY event_id) e USING (event_id)""",
    ),
)
def s16_graph_tables(spark, sf_dir):
    """Nodes, edges and track edges written with their configuration, then counted from the files."""
    path = scratch(spark)
    edges = A.candidate_edges(spark, sf_dir).where("score >= 0.3")
    sinks.write_graph(A.hits(spark, sf_dir), edges, edges.where("y"), path, {"cut": 0.3})
    nodes = spark.read.parquet(f"{path}/nodes").groupBy(E, "config").agg(F.count("*").alias("n_nodes"))
    kept = spark.read.parquet(f"{path}/edges").groupBy(E).agg(F.count("*").alias("n_edges"))
    return nodes.join(kept, E).select(E, "n_nodes", "n_edges", "config")


@query(
    "s17_track_files",
    with_tables(
        "hits",
        body="""
SELECT event_id, COUNT(*) AS n_tracks, CAST(SUM(n) AS BIGINT) AS n_hits FROM (
SELECT event_id, particle_id, COUNT(*) AS n FROM hits WHERE particle_id > 0 GROUP BY ALL) GROUP BY event_id""",
    ),
)
def s17_track_files(spark, sf_dir):
    """Track lines written per event and read back as text."""
    path = scratch(spark)
    sinks.write_track_lines(A.hits(spark, sf_dir).selectExpr("event_id", "hit_id", "particle_id - 1 as track_id"), path)
    lines = spark.read.text(f"{path}/event_id=*").select(
        F.regexp_extract("_metadata.file_path", "event_id=([0-9]+)", 1).cast("bigint").alias(E), "value"
    )
    return lines.groupBy(E).agg(
        F.count("*").alias("n_tracks"), F.sum(F.size(F.split("value", " "))).alias("n_hits")
    )
