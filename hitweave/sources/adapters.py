"""Event tables derived from the driver's Parquet tables.

Each adapter is one projection (or one grouping) of a given table, so its size
grows with that table. An event holds 500 consecutive rows of ``events``, or 250
orders with their lineitems, or 100 embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HITS_PER_EVENT = 500
ORDERS_PER_EVENT = 250
VECTORS_PER_EVENT = 100
SECTORS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on straight lines from the origin, smeared; type ``error`` is noise."""
    return hits_of(table(spark, sf_dir, "events"))


def hits_of(events: DataFrame) -> DataFrame:
    raw = events.select(
        F.expr(f"event_id div {HITS_PER_EVENT}").alias("event_id"),
        F.expr(f"event_id % {HITS_PER_EVENT}").alias("hit_id"),
        F.expr("user_id % 40").alias("u"),
        F.expr("cast(substring(props, 7, length(props) - 7) as bigint)").alias("k"),
        F.expr("event_type = 'error'").alias("noise"),
        F.col("value").alias("value"),
    )
    raw = raw.selectExpr("*", "k div 10 as layer", "k % 10 as s")
    return raw.selectExpr(
        "event_id",
        "hit_id",
        "case when noise then 0L else u + 1 end as particle_id",
        "cast((layer + 1) * (2 * ((u * 7) % 11) - 11) * 10 + s - 5 as double) as x",
        "cast((layer + 1) * (2 * ((u * 5) % 13) - 13) * 10 - s + 4 as double) as y",
        "cast((layer + 1) * ((u * 13) % 41 - 20) * 10 as double) + value as z",
        f"layer * {SECTORS} + u % {SECTORS} as module_id",
        "layer",
        "layer % 6 + 1 as region",
        "case when layer < 5 then 'PIXEL' else 'STRIP' end as hardware",
        "u % 3 - 1 as barrel_endcap",
        "layer as layer_disk",
        "u % 5 as eta_module",
        "s as phi_module",
        "value as deposit",
    )


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (event, true particle) that left a hit."""
    seen = hits(spark, sf_dir).where("particle_id <> 0").select("event_id", "particle_id").distinct()
    return seen.selectExpr(
        "event_id",
        "particle_id",
        "199990 + particle_id as barcode",
        "cast((particle_id * 37) % 50 as double) / 10 as pt",
        "cast(particle_id % 3 - 1 as double) as vx",
        "cast(particle_id % 5 - 2 as double) as vy",
        "cast(particle_id % 7 - 3 as double) as vz",
        "cast(particle_id % 3 - 1 as double) as charge",
        "case when particle_id % 9 = 0 then 11L when particle_id % 9 = 1 then -11L else 211L end as pdg_id",
        "cast(particle_id % 17 - 8 as double) / 2 as eta_particle",
    )


def candidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of neighbouring layers in one sector, with a score and a truth flag."""
    h = hits(spark, sf_dir).select("event_id", "hit_id", "module_id", "particle_id")
    src = h.toDF("event_id", "src", "src_module", "src_particle")
    dst = h.toDF("event_id", "dst", "dst_module", "dst_particle")
    pairs = src.withColumn("dst_module", F.col("src_module") + SECTORS).join(dst, ["event_id", "dst_module"])
    same = "src_particle = dst_particle and src_particle <> 0"
    return pairs.selectExpr(
        "event_id",
        f"src * {HITS_PER_EVENT} + dst as edge_id",
        "src",
        "dst",
        f"({same}) as y",
        f"cast(case when {same} then 350 + (src * 31 + dst * 17) % 650"
        " else (src * 31 + dst * 17) % 610 end as double) / 1000 as score",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded hits; a label is the particle."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {VECTORS_PER_EVENT}").alias("event_id"),
        F.expr(f"vec_id % {VECTORS_PER_EVENT}").alias("hit_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("bigint").alias("particle_id"),
    )


def detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module geometry, one row per part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as geometry_id",
        "p_partkey % 4 as volume_id",
        "(p_partkey div 4) % 5 as layer_id",
        "p_partkey div 20 as module_id",
        "cast(p_size as double) as cx",
        "cast(p_size * 2 as double) as cy",
        "cast(p_partkey % 100 - 50 as double) as cz",
        "cast(1 as double) as rot_xu",
        "cast(p_size % 3 as double) / 10 as rot_xv",
        "cast(0 as double) as rot_xw",
        "cast(p_size % 5 as double) / -10 as rot_yu",
        "cast(1 as double) as rot_yv",
        "cast(p_size % 7 as double) / 10 as rot_yw",
        "cast(0 as double) as rot_zu",
        "cast(p_size % 2 as double) / 4 as rot_zv",
        "cast(1 as double) as rot_zw",
        "cast(p_size as double) / 1000 as pitch_u",
        "cast(p_size + 5 as double) / 1000 as pitch_v",
        "cast(p_size as double) / 200 as module_t",
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One local measurement per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey div {ORDERS_PER_EVENT} as event_id",
        f"o_orderkey % {ORDERS_PER_EVENT} as measurement_id",
        "o_custkey as geometry_id",
        "cast(o_orderkey % 21 - 10 as double) / 10 as local0",
        "cast(o_custkey % 13 - 6 as double) / 10 as local1",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One readout channel per lineitem."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"l_orderkey div {ORDERS_PER_EVENT} as event_id",
        f"l_orderkey % {ORDERS_PER_EVENT} as hit_id",
        "l_partkey % 50 as ch0",
        "l_suppkey % 50 as ch1",
        "l_quantity as value",
    )


def raw_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated particles (subevent, barcode) of each event, barcodes of varying width."""
    seen = table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey div {ORDERS_PER_EVENT} as event_id",
        "o_custkey % 2 as subevent",
        "o_custkey % 61 as barcode",
    )
    return seen.distinct().selectExpr(
        "event_id",
        "subevent",
        "barcode",
        "cast(barcode % 11 - 5 as double) as px",
        "cast(barcode % 7 - 3 as double) as py",
        "cast(barcode % 13 - 6 as double) as pz",
        "cast(barcode % 3 - 1 as double) as charge",
        "cast(barcode % 5 as double) as vx",
        "cast(barcode % 4 as double) as vy",
        "cast(barcode % 9 as double) as vz",
        "cast(case when barcode % 2 = 0 then 11 else 211 end as bigint) as pdg_id",
    )


def raw_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with zero to three links ``(subevent,barcode)``, 1-based ids."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey div {ORDERS_PER_EVENT} as event_id",
        f"o_orderkey % {ORDERS_PER_EVENT} + 1 as cluster_id",
        "case when o_orderstatus = 'F' then 'PIXEL' else 'STRIP' end as hardware",
        "o_custkey % 3 - 1 as barrel_endcap",
        "o_custkey % 4 as layer_disk",
        "o_custkey % 5 as eta_module",
        "o_custkey % 6 as phi_module",
        "concat_ws(',',"
        " case when o_orderkey % 4 > 0 then concat('(', o_custkey % 2, ',', o_custkey % 61, ')') end,"
        " case when o_orderkey % 4 > 1 then concat('(', o_custkey % 2, ',', (o_custkey + 1) % 61, ')') end,"
        " case when o_orderkey % 4 > 2 then concat('(', (o_custkey + 1) % 2, ',', (o_custkey * 3) % 61, ')') end"
        ") as links",
    )


def raw_spacepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel points name one cluster, strip points two."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey div {ORDERS_PER_EVENT} as event_id",
        f"o_orderkey % {ORDERS_PER_EVENT} as hit_id",
        "cast(o_orderkey % 101 - 50 as double) as x",
        "cast(o_custkey % 103 - 51 as double) as y",
        "cast(o_orderkey % 107 - 53 as double) as z",
        f"o_orderkey % {ORDERS_PER_EVENT} as cluster_index_1",
        f"case when o_orderstatus = 'F' then null else (o_orderkey + o_custkey % 2) % {ORDERS_PER_EVENT} end"
        " as cluster_index_2",
    )


def module_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup rows of both sides, duplicated once, as the raw file has them."""
    rows = raw_clusters(spark, sf_dir).select(
        "hardware", "barrel_endcap", "layer_disk", "eta_module", "phi_module"
    ).distinct()
    both = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(0), F.lit(1))))
    return both.withColumn(
        "ID",
        F.expr(
            "(case when hardware = 'PIXEL' then 0 else 1000 end) + (barrel_endcap + 1) * 300"
            " + layer_disk * 60 + eta_module * 10 + phi_module"
        ),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as (truth, score) rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").selectExpr(
        "doc_id", "quality = 1 as y", "cast((n_chars * 37 + doc_id) % 1000 as double) / 1000 as score"
    )
