"""Detector geometry joins: cells, local directions and global positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rotate, spherical, theta_to_eta, transverse_momentum
from .joins import E, join_per_key

MODULE_KEY = ["volume_id", "layer_id", "module_id"]
ROTATION = [f"rot_{a}{b}" for a in "xyz" for b in "uvw"]


def cell_statistics(cells: DataFrame) -> DataFrame:
    return cells.groupBy(E, "hit_id").agg(
        F.count("value").cast("float").alias("cell_count"), F.sum("value").cast("float").alias("cell_val")
    )


def cell_extents(cells: DataFrame) -> DataFrame:
    """Number of channels spanned by a hit along both axes."""
    return cells.groupBy(E, "hit_id").agg(
        (F.max("ch0") - F.min("ch0") + 1).alias("n_u"), (F.max("ch1") - F.min("ch1") + 1).alias("n_v")
    )


def mark_extreme_cells(cells: DataFrame, channel: str = "ch0") -> DataFrame:
    """Flags of the cells at the least and the greatest channel of their hit."""
    ends = cells.groupBy(E, "hit_id").agg(F.min(channel).alias("_lo"), F.max(channel).alias("_hi"))
    return (
        join_per_key(cells, ends, [E, "hit_id"])
        .withColumns({"is_min": F.col(channel) == F.col("_lo"), "is_max": F.col(channel) == F.col("_hi")})
        .drop("_lo", "_hi")
    )


def add_cell_directions(hits: DataFrame, cells: DataFrame, detector: DataFrame) -> DataFrame:
    """Cell counts, local extents and local / global directions of hits that have cells."""
    per_hit = cells.groupBy(E, "hit_id").agg(
        F.count("value").cast("float").alias("cell_count"),
        F.sum("value").cast("float").alias("cell_val"),
        (F.max("ch0") - F.min("ch0") + 1).alias("_nu"),
        (F.max("ch1") - F.min("ch1") + 1).alias("_nv"),
    )
    modules = detector.select(*MODULE_KEY, "pitch_u", "pitch_v", "module_t", *ROTATION)
    joined = hits.join(per_hit, [E, "hit_id"]).join(modules, MODULE_KEY)
    local = joined.withColumns(
        {
            "lx": F.col("_nu") * F.col("pitch_u"),
            "ly": F.col("_nv") * F.col("pitch_v"),
            "lz": F.col("module_t") * 2.0,
        }
    )
    gx, gy, gz = rotate("lx", "ly", "lz")
    rotated = local.withColumns({"_gx": gx, "_gy": gy, "_gz": gz})
    l_theta, l_phi = spherical("lx", "ly", "lz")
    g_theta, g_phi = spherical("_gx", "_gy", "_gz")
    return rotated.withColumns(
        {"leta": theta_to_eta(l_theta), "lphi": l_phi, "geta": theta_to_eta(g_theta), "gphi": g_phi}
    ).drop("_nu", "_nv", "_gx", "_gy", "_gz", "pitch_u", "pitch_v", "module_t", *ROTATION)


def measurements_to_hits(
    measurements: DataFrame, detector: DataFrame, hit_map: DataFrame, truth_hits: DataFrame
) -> DataFrame:
    """Decoded module, global position, hit and particle of each local measurement.

    A measurement named twice in the map takes the row with the greatest hit id.
    """
    decoded = measurements.join(
        detector.select("geometry_id", *MODULE_KEY, "cx", "cy", "cz", *ROTATION), "geometry_id"
    )
    gx, gy, gz = rotate("local0", "local1", F.lit(0.0))
    placed = decoded.withColumns({"x": F.col("cx") + gx, "y": F.col("cy") + gy, "z": F.col("cz") + gz})
    to_hit = hit_map.groupBy(E, "measurement_id").agg(F.max("hit_id").alias("hit_id"))
    particle = truth_hits.select(E, "hit_id", "particle_id")
    return (
        placed.join(to_hit, [E, "measurement_id"], "left")
        .join(particle, [E, "hit_id"], "left")
        .drop("cx", "cy", "cz", *ROTATION)
    )


def true_hits(sim_hits: DataFrame, detector: DataFrame, order: str = "index") -> DataFrame:
    """Simulated hits in the hit scheme, numbered 0.. by their index within the event."""
    from .ranking import dense_index

    decoded = sim_hits.join(detector.select("geometry_id", *MODULE_KEY), "geometry_id")
    numbered = dense_index(decoded, [E], order, "hit_id").drop(order)
    renamed = numbered.withColumnsRenamed({"tx": "x", "ty": "y", "tz": "z", "tt": "t"})
    return renamed.withColumn("measurement_id", F.col("hit_id"))


def truth_with_hits(truth: DataFrame, hits: DataFrame, modules: DataFrame, base: int = 1) -> DataFrame:
    """Truth rows with their hit and module index, hit ids shifted to start at 0."""
    joined = truth.join(hits, [E, "hit_id"], "left").join(modules, MODULE_KEY, "left")
    return joined.withColumn("hit_id", F.col("hit_id") - base)


def restrict_to_cells(measurements: DataFrame, cells: DataFrame, strict: bool = False) -> DataFrame:
    """Measurements that have cells; ``strict`` raises if an event has cells of measurements that are not there."""
    with_cells = cells.select(E, F.col("hit_id").alias("measurement_id")).distinct()
    if strict:
        lost = with_cells.join(measurements.select(E, "measurement_id"), [E, "measurement_id"], "left_anti")
        first = lost.groupBy(E).agg(F.count("*").alias("n")).head(1)
        if first:
            raise ValueError(f"event {first[0][E]}: {first[0]['n']} measurements have cells, but are not in the event")
    return measurements.join(with_cells, [E, "measurement_id"], "left_semi")


def particle_kinematics(particles: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """radius, pt, particle_eta and, with hits given, the number of hits of the particle."""
    pt = transverse_momentum("px", "py")
    out = particles.withColumns({"radius": transverse_momentum("vx", "vy"), "pt": pt})
    p = F.sqrt(F.col("pt") * F.col("pt") + F.col("pz") * F.col("pz"))
    out = out.withColumn("particle_eta", F.atanh(F.try_divide(F.col("pz"), p)))
    if hits is None:
        return out
    counts = hits.groupBy(E, "particle_id").agg(F.count("*").alias("nhits"))
    return out.join(counts, [E, "particle_id"], "left").withColumn("nhits", F.coalesce("nhits", F.lit(0)))
