"""From raw particles, clusters and spacepoints to a clean truth table of hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, primary_flag
from ..session import cut_lineage
from ..sources.schemas import MODULE_COLUMNS
from .joins import E, first_rows, join_per_key, left_join_spread


def particle_ids(particles: DataFrame) -> DataFrame:
    """particle_id = subevent followed by the barcode padded to the event's widest barcode."""
    widest = particles.groupBy(E).agg(F.length(F.max("barcode").cast("string")).alias("_width"))
    text = F.concat(F.col("subevent").cast("string"), F.lpad(F.col("barcode").cast("string"), F.col("_width"), "0"))
    sized = join_per_key(particles, widest, [E])
    return sized.withColumn("particle_id", text.cast("bigint")).drop("_width")


def split_links(clusters: DataFrame) -> DataFrame:
    """(event, cluster, subevent, barcode) from text links ``(s,b),(s,b)``; no link gives one null row."""
    links = clusters.select(E, "cluster_id", F.explode(F.split("links", "\\),\\(")).alias("_link"))
    rows = links.select(E, "cluster_id", F.split(F.translate("_link", "()", ""), ",").alias("_pair"))
    return rows.select(
        E,
        "cluster_id",
        F.expr("try_cast(get(_pair, 0) as bigint)").alias("subevent"),
        F.expr("try_cast(get(_pair, 1) as bigint)").alias("barcode"),
    )


def link_particles(links: DataFrame, particles: DataFrame) -> DataFrame:
    """(event, cluster, particle_id): links to unknown particles give 0."""
    known = particles.select(E, "subevent", "barcode", "particle_id")
    joined = left_join_spread(
        links, known, [E, "subevent", "barcode"], F.col("barcode").isNull(), [E, "cluster_id"]
    )
    return joined.select(E, "cluster_id", F.coalesce("particle_id", F.lit(0)).alias("particle_id"))


def expand_clusters(clusters: DataFrame, links: DataFrame, particles: DataFrame, base: int = 1) -> DataFrame:
    """One row per (cluster, particle); clusters without link keep one row of particle 0."""
    pids = link_particles(links, particles)
    expanded = clusters.drop("links", "subevent", "barcode").join(pids, [E, "cluster_id"], "left")
    return expanded.withColumns(
        {"particle_id": F.coalesce("particle_id", F.lit(0)), "cluster_id": F.col("cluster_id") - base}
    )


def clusters_per_particle(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy(E, "particle_id").agg(F.count("cluster_id").alias("num_clusters"))


def detectable_particles(particles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Charged particles that left at least one cluster."""
    counts = clusters_per_particle(clusters)
    return particles.join(counts, [E, "particle_id"]).where((F.abs("charge") > 0) & (F.col("num_clusters") > 0))


def match_spacepoints(spacepoints: DataFrame, clusters: DataFrame) -> DataFrame:
    """Attach both clusters; the particle counts only where the two agree.

    Cluster columns get suffixes ``_1`` and ``_2`` except the module columns,
    which come from the first cluster.
    """
    shared = [c for c in MODULE_COLUMNS if c in clusters.columns]
    own = [c for c in clusters.columns if c not in (E, "cluster_id", *shared)]

    def side(n: int, keep: list[str]) -> DataFrame:
        return clusters.select(
            E,
            F.col("cluster_id").alias(f"cluster_index_{n}"),
            *keep,
            *[F.col(c).alias(f"{c}_{n}") for c in own],
        )

    matched = spacepoints.join(side(1, shared), [E, "cluster_index_1"], "left").join(
        side(2, []), [E, "cluster_index_2"], "left"
    )
    agree = F.coalesce(F.col("particle_id_1") == F.col("particle_id_2"), F.lit(False))
    return matched.withColumn("particle_id", F.when(agree, F.col("particle_id_1")).otherwise(F.lit(0)))


def drop_noise_duplicates(hits: DataFrame) -> DataFrame:
    """A noise row stays only, once, where the hit has no signal row."""
    signal = hits.where("particle_id <> 0")
    noise = first_rows(hits.where("particle_id = 0").drop("particle_id"), [E, "hit_id"])
    lonely = noise.join(signal.select(E, "hit_id"), [E, "hit_id"], "left_anti")
    return signal.unionByName(_as_noise(lonely))


def _as_noise(hits: DataFrame) -> DataFrame:
    """Particle 0 as a literal: a later filter on signal then skips these rows without reading them."""
    return hits.withColumn("particle_id", F.lit(0).cast("bigint"))


def clean_spacepoints(spacepoints: DataFrame) -> DataFrame:
    """One row per (hit, clusters, particle), missing numbers as -1, noise resolved.

    Matched rows of one spacepoint are in one task, so its noise goes there where it has a signal row. Noise and
    signal read the rest, which is written once instead of being matched for each.
    """
    point = [E, "hit_id", "cluster_index_1", "cluster_index_2"]
    unique = first_rows(spacepoints, [*point, "particle_id"])
    signal = F.coalesce("particle_id", F.lit(-1)) != 0
    marked = unique.withColumn("_resolved", ~signal & F.max(signal).over(Window.partitionBy(*point)))
    return drop_noise_duplicates(cut_lineage(marked.where("not _resolved").drop("_resolved").fillna(-1)))


def cluster_truth(clusters: DataFrame) -> DataFrame:
    """Clusters used as hits: one row per (cluster, particle), noise resolved."""
    rows = first_rows(clusters, [E, "cluster_id", "particle_id"]).withColumnRenamed("cluster_id", "hit_id")
    return drop_noise_duplicates(rows)


def mask_undetectable(truth: DataFrame, detectable: DataFrame) -> DataFrame:
    """Particle 0 for hits whose particle is not in the table."""
    known = detectable.select(E, "particle_id").distinct().withColumn("_known", F.lit(True))
    # Noise takes no part in the join.
    joined = join_per_key(truth.where("particle_id <> 0"), known, [E, "particle_id"], "left")
    pid = F.when(F.col("_known"), F.col("particle_id")).otherwise(F.lit(0))
    masked = joined.withColumn("particle_id", pid).select(*truth.columns)
    return masked.unionByName(_as_noise(truth.where("particle_id = 0 or particle_id is null")).select(*truth.columns))


def region_label(regions: dict[int, dict]) -> Column:
    """Label of the last matching region; fails the job where no region matches."""

    def matches(conditions: dict) -> Column:
        tests = [F.col(k).isin(v) if isinstance(v, list) else F.col(k) == F.lit(v) for k, v in conditions.items()]
        return reduce(lambda a, b: a & b, tests)

    case = None
    for label, conditions in reversed(list(regions.items())):
        branch = F.lit(label).cast("bigint")
        case = F.when(matches(conditions), branch) if case is None else case.when(matches(conditions), branch)
    return case.otherwise(F.raise_error(F.lit("hit outside every region")).cast("bigint"))


def add_module_id(hits: DataFrame, lookup: DataFrame) -> DataFrame:
    """module_id by the five module columns; unknown or ambiguous modules fail the job."""
    if "module_id" in hits.columns:
        return hits
    if "module_id_1" in hits.columns:
        return hits.withColumn("module_id", F.col("module_id_1"))
    ids = lookup.groupBy(*MODULE_COLUMNS).agg(
        F.min("ID").cast("bigint").alias("_id"), F.count_distinct("ID").alias("_n")
    )
    joined = join_per_key(hits, ids, MODULE_COLUMNS, "left")
    module = F.when(F.col("_n") == 1, F.col("_id")).otherwise(
        F.raise_error(F.lit("unknown or ambiguous module")).cast("bigint")
    )
    return joined.withColumn("module_id", module).drop("_id", "_n")


def add_particles(hits: DataFrame, particles: DataFrame, features: list[str]) -> DataFrame:
    """Particle features, vertex, primary flag and hits per particle on every hit.

    Noise keeps null features and ``nhits = -1``.
    """
    if "barcode" in particles.columns:
        particles = particles.withColumn("is_primary", primary_flag("barcode"))
    wanted = [c for c in dict.fromkeys([*features, "vx", "vy", "vz"]) if c in particles.columns and c != "particle_id"]
    filled = hits.withColumn("particle_id", F.coalesce("particle_id", F.lit(0).cast("bigint")))
    right = particles.select(E, "particle_id", *wanted)
    # Noise takes no part in the join; particles with very many hits are split in it.
    signal = filled.where("particle_id <> 0")
    if "nhits" not in wanted:
        counts = signal.groupBy(E, "particle_id").agg(F.count("*").alias("nhits"))
        right = counts.join(right, [E, "particle_id"], "left")
    joined = join_per_key(signal, right, [E, "particle_id"], "left")
    noise = filled.where("particle_id = 0").withColumn("nhits", F.lit(-1).cast("bigint"))
    return joined.unionByName(noise, allowMissingColumns=True)


def add_production_distance(hits: DataFrame) -> DataFrame:
    return hits.withColumn("big_r", distance("x", "y", "z", "vx", "vy", "vz"))
