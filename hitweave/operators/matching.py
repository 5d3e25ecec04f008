"""Matching of track candidates to true particles, and the summary of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import fiducial
from .joins import E, endpoints

EXTRA = 1e-6


def reconstruction_table(labelled: DataFrame, track_edges: DataFrame) -> DataFrame:
    """(event, hit, track, particle): the particle comes from the track edges through the hit.

    A dst entry overwrites a src entry, a later track edge an earlier one; no
    entry gives particle 0. Track -1 rows stay.
    """
    ends = endpoints(track_edges, "particle_id", "track_edge_id")
    last = ends.groupBy(E, "hit_id").agg(F.max_by("particle_id", F.struct("place", "track_edge_id")).alias("particle_id"))
    rows = labelled.select(E, "hit_id", "track_id").join(last, [E, "hit_id"], "left")
    return rows.withColumn("particle_id", F.coalesce("particle_id", F.lit(0).cast("bigint")))


def particle_table(track_edges: DataFrame, selection: dict, features: tuple[str, ...] = ()) -> DataFrame:
    """One row per particle: pt, the columns the selection needs, and ``features``."""
    wanted = dict.fromkeys(["pt", *[k for k in selection if k != "n_true_hits"], *features])
    values = F.min_by(F.struct(*wanted), "track_edge_id").alias("_values")
    return track_edges.groupBy(E, "particle_id").agg(values).select(E, "particle_id", "_values.*")


def matching_table(
    reconstruction: DataFrame, particles: DataFrame, selection: dict, min_track_length: int = 1
) -> DataFrame:
    """One row per (track, particle) that share hits, with lengths and selections."""
    shared = reconstruction.groupBy(E, "track_id", "particle_id").agg(F.count("*").alias("n_shared"))
    reco = shared.groupBy(E, "track_id").agg(F.sum("n_shared").alias("n_reco_hits"))
    true = reconstruction.groupBy(E, "particle_id").agg(F.count_distinct("hit_id").alias("n_true_hits"))
    rows = (
        shared.join(reco, [E, "track_id"], "left")
        .join(true, [E, "particle_id"], "left")
        .join(particles, [E, "particle_id"], "left")
    )
    return rows.withColumns(
        {"is_matchable": F.col("n_reco_hits") >= min_track_length, "is_reconstructable": fiducial(selection)}
    )


def match(table: DataFrame, fraction: float = 0.5, style: str = "purity") -> DataFrame:
    """Purity, efficiency and the verdict; 0.5 is raised a little so that no track matches twice.

    Styles: ``purity`` judges both sides by purity, ``one_way`` the track by purity and
    the particle by efficiency, ``two_way`` both by both.
    """
    if fraction < 0.5:
        raise ValueError("matching fraction must be at least 0.5")
    limit = fraction + EXTRA if fraction == 0.5 else fraction
    out = table.withColumns(
        {
            "purity_reco": F.col("n_shared") / F.col("n_reco_hits"),
            "eff_true": F.col("n_shared") / F.col("n_true_hits"),
        }
    )
    pure: Column = F.col("purity_reco") >= limit
    whole: Column = F.col("eff_true") >= limit
    verdicts = {"purity": (pure, pure), "one_way": (pure, whole), "two_way": (pure & whole, pure & whole)}
    if style not in verdicts:
        raise ValueError(f"unknown matching style {style}")
    matched, reconstructed = verdicts[style]
    return out.withColumns({"is_matched": matched, "is_reconstructed": reconstructed})


def tracking_summary(matched: DataFrame) -> DataFrame:
    """One row of counts and rates over all events, in one pass per distinct key."""
    usable = F.col("is_reconstructable") & F.col("is_reconstructed") & F.col("is_matchable")
    by_particle = matched.groupBy(E, "particle_id").agg(
        F.bool_or("is_reconstructable").alias("p"), F.bool_or(usable).alias("r"), F.count_if(usable).alias("rows")
    )
    particles = by_particle.agg(
        F.count_if("p").alias("n_particles"),
        F.count_if("r").alias("n_reconstructed_particles"),
        F.sum("rows").alias("_rows"),
    )
    by_track = matched.where("is_matchable").groupBy(E, "track_id").agg(F.bool_or("is_matched").alias("m"))
    tracks = by_track.agg(F.count("*").alias("n_tracks"), F.count_if("m").alias("n_matched_tracks"))
    # Two one-row tables meet on a constant key.
    one = particles.withColumn("_k", F.lit(1)).join(tracks.withColumn("_k", F.lit(1)), "_k").drop("_k")
    n = {c: F.col(c) for c in ("n_particles", "n_reconstructed_particles", "n_tracks", "n_matched_tracks")}
    duplicates = F.col("_rows") - n["n_reconstructed_particles"]
    return one.select(
        *n.values(),
        duplicates.alias("n_duplicates"),
        F.try_divide(n["n_reconstructed_particles"], n["n_particles"]).alias("efficiency"),
        (1 - F.try_divide(n["n_matched_tracks"], n["n_tracks"])).alias("fake_rate"),
        F.try_divide(duplicates, n["n_reconstructed_particles"]).alias("duplication_rate"),
    )


def reconstructed_particles(matched: DataFrame, features: list[str]) -> DataFrame:
    """One row per reconstructable particle: was it reconstructed by any track?"""
    return (
        matched.where("is_reconstructable")
        .groupBy(E, "particle_id")
        .agg(*[F.min(f).alias(f) for f in features], F.bool_or("is_reconstructed").alias("is_reconstructed"))
    )
