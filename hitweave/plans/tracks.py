"""Track building: components, simple paths, walkthrough, labels and evaluation in one chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components as CC
from ..operators import matching as MT
from ..operators.joins import E, endpoints
from ..operators.truth_edges import orient_outward
from ..operators.walk import walkthrough
from ..session import cut_lineage

METHODS = ("cc", "walk")


def first_track_per_hit(track_hits: DataFrame) -> DataFrame:
    """A hit keeps its first track: component tracks before walked ones, then the least id."""
    order = F.when(F.col("reco_method") == METHODS[0], 0).otherwise(1)
    first = F.min(F.struct(order.alias("o"), "track_id", "reco_method")).alias("_first")
    return track_hits.groupBy(E, "hit_id").agg(first).select(E, "hit_id", "_first.track_id", "_first.reco_method")


def label_hits(hits: DataFrame, track_hits: DataFrame) -> DataFrame:
    """All hits with the id of their track, -1 for none."""
    joined = hits.select(E, "hit_id").join(track_hits.select(E, "hit_id", "track_id"), [E, "hit_id"], "left")
    return joined.withColumn("track_id", F.coalesce("track_id", F.lit(-1).cast("bigint")))


def outward_graph(hits: DataFrame, edges: DataFrame, cut: float) -> DataFrame:
    """Edges above the cut, pointing outward, one per pair (of two the later id stays)."""
    kept = edges.where((F.col("score") > cut) & (F.col("src") != F.col("dst")))
    outward = orient_outward(kept.select(E, "edge_id", "src", "dst", "score"), hits, ties_by_id=True)
    return outward.groupBy(E, "src", "dst").agg(F.max_by("score", "edge_id").alias("score"))


def cc_and_walk(
    hits: DataFrame,
    edges: DataFrame,
    cut: float,
    low: float,
    add: float,
    cc_only: bool = False,
    on_true_graph: bool = False,
    **walk_options,
) -> DataFrame:
    """(event, hit_id, track_id, reco_method) of the hits on a track.

    Unbranched components of more than two hits are tracks; branched ones are walked,
    where a hit left alone is a track of its own. Track ids are a hit of the track.
    """
    if on_true_graph:
        edges, cut = edges.withColumn("score", F.col("y").cast("double")), 0.0
    graph = cut_lineage(outward_graph(hits, edges, cut))
    labels = cut_lineage(CC.component_labels(graph))
    shapes = CC.component_shapes(graph, labels)
    tracks, rest = CC.simple_path_tracks(graph, labels, shapes)
    found = tracks.withColumn("reco_method", F.lit("cc"))
    if not cc_only:
        walked = walkthrough(rest, low, add, **walk_options)
        found = found.unionByName(walked.withColumn("reco_method", F.lit("walk")))
    return first_track_per_hit(found)


def evaluate_tracks(
    labelled: DataFrame,
    track_edges: DataFrame,
    selection: dict,
    min_track_length: int = 1,
    fraction: float = 0.5,
    style: str = "purity",
    features: tuple[str, ...] = (),
) -> DataFrame:
    """Matched (track, particle) rows of all events."""
    reconstruction = MT.reconstruction_table(labelled, track_edges)
    particles = MT.particle_table(track_edges, selection, features)
    table = MT.matching_table(reconstruction, particles, selection, min_track_length)
    return MT.match(table, fraction, style)
