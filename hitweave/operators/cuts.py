"""Cuts on edges, nodes, scores and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import all_of, condition
from .joins import E, endpoints, gather, join_per_key, keep_both_endpoints
from .mapping import relink_after_filter
from .ranking import dense_index


def score_cut(edges: DataFrame, cut: float, keep: str = "at_least") -> DataFrame:
    """``at_least`` keeps score >= cut (classifier), ``above`` score > cut (track building)."""
    return edges.where(F.col("score") >= cut if keep == "at_least" else F.col("score") > cut)


def hard_edge_cut(edges: DataFrame, track_edges: DataFrame, conditions: dict) -> tuple[DataFrame, DataFrame]:
    """Passing track edges, and the edges both of whose ends lie on one."""
    passing = track_edges.where(all_of(conditions))
    nodes = endpoints(passing).select(E, "hit_id").distinct()
    kept = keep_both_endpoints(edges, nodes)
    return kept, relink_after_filter(passing, kept)


def hard_node_cut(hits: DataFrame, track_edges: DataFrame, conditions: dict) -> tuple[DataFrame, DataFrame]:
    """Nodes whose last written track edge passes every condition, renumbered 0..n-1.

    Track edges stay when both nodes stay; hits on no track edge go.
    """
    flags = {f"_c{i}": condition(k, v) for i, (k, v) in enumerate(conditions.items())}
    ends = endpoints(track_edges.withColumns(flags), "track_edge_id", *flags)
    last = F.max_by(F.struct(*flags), F.struct("place", "track_edge_id")).alias("_flags")
    decided = ends.groupBy(E, "hit_id").agg(last)
    passing = decided.where(" and ".join(f"_flags.{f}" for f in flags)).select(E, "hit_id")
    numbers = dense_index(passing, [E], "hit_id", "node_id")
    nodes = hits.join(numbers, [E, "hit_id"])
    src = numbers.select(E, F.col("hit_id").alias("src"), F.col("node_id").alias("node_src"))
    dst = numbers.select(E, F.col("hit_id").alias("dst"), F.col("node_id").alias("node_dst"))
    return nodes, join_per_key(join_per_key(track_edges, src, [E, "src"]), dst, [E, "dst"])


def background_cut(edges: DataFrame, hits: DataFrame, pt_cut: float) -> DataFrame:
    """Edges where some end belongs to a particle above the pt cut."""
    good = hits.select(E, "hit_id", ((F.col("pt") > pt_cut) & (F.col("particle_id") != 0)).alias("_good"))
    flagged = gather(edges, good.fillna(False, ["_good"]), ["_good"])
    return flagged.where("_good_src or _good_dst").drop("_good_src", "_good_dst")


def signal_pt_cut(signal: DataFrame, hits: DataFrame, pt_cut: float) -> DataFrame:
    """Signal edges whose ends both lie above the pt cut."""
    return keep_both_endpoints(signal, hits.where(F.col("pt") > pt_cut))


def pair_truth(edges: DataFrame, hits: DataFrame, signal: DataFrame) -> DataFrame:
    """``y_pid``: same non-noise particle; ``pid_signal``: also both ends on signal edges."""
    on_signal = endpoints(signal).select(E, "hit_id").distinct().withColumn("_signal", F.lit(True))
    marked = hits.select(E, "hit_id", "particle_id").join(on_signal, [E, "hit_id"], "left").fillna(False, ["_signal"])
    both = gather(edges, marked, ["particle_id", "_signal"])
    y_pid = (F.col("particle_id_src") == F.col("particle_id_dst")) & (F.col("particle_id_src") != 0)
    out = both.withColumn("y_pid", y_pid)
    out = out.withColumn("pid_signal", F.col("y_pid") & F.col("_signal_src") & F.col("_signal_dst"))
    return out.drop("particle_id_src", "particle_id_dst", "_signal_src", "_signal_dst")


def drop_isolated(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits that still have an edge."""
    return hits.join(endpoints(edges).select(E, "hit_id"), [E, "hit_id"], "left_semi")


def drop_large_events(edges: DataFrame, max_edges: int) -> DataFrame:
    """Edges of the events that have at most ``max_edges``; sizes come from a pre-aggregated count."""
    small = edges.groupBy(E).agg(F.count("*").alias("_n")).where(F.col("_n") <= max_edges)
    return join_per_key(edges, small.select(E), [E])
