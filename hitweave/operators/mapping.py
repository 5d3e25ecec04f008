"""Values moved between hits, edges and track edges.

Edges carry ``edge_id``; track edges carry ``track_edge_id`` and the nullable
``edge_id`` of the equal edge. The kind of a value is the table it lives in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import E, endpoints, gather

PAIR = {
    "mean": lambda a, b: (a + b) / 2,
    "sum": lambda a, b: a + b,
    "max": F.greatest,
    "min": F.least,
    "any": lambda a, b: a | b,
    "all": lambda a, b: a & b,
}
GROUP: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


# ---- intersection of the built and the true graph ------------------------------
def unique_pairs(edges: DataFrame, id_column: str) -> DataFrame:
    """One row per (src, dst): the least id."""
    return edges.groupBy(E, "src", "dst").agg(F.min(id_column).alias(id_column))


def intersect_graphs(
    edges: DataFrame, track_edges: DataFrame, unique_pred: bool = True, unique_truth: bool = True
) -> DataFrame:
    """Full outer match of both edge lists: a null id means the edge is missing on that side."""
    pred = edges.select(E, "src", "dst", "edge_id")
    true = track_edges.select(E, "src", "dst", "track_edge_id")
    if not unique_pred:
        pred = unique_pairs(pred, "edge_id")
    if not unique_truth:
        true = unique_pairs(true, "track_edge_id")
    return pred.join(true, [E, "src", "dst"], "full_outer")


def label_edges(edges: DataFrame, track_edges: DataFrame) -> DataFrame:
    """Edges with ``y`` and the ``track_edge_id`` they equal (null for fakes)."""
    true = unique_pairs(track_edges, "track_edge_id")
    return edges.join(true, [E, "src", "dst"], "left").withColumn("y", F.col("track_edge_id").isNotNull())


def link_track_edges(track_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """Track edges with the ``edge_id`` they equal (null when not built)."""
    pred = unique_pairs(edges, "edge_id")
    return track_edges.drop("edge_id").join(pred, [E, "src", "dst"], "left")


def relink_after_filter(track_edges: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """Drop links to edges that a filter removed; ids stay as they were."""
    kept = kept_edges.select(E, "edge_id", F.lit(True).alias("_kept"))
    joined = track_edges.join(kept, [E, "edge_id"], "left")
    return joined.withColumn("edge_id", F.when(F.col("_kept"), F.col("edge_id"))).drop("_kept")


# ---- the six mappings ----------------------------------------------------------
def nodes_to_edges(edges: DataFrame, hits: DataFrame, column: str, aggr: str | None = None) -> DataFrame:
    """Hit value at both ends, or the two combined; serves track edges as well."""
    both = gather(edges, hits, [column])
    if aggr is None:
        return both
    src, dst = F.col(f"{column}_src"), F.col(f"{column}_dst")
    return both.withColumn(column, PAIR[aggr](src, dst)).drop(f"{column}_src", f"{column}_dst")


def _write_last(hits: DataFrame, edges: DataFrame, column: str, order: str) -> DataFrame:
    """Value written to both ends; dst writes come after src writes, higher ids after lower ones."""
    ends = endpoints(edges, column, order)
    last = ends.groupBy(E, "hit_id").agg(F.max_by(column, F.struct("place", order)).alias(column))
    return hits.drop(column).join(last, [E, "hit_id"], "left").withColumn(column, _zero(column, edges))


def _zero(column: str, like: DataFrame) -> Column:
    zero = F.lit(False) if like.schema[column].dataType.simpleString() == "boolean" else F.lit(0)
    return F.coalesce(column, zero)


def edges_to_nodes(hits: DataFrame, edges: DataFrame, column: str, aggr: str | None = None) -> DataFrame:
    """Without ``aggr`` the last write wins at both ends; with it values gather at dst only. Default 0."""
    if aggr is None:
        return _write_last(hits, edges, column, "edge_id")
    at_dst = edges.groupBy(E, F.col("dst").alias("hit_id")).agg(GROUP[aggr](column).alias(column))
    return hits.drop(column).join(at_dst, [E, "hit_id"], "left").withColumn(column, F.coalesce(column, F.lit(0)))


def tracks_to_nodes(hits: DataFrame, track_edges: DataFrame, column: str, aggr: str | None = None) -> DataFrame:
    """Without ``aggr`` the last write wins; with it values gather at both ends. Default 0."""
    if aggr is None:
        return _write_last(hits, track_edges, column, "track_edge_id")
    ends = endpoints(track_edges, column).groupBy(E, "hit_id").agg(GROUP[aggr](column).alias(column))
    return hits.drop(column).join(ends, [E, "hit_id"], "left").withColumn(column, F.coalesce(column, F.lit(0)))


def tracks_to_edges(edges: DataFrame, track_edges: DataFrame, columns: list[str]) -> DataFrame:
    """Track-edge values on the equal edge; 0 or false where there is none."""
    values = F.max_by(F.struct(*columns), F.col("track_edge_id")).alias("_values")
    linked = track_edges.where("edge_id is not null").groupBy(E, "edge_id").agg(values)
    joined = edges.drop(*columns).join(linked.select(E, "edge_id", "_values.*"), [E, "edge_id"], "left")
    return joined.withColumns({c: _zero(c, track_edges) for c in columns})


def edges_to_tracks(track_edges: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """Edge value on the equal track edge; null where the edge was not built."""
    return track_edges.drop(column).join(edges.select(E, "edge_id", column), [E, "edge_id"], "left")


def edges_to_reversed(undirected: DataFrame, directed: DataFrame, column: str) -> DataFrame:
    """Value of a directed edge repeated for both directions."""
    pair = [F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi")]
    value = directed.groupBy(E, *pair).agg(F.max_by(column, "edge_id").alias(column))
    keyed = undirected.drop(column).withColumns({"_lo": F.least("src", "dst"), "_hi": F.greatest("src", "dst")})
    return keyed.join(value, [E, "_lo", "_hi"], "left").drop("_lo", "_hi")


def map_values(
    column: str,
    source: str,
    target: str,
    hits: DataFrame | None = None,
    edges: DataFrame | None = None,
    track_edges: DataFrame | None = None,
    aggr: str | None = None,
) -> DataFrame:
    """Move ``column`` from one kind of table (``node``, ``edge``, ``track``) to another."""
    tables = {"node": hits, "edge": edges, "track": track_edges}
    if source == target:
        return tables[source]
    moves = {
        ("node", "edge"): lambda: nodes_to_edges(edges, hits, column, aggr),
        ("node", "track"): lambda: nodes_to_edges(track_edges, hits, column, aggr),
        ("edge", "node"): lambda: edges_to_nodes(hits, edges, column, aggr),
        ("track", "node"): lambda: tracks_to_nodes(hits, track_edges, column, aggr),
        ("track", "edge"): lambda: tracks_to_edges(edges, track_edges, [column]),
        ("edge", "track"): lambda: edges_to_tracks(track_edges, edges, column),
    }
    if (source, target) not in moves:
        raise ValueError(f"no mapping from {source} to {target}")
    return moves[(source, target)]()


def mark_true_nodes(hits: DataFrame, track_edges: DataFrame) -> DataFrame:
    """``y_node``: the hit lies on a track edge."""
    on_track = endpoints(track_edges).select(E, "hit_id").distinct().withColumn("_on", F.lit(True))
    joined = hits.join(on_track, [E, "hit_id"], "left")
    return joined.withColumn("y_node", F.coalesce("_on", F.lit(False))).drop("_on")


def bundle_to_edges(
    edges: DataFrame, hits: DataFrame, track_edges: DataFrame, node_columns: list[str], track_columns: list[str]
) -> DataFrame:
    """Endpoint means of node values and track-edge values on every kept edge."""
    both = gather(edges, hits, node_columns)
    means = {c: (F.col(f"{c}_src") + F.col(f"{c}_dst")) / 2 for c in node_columns}
    bundled = both.withColumns(means).drop(*[f"{c}_{s}" for c in node_columns for s in ("src", "dst")])
    return tracks_to_edges(bundled, relink_after_filter(track_edges, edges), track_columns)
