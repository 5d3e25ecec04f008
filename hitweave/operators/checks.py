"""Data checks: each returns the offending rows or raises on a schema problem."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import write_graph
from .joins import E, endpoints


def check_columns(df: DataFrame, required: list[str], optional: list[str] = ()) -> None:
    """Missing required columns raise, missing optional ones warn; no job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    for name in optional:
        if name not in df.columns:
            warnings.warn(f"optional column {name} not found", stacklevel=2)


def events_with_unknown_nodes(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Events whose edges name a node number past the last node."""
    nodes = hits.groupBy(E).agg(F.count("*").alias("n_nodes"))
    ends = edges.groupBy(E).agg(F.max(F.greatest("src", "dst")).alias("max_node"))
    joined = ends.join(nodes, E, "left").withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0).cast("bigint")))
    return joined.where("max_node >= n_nodes").select(E, "n_nodes", "max_node")


def require_rows(tables: dict[str, DataFrame]) -> None:
    """Raise on the first table that has no row."""
    for name, df in tables.items():
        if df.isEmpty():
            raise ValueError(f"table {name} is empty")


def write_checked_graph(
    nodes: DataFrame, edges: DataFrame, track_edges: DataFrame, path: str, config: dict, datasets: list[str]
) -> dict[str, dict[str, int]]:
    """Write the graph and raise if a dataset has no row in a table or an edge has no weight.

    ``n_<dataset>`` are the rows of a dataset and ``without_<dataset>`` those that lack what the
    table needs: an id, or for edges a weight. The jobs that write count them, no other job runs.
    """
    needed = {"nodes": "hit_id", "edges": "weight", "track_edges": "track_edge_id"}
    checks = {}
    for table, column in needed.items():
        of = {d: F.col("dataset") == d for d in datasets}
        checks[table] = {f"n_{d}": holds for d, holds in of.items()}
        checks[table] |= {f"without_{d}": holds & F.col(column).isNull() for d, holds in of.items()}
    counted = write_graph(nodes, edges, track_edges, path, config, checks)
    for table, counts in counted.items():
        for d in datasets:
            if not counts[f"n_{d}"]:
                raise ValueError(f"table {table} of {d} is empty")
            if counts[f"without_{d}"]:
                raise ValueError(f"{counts[f'without_{d}']} rows of {table} in {d} have no {needed[table]}")
    return counted


def noise_on_track_edges(hits: DataFrame, track_edges: DataFrame) -> DataFrame:
    """Noise rows of hits that some track edge uses; must be empty."""
    used = endpoints(track_edges).select(E, "hit_id")
    return hits.where("particle_id = 0").join(used, [E, "hit_id"], "left_semi").select(E, "hit_id")


def shared_edges(edges: DataFrame) -> DataFrame:
    """Track edges per event that two particles share; should stay below 50."""
    pairs = edges.groupBy(E, "src", "dst").agg((F.count("*") - 1).alias("_more"))
    return pairs.groupBy(E).agg(F.sum("_more").alias("n_shared"))


def require_few_shared(edges: DataFrame, limit: int = 50) -> None:
    worst = shared_edges(edges).agg(F.max("n_shared")).first()[0]
    if worst is not None and worst >= limit:
        raise ValueError(f"an event has {worst} shared edges")
