"""Compositions: embedding graphs and the preprocessing chains before scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.inference import Mlp, embed_udf
from ..functions.vectors import l2_normalise, stack
from ..operators import cuts as C
from ..operators import edge_tables as ET
from ..operators import mapping as M
from ..operators.joins import E
from ..operators.neighbours import radius_neighbours
from ..operators.ranking import pair_index
from ..operators.truth_edges import orient_outward
from ..operators.weighting import weight_edges
from ..session import cut_lineage


def embedding_graph(
    hits: DataFrame,
    features: list[str],
    network: Mlp,
    dims: int,
    track_edges: DataFrame,
    rules: list[dict],
    r: float,
    k: int,
    undirected: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(edges, track_edges): hits embedded, joined to their neighbours, labelled and weighted."""
    raw = hits.select(E, "hit_id", embed_udf(network)(stack(features)).alias("_raw"))
    embedded = cut_lineage(raw.select(E, "hit_id", l2_normalise("_raw").alias("embedding")))
    edges = cut_lineage(radius_neighbours(embedded, "embedding", dims, r, k))
    edges = cut_lineage(pair_index(edges, E, "edge_id"))
    true = track_edges
    if undirected:
        back = track_edges.withColumns(
            {"src": F.col("dst"), "dst": F.col("src"), "track_edge_id": -1 - F.col("track_edge_id")}
        )
        true = track_edges.unionByName(back)
    labelled = M.label_edges(edges, true)
    weighted = weight_edges(labelled, rules, M.link_track_edges(true, labelled))
    if not undirected:
        return weighted, M.link_track_edges(track_edges, weighted)
    return ET.undirected_unique(weighted, track_edges)


def prepare_edges(
    hits: DataFrame,
    edges: DataFrame,
    track_edges: DataFrame,
    hard_cuts: dict | None = None,
    rules: list[dict] | None = None,
    input_cut: float | None = None,
    scales: dict[str, float] | None = None,
    features: list[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base chain: hard cut, weights, score cut, edge features, scaling."""
    if hard_cuts:
        edges, track_edges = C.hard_edge_cut(edges, track_edges, hard_cuts)
    if rules:
        edges = weight_edges(edges, rules, track_edges, hits)
    else:
        edges = edges.withColumn("weight", F.lit(1.0))
    if input_cut:
        edges = C.score_cut(edges, input_cut)
        track_edges = M.relink_after_filter(track_edges, edges)
    scaled = ET.scale(hits, scales) if scales else hits
    if features:
        edges = ET.add_edge_features(edges, hits, list(features))
    return scaled, edges, track_edges


def prepare_heterogeneous(
    hits: DataFrame,
    edges: DataFrame,
    track_edges: DataFrame,
    groups: list[dict],
    node_features: list[str],
    undirected: bool = False,
    directed: bool = False,
    node_truth: bool = False,
    **base,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed chain: optional reversal first, base chain, optional direction or node truth, then types."""
    if undirected:
        edges, track_edges = ET.to_undirected(edges), ET.to_undirected(track_edges)
    scaled, edges, track_edges = prepare_edges(hits, edges, track_edges, **base)
    if directed:
        edges = orient_outward(edges, scaled)
        track_edges = orient_outward(track_edges, scaled)
    if node_truth:
        scaled = M.mark_true_nodes(scaled, track_edges)
    typed = ET.add_node_type(scaled.withColumn("features", stack(node_features)), groups)
    return typed, ET.add_edge_type(edges, typed), track_edges


def prepare_metric(
    hits: DataFrame, track_edges: DataFrame, hard_cuts: dict, scales: dict[str, float]
) -> tuple[DataFrame, DataFrame]:
    """Chain before an embedding: node cut, scaling."""
    nodes, tracks = C.hard_node_cut(hits, track_edges, hard_cuts)
    return ET.scale(nodes, scales), tracks


def prepare_tracks(
    edges: DataFrame, track_edges: DataFrame, hard_cuts: dict, rules: list[dict]
) -> tuple[DataFrame, DataFrame]:
    """Chain before track building: hard cut, weights."""
    kept, tracks = C.hard_edge_cut(edges, track_edges, hard_cuts)
    return weight_edges(kept, rules, tracks), tracks
