"""Connected components of score-cut graphs, and the tracks read off them.

Labels are the least hit id of a component. Each round is one grouping plus joins on
(event, node) over edge tables, written to the shared folder, so a component may be as
large as the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release
from .joins import E, endpoints, join_per_key

#: Hits of an event whose edges are dealt together, and edges that a task contracts at once.
BLOCK = 4096
BATCH = 1 << 18


def component_labels(edges: DataFrame) -> DataFrame:
    """(event, hit_id, component) of every hit on an edge between two hits, by alternating star contractions.

    Every node first points its greater neighbours, then its lesser ones, to its least
    neighbour. The number of rounds grows with the logarithm of the component size.
    Hub nodes are only ever grouped with a map-side minimum and joined back on their id.
    Before the rounds, tasks contract what they hold of the graph (:func:`_contracted`), so that a
    component whose edges met in one task takes part in the rounds as a finished star.
    """
    pairs = edges.where("src <> dst").select(
        E, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    )
    pairs = cut_lineage(_contracted(pairs))
    before = None
    while before != (before := _digest(pairs)):
        large = cut_lineage(_large_star(pairs))
        release(pairs)
        pairs = cut_lineage(_small_star(large))
        release(large)
    roots = pairs.select(E, F.col("u").alias("hit_id"), F.col("v").alias("component"))
    return roots.unionByName(
        roots.select(E, F.col("component").alias("hit_id"), "component").distinct()
    )


def _contracted(pairs: DataFrame) -> DataFrame:
    """(event, u, v) with the same components: in each batch of edges every node points to the least it is linked to there.

    Edges are dealt by event and by blocks of hits, so that a large event goes to many tasks.
    """
    block = F.floor(F.col("v") / BLOCK)
    dealt = pairs.repartition(E, block).sortWithinPartitions(E)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH:
                # The last event may go on: its star stays, so that an event met whole leaves as one star.
                stars = _stars(held)
                going_on = batch.column(E)[-1].as_py()
                last = stars.filter(pc.equal(stars.column(E), going_on))
                if 2 * last.num_rows > BATCH:
                    yield stars
                    held, n = [], 0
                else:
                    yield stars.filter(pc.not_equal(stars.column(E), going_on))
                    held, n = [last], last.num_rows
        if held:
            yield _stars(held)

    return dealt.mapInArrow(run, "event_id bigint, u bigint, v bigint")


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    event, u, v = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in (E, "u", "v"))
    events, of_event = np.unique(event, return_inverse=True)
    hits, of_hit = np.unique(np.concatenate([u, v]), return_inverse=True)
    # Nodes are numbered by event, then hit, so the least number is the least hit.
    nodes, ends = np.unique(np.concatenate([of_event, of_event]) * len(hits) + of_hit, return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while not np.array_equal(label[a], label[b]):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while not np.array_equal(label, label[label]):
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    ids = hits[nodes % max(1, len(hits))]
    columns = [events[nodes[moved] // max(1, len(hits))], ids[moved], ids[label[moved]]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [E, "u", "v"])


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every strictly greater neighbour of a node to the least of its neighbourhood."""
    both = pairs.select(E, F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        pairs.select(E, F.col("v").alias("a"), F.col("u").alias("b"))
    )
    least = both.groupBy(E, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = join_per_key(both.where("b > a"), least, [E, "a"])
    return moved.select(E, F.col("b").alias("u"), F.col("m").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link every lesser neighbour of a node, and the node, to the least of them."""
    least = pairs.groupBy(E, "u").agg(F.min("v").alias("m"))
    moved = join_per_key(pairs, least, [E, "u"]).where("v <> m")
    moved = moved.select(E, F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(E, "u", F.col("m").alias("v"))
    return moved.unionByName(own).distinct()


def _digest(pairs: DataFrame) -> tuple:
    """Count and order-free checksums of an edge set."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64(E, "u", "v")), F.bit_xor(F.xxhash64("v", "u", E))).first())


def connected_components(hits: DataFrame, edges: DataFrame, cut: float) -> DataFrame:
    """Every hit with its component over ``score > cut``; a hit without edges is its own."""
    labels = component_labels(edges.where(F.col("score") > cut))
    joined = hits.select(E, "hit_id").join(labels, [E, "hit_id"], "left")
    return joined.select(E, "hit_id", F.coalesce("component", "hit_id").alias("track_id"))


def weak_components(hits: DataFrame, edges: DataFrame, cut: float) -> DataFrame:
    """Same, but hits without edges get -1."""
    labels = component_labels(edges.where(F.col("score") > cut))
    joined = hits.select(E, "hit_id").join(labels, [E, "hit_id"], "left")
    return joined.select(E, "hit_id", F.coalesce("component", F.lit(-1).cast("bigint")).alias("track_id"))


def component_shapes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(event, component, n_hits, is_path): a path has no branching in either direction."""
    ends = endpoints(edges.select(E, "src", "dst").distinct())
    degree = ends.groupBy(E, "hit_id").agg(
        F.count_if(F.col("place") == 1).alias("n_in"), F.count_if(F.col("place") == 0).alias("n_out")
    )
    return (
        degree.join(labels, [E, "hit_id"])
        .groupBy(E, "component")
        .agg(F.count("*").alias("n_hits"), F.max(F.greatest("n_in", "n_out")).alias("_most"))
        .select(E, "component", "n_hits", (F.col("_most") <= 1).alias("is_path"))
    )


def simple_path_tracks(edges: DataFrame, labels: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(track hits, remaining edges).

    Unbranched components are taken out of the graph; those of more than two hits are tracks.
    """
    paths = shapes.where("is_path and n_hits > 2").select(E, "component")
    tracks = join_per_key(labels, paths, [E, "component"], "left_semi").select(E, "hit_id", F.col("component").alias("track_id"))
    branched = shapes.where("not is_path").select(E, "component")
    src = labels.select(E, F.col("hit_id").alias("src"), "component")
    rest = join_per_key(join_per_key(edges, src, [E, "src"]), branched, [E, "component"], "left_semi")
    return tracks, rest
