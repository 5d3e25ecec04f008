"""Walkthrough: greedy longest roads through scored, outward-pointing graphs.

From a starting hit a road follows, at every hit, the best-scored unused neighbour
(score above ``low``) and every further one above ``add``; of all roads the longest
is kept -- the last one, if several -- and its hits are used up. Starting hits are
taken in topological order: by generation (longest path from a source), then hit id.

All roads need not be listed: the length of the longest road from a hit is one more
than the greatest length among its next hits, and the last road among the longest
goes through the last such next hit. That is a sweep over the hits.

Two equal ways run it. Components with at most ``task_limit`` edges go whole into
one task each, many small ones at once (:func:`walk_components`). Larger ones run in rounds of joins
(:func:`walk_by_rounds`): in a round every starting hit is processed whose reachable
hits cannot be touched by any earlier starting hit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release
from .joins import E, endpoints, join_per_key

TASK_LIMIT = 200_000
#: Edges that a task walks at once.
BATCH = 1 << 16
TRACK_SCHEMA = "event_id bigint, hit_id bigint, track_id bigint"


# ---- one component in one task -------------------------------------------------
def generations(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Longest path length from a source, for nodes 0..n-1 of an acyclic graph."""
    level = np.zeros(n, dtype=np.int64)
    by_src = np.argsort(src, kind="stable")
    ends, first = dst[by_src], np.searchsorted(src[by_src], np.arange(n + 1))
    waits = np.bincount(dst, minlength=n)
    free, done = np.flatnonzero(waits == 0), 0
    while len(free):
        done += len(free)
        counts = first[free + 1] - first[free]
        out = np.repeat(first[free] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        np.subtract.at(waits, ends[out], 1)
        reached = np.unique(ends[out])
        at = level[free[0]] + 1
        free = reached[waits[reached] == 0]
        level[free] = at
    if done < n:
        raise ValueError("graph has a directed cycle")
    return level


def walk_arrays(src: np.ndarray, dst: np.ndarray, score: np.ndarray, low: float, add: float) -> list[list[int]]:
    """Roads as lists of hit ids, in the order they are found."""
    nodes = np.unique(np.concatenate([src, dst]))
    s, d = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    n = len(nodes)
    level = generations(s, d, n)
    order = np.lexsort((nodes, level))
    # Neighbours of a node, best score first, ties by hit id.
    by_choice = np.lexsort((d, -score, s))
    # Plain lists from here on: single elements of arrays are slow to read.
    first = np.searchsorted(s[by_choice], np.arange(n + 1)).tolist()
    ends, scores = d[by_choice].tolist(), score[by_choice].tolist()
    order, level, names = order.tolist(), level.tolist(), nodes.tolist()
    used, length, choice = [False] * n, [1] * n, [-1] * n
    parents: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(s.tolist(), d.tolist()):
        parents[b].append(a)

    def settle(v: int) -> bool:
        """Recompute the longest road from v; tells whether anything changed."""
        best, pick, taken = 0, -1, False
        for e in range(first[v], first[v + 1]):
            w = ends[e]
            if used[w]:
                continue
            if not taken:
                if scores[e] <= low:
                    break
                taken = True
            elif scores[e] <= add:
                break
            if length[w] >= best:
                best, pick = length[w], w
        changed = best + 1 != length[v] or pick != choice[v]
        length[v], choice[v] = best + 1, pick
        return changed

    for v in order[::-1]:
        settle(v)
    roads = []
    for start in order:
        if used[start]:
            continue
        road, v = [], start
        while v >= 0:
            road.append(v)
            v = choice[v]
        for v in road:
            used[v] = True
        roads.append([names[v] for v in road])
        # Used hits change the choices of their unused ancestors, deepest first.
        touched = {p for v in road for p in parents[v] if not used[p]}
        queue = [(-level[p], p) for p in touched]
        heapq.heapify(queue)
        while queue:
            _, v = heapq.heappop(queue)
            touched.discard(v)
            if settle(v):
                for p in parents[v]:
                    if not used[p] and p not in touched:
                        touched.add(p)
                        heapq.heappush(queue, (-level[p], p))
    return roads


def walk_components(edges: DataFrame, low: float, add: float, batch_edges: int = BATCH) -> DataFrame:
    """(event, hit_id, track_id) of components that go whole into a task; many small ones are walked at once."""
    dealt = edges.select(E, "component", "src", "dst", "score").repartition(E, "component").sortWithinPartitions(E, "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= batch_edges:
                table = pa.Table.from_batches(held)
                keys = [table.column(c).to_numpy() for c in (E, "component")]
                whole = int(((keys[0] != keys[0][-1]) | (keys[1] != keys[1][-1])).sum())
                if whole:
                    yield _walk_batch(table.slice(0, whole), low, add)
                    table = table.slice(whole)
                held, n = table.to_batches(), 0  # the last component may go on; it is looked at again after another batch
        if held:
            yield _walk_batch(pa.Table.from_batches(held), low, add)

    return dealt.mapInArrow(run, TRACK_SCHEMA)


def _walk_batch(edges: pa.Table, low: float, add: float) -> pa.RecordBatch:
    event, src, dst = (edges.column(c).to_numpy() for c in (E, "src", "dst"))
    events, of_event = np.unique(event, return_inverse=True)
    hits, of_hit = np.unique(np.concatenate([src, dst]), return_inverse=True)
    # Hits are numbered by event, then id, so that ties go to the least id as within one event.
    a, b = of_event * len(hits) + of_hit[: len(src)], of_event * len(hits) + of_hit[len(src) :]
    roads = walk_arrays(a, b, edges.column("score").to_numpy().astype(float), low, add)
    walked = np.array([h for road in roads for h in road], dtype=np.int64)
    # A road is named by its first hit, which no other road holds.
    names = np.repeat(np.array([road[0] for road in roads], dtype=np.int64), [len(road) for road in roads])
    m = max(1, len(hits))
    columns = [events[walked // m], hits[walked % m], hits[names % m]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [E, "hit_id", "track_id"])


# ---- large components in rounds of joins ---------------------------------------
def spread_extreme(values: DataFrame, edges: DataFrame, start: str, end: str, column: str, greatest: bool) -> DataFrame:
    """Push a value along edges from ``start`` to ``end`` until nothing changes, keeping the extreme."""
    pick, agg = (F.greatest, F.max) if greatest else (F.least, F.min)
    step = 1 if greatest else 0
    values = cut_lineage(values)
    limit = values.count() if greatest else None
    step_no = 0
    while True:
        step_no += 1
        if limit is not None and step_no > limit + 1:
            raise ValueError("graph has a directed cycle")
        sent = (
            join_per_key(
                edges.select(E, F.col(start).alias("hit_id"), F.col(end).alias("_to")),
                values.select(E, "hit_id", column),
                [E, "hit_id"],
            )
            .groupBy(E, F.col("_to").alias("hit_id"))
            .agg(agg(F.col(column) + step if greatest else F.col(column)).alias("_new"))
        )
        moved = values.drop("_changed").join(sent, [E, "hit_id"], "left")
        best = F.coalesce(pick(F.col(column), F.col("_new")), F.col(column))
        moved = cut_lineage(moved.withColumn("_changed", best != F.col(column)).withColumn(column, best).drop("_new"))
        release(values)
        values = moved
        if not moved.where("_changed").head(1):
            return moved.drop("_changed")


def _chosen_edges(edges: DataFrame, low: float, add: float) -> DataFrame:
    """Edges a road may follow: the best of a hit above ``low``, and all others above ``add``.

    ``rank`` orders the choices of a hit, best first.
    """
    best = edges.groupBy(E, "src").agg(F.max(F.struct("score", (-F.col("dst")).alias("d"))).alias("_best"))
    joined = join_per_key(edges, best, [E, "src"]).where(F.col("_best.score") > low)
    is_best = (F.col("dst") == -F.col("_best.d"))
    return joined.where(is_best | (F.col("score") > add)).select(E, "src", "dst", "score")


def _road_lengths(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes with the length of their longest road and the next hit on its last one."""
    lengths = nodes.select(E, "hit_id", F.lit(1).cast("bigint").alias("length"))
    lengths = spread_extreme(lengths, chosen, "dst", "src", "length", True)
    after = lengths.select(E, F.col("hit_id").alias("dst"), F.col("length").alias("_next"))
    # Among the next hits of greatest length the last in choice order: least score, greatest id.
    last = F.max_by(F.col("dst"), F.struct("_next", (-F.col("score")).alias("s"), "dst")).alias("next")
    picked = join_per_key(chosen, after, [E, "dst"]).groupBy(E, F.col("src").alias("hit_id")).agg(last)
    return lengths.join(picked, [E, "hit_id"], "left")


def walk_by_rounds(edges: DataFrame, low: float, add: float) -> DataFrame:
    """(event, hit_id, track_id) by rounds; any component size."""
    edges = cut_lineage(edges.select(E, "src", "dst", "score"))
    nodes = endpoints(edges).select(E, "hit_id").distinct()
    level = spread_extreme(nodes.withColumn("level", F.lit(0).cast("bigint")), edges, "src", "dst", "level", True)
    nodes = cut_lineage(level.withColumn("turn", F.struct("level", "hit_id")))
    result = None
    while True:
        usable = edges.where((F.col("score") > low) | (F.col("score") > add))
        earliest = spread_extreme(nodes.select(E, "hit_id", "turn"), usable, "src", "dst", "turn", False)
        reached = spread_extreme(earliest, usable, "dst", "src", "turn", False)
        # A hit may start when nothing it can reach is reachable from an earlier hit.
        starts = reached.where("turn.hit_id = hit_id").select(E, "hit_id")
        chosen = cut_lineage(_chosen_edges(usable, low, add))
        steps = cut_lineage(_road_lengths(nodes.select(E, "hit_id"), chosen))
        front = starts.select(E, "hit_id", F.col("hit_id").alias("track_id"))
        taken = front
        while True:
            front = cut_lineage(
                front.join(steps.select(E, "hit_id", "next"), [E, "hit_id"])
                .where("next is not null")
                .select(E, F.col("next").alias("hit_id"), "track_id")
            )
            if not front.head(1):
                break
            taken = taken.unionByName(front)
        taken = cut_lineage(taken)
        result = taken if result is None else result.unionByName(taken)
        used = taken.select(E, "hit_id")
        nodes = cut_lineage(nodes.join(used, [E, "hit_id"], "left_anti"))
        if not nodes.head(1):
            return result
        free = join_per_key(edges, used.toDF(E, "src"), [E, "src"], "left_anti")
        edges = cut_lineage(join_per_key(free, used.toDF(E, "dst"), [E, "dst"], "left_anti"))


def walkthrough(edges: DataFrame, low: float, add: float, task_limit: int = TASK_LIMIT) -> DataFrame:
    """(event, hit_id, track_id) over edges that carry their ``component``."""
    # An edge without a score (null or NaN) is no edge a road may follow, yet keeps its hits.
    score = F.when(~F.isnan("score"), F.col("score"))
    edges = cut_lineage(edges.select(E, "component", "src", "dst", F.coalesce(score, F.lit(float("-inf"))).alias("score")))
    large = edges.groupBy(E, "component").count().where(F.col("count") > task_limit).select(E, "component")
    large = cut_lineage(large)
    if not large.head(1):
        return walk_components(edges, low, add)
    small = join_per_key(edges, large, [E, "component"], "left_anti")
    walked = walk_components(small, low, add)
    return walked.unionByName(walk_by_rounds(join_per_key(edges, large, [E, "component"], "left_semi"), low, add))
