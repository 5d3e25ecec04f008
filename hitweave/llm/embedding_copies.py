"""Near copies among embeddings by random hyperplanes, exact cosines and connected components.

Equal vectors are one node. The signs of a node's products with seeded random directions make
one key in each of several tables; nodes that share a key are compared by their cosine in
double precision. With some ``DENSITY`` nodes to a key the bits of a key follow the number of
nodes, and the number of tables follows from the bits: a pair whose cosine is just the
threshold shares no key with a chance of at most ``MISS``, closer pairs far more seldom.

Pairs are never written as rows. The task that holds a key's nodes multiplies them in blocks,
counts a pair only in the first table whose key both share, and gives each node its number of
links there and the least node that it reaches there. A key with more than ``CROWD`` nodes is
dealt into parts, of which any two meet in a group of their own, so no group outgrows a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_many
from .components import component_labels

THRESHOLD = 0.9
MISS = 0.002
DENSITY = 64
CROWD = 4096
SEED = 42
#: Products that a task holds at once, on each side.
BLOCK = 1024
#: Cosines this near to the threshold are decided by exact arithmetic.
DOUBT = 1e-9
WORD_BITS = 62


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS, density: int = DENSITY) -> tuple[int, int]:
    """(bits of a key, tables) for ``n`` vectors."""
    bits = min(WORD_BITS, max(1, math.ceil(math.log2(max(2, n / density)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same))) if same < 1 else 1


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square leaves the range of a double."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def table_keys(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """A row of ``tables`` keys for each vector."""
    directions = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (units(vectors) @ directions >= 0).reshape(len(vectors), tables, bits)
    return (signs * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2, dtype=np.int64)


def reaches(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the cosine is at least the threshold, decided without rounding."""
    x, y = ([Fraction(float(v)) for v in side] for side in (a, b))
    product = sum(p * q for p, q in zip(x, y))
    limit = Fraction(threshold) ** 2 * sum(p * p for p in x) * sum(q * q for q in y)
    return product * product >= limit if product >= 0 and threshold >= 0 else False


def close_pairs(vectors: np.ndarray, unit: np.ndarray, left: slice, right: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), i before j, of the two blocks whose cosine is at least the threshold."""
    cosine = unit[left] @ unit[right].T
    i, j = np.nonzero(cosine >= threshold - DOUBT)
    near = cosine[i, j]
    i, j = i + left.start, j + right.start
    ok = i < j
    for k in np.flatnonzero(ok & (near < threshold + DOUBT)).tolist():
        ok[k] = reaches(vectors[i[k]], vectors[j[k]], threshold)
    return i[ok], j[ok]


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Bring the rows of each pair under the least row that either reaches."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, high, low)
        while not np.array_equal(root, flat := root[root]):
            root[:] = flat


def group_links(vectors: np.ndarray, keys: np.ndarray, copies: np.ndarray, part: np.ndarray, table: int, crossed: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the rows of a group: linked copies of others, and the first row that each reaches.

    ``crossed`` groups compare rows of different parts only. A pair is counted if this is the
    first table whose keys both share.
    """
    unit, n = units(vectors), len(vectors)
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)
    for left in range(0, n, BLOCK):
        for right in range(left, n, BLOCK):
            i, j = close_pairs(vectors, unit, slice(left, left + BLOCK), slice(right, right + BLOCK), threshold)
            if crossed:
                across = part[i] != part[j]
                i, j = i[across], j[across]
            for at in range(0, len(i), BLOCK * 64):
                x, y = i[at : at + BLOCK * 64], j[at : at + BLOCK * 64]
                first = (keys[x, :table] != keys[y, :table]).all(axis=1)
                x, y = x[first], y[first]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                join_roots(root, x, y)
    return links, root


def _distinct(rows: DataFrame) -> DataFrame:
    """(node, vector, copies, least): the valid vectors, each once; written, so that the numbers of the nodes hold."""
    ok = F.col("vector").isNotNull() & (F.size("vector") > 0)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = rows.where(ok & finite & F.exists("vector", lambda x: x != 0))
    each = valid.groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return cut_lineage(each.select(F.monotonically_increasing_id().alias("node"), "vector", "copies", "least"))


def _keyed(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """The nodes with (dims, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            dims = pa.compute.list_value_length(vectors).to_numpy()
            out = np.zeros((batch.num_rows, tables), dtype=np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                out[at] = table_keys(_matrix(vectors.take(pa.array(at))), bits, tables, seed)
            keys = pa.ListArray.from_arrays(np.arange(0, out.size + 1, tables, dtype=np.int32), pa.array(out.ravel()))
            columns = [*(batch.column(c) for c in ("node", "vector", "copies")), pa.array(dims, pa.int32()), keys]
            yield pa.RecordBatch.from_arrays(columns, ["node", "vector", "copies", "dims", "keys"])

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.select("node", "vector", "copies").mapInArrow(run, f"node bigint, vector {kind}, copies bigint, dims int, keys array<bigint>")


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


GROUP = ["dims", "t", "key", "i", "j"]


def _link_groups(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within the groups of a partition sorted by group; a group may span batches."""
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch)
            if rest and _group(rest[-1], rest[-1].num_rows - 1) != _group(batch, 0):
                yield from linked(pa.Table.from_batches(rest))
                rest = []
            if len(starts) > 1:
                last = int(starts[-1])
                yield from linked(pa.Table.from_batches([*rest, batch.slice(0, last)]))
                rest, batch = [], batch.slice(last)
            rest.append(batch)
        if rest:
            yield from linked(pa.Table.from_batches(rest))

    def linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        column = {c: rows.column(c).to_numpy() for c in ("node", "copies", "part", *GROUP)}
        keys = rows.column("keys").combine_chunks()
        keys = keys.flatten().to_numpy().reshape(rows.num_rows, -1)
        vectors = rows.column("vector").combine_chunks()
        starts = _starts(rows)
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
            if b - a < 2:
                continue
            crossed = column["i"][a] != column["j"][a]
            links, root = group_links(
                _matrix(vectors.slice(a, b - a)), keys[a:b], column["copies"][a:b], column["part"][a:b], int(column["t"][a]), crossed, threshold
            )
            at = np.flatnonzero(links)
            if len(at):
                node = column["node"][a:b]
                found.append((node[at], links[at], node[root[at]]))
        if found:
            columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "links", "root"])

    return run


def _starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for c in GROUP:
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _group(rows: pa.RecordBatch, at: int) -> tuple:
    return tuple(rows.column(c)[at].as_py() for c in GROUP)


def node_links(nodes: DataFrame, bits: int, tables: int, threshold: float = THRESHOLD, crowd: int = CROWD, seed: int = SEED) -> DataFrame:
    """(node, links, root) per group of the nodes that have links there."""
    keyed = cut_lineage(_keyed(nodes, bits, tables, seed))
    placed = keyed.select("dims", "node", F.posexplode("keys").alias("t", "key"))
    parts = (F.floor(F.col("count") / (crowd / 2)) + 1).cast("int").alias("parts")
    crowded = cut_lineage(placed.groupBy("dims", "t", "key").count().where(F.col("count") > crowd).select("dims", "t", "key", parts))
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).cast("int")
    every = keyed.select("dims", "node", "vector", "copies", "keys", F.posexplode("keys").alias("t", "key"))
    marked = every.join(crowded, ["dims", "t", "key"], "left").withColumn("part", own)
    others = F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))
    meets = F.transform(others, lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    rows = marked.select("dims", "t", "key", "node", "vector", "copies", "keys", "part", F.inline(meets))
    dealt = rows.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(_link_groups(threshold), "node bigint, links bigint, root bigint")


def near_copies(
    embeddings: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    miss: float = MISS,
    crowd: int = CROWD,
    seed: int = SEED,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows are linked if the cosine of their vectors is at least ``threshold``, which must be above 0.
    Vectors that are null, empty or zero or hold a null or a non-finite component link with nothing,
    nor do vectors of different lengths. Repeated rows are vectors of their own, linked with each
    other. A null id is never a least id unless its whole component has none; it is not ``kept``.
    """
    rows = embeddings.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"))
    # -0.0 and 0.0 are one value.
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))
    nodes = _distinct(rows)
    bits, tables = plan(nodes.count(), threshold, miss)
    found = cut_lineage(node_links(nodes.select("node", "vector", "copies"), bits, tables, threshold, crowd, seed))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = component_labels(found.select("node", "root"), "node", "root")
    placed = nodes.select("node", "vector", "copies", "least").join(links, "node", "left").join(labels, "node", "left")
    component = F.coalesce("root", "node").alias("component")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    placed = cut_lineage(placed.select("vector", component, "least", n_links))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_vector = join_many(placed.select("vector", "component", "n_links"), least, ["component"])
    out = join_many(rows, of_vector.select("vector", "n_links", "component_id"), ["vector"], "left")
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    n_links = F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    return out.select("vec_id", n_links, component.alias("component_id"), kept)
