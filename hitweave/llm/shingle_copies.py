"""Near copies by the Jaccard similarity of their word shingles.

Texts with the same set of five-word shingles are one node. 125 min-hashes of the set, five
to a band, give 25 keys; two sets of similarity 0.8 share none of them with a chance of
5 in 100,000. Nodes that share a key are brought together without listing their pairs:

* Every key draws one of its nodes, which is compared with the others: at most a pair for each
  node and key.
* Keys whose nodes are still in several components are compared in tasks. A task holds the sets
  of a key's nodes and counts what they have in common by products of blocks of their incidence
  matrix; what only one node has is left out before. A crowded key is dealt into parts of which
  any two meet in a group of their own; the nodes of its largest component, which need no
  comparison among themselves, meet the parts of the others only. A group yields at most a row
  for each of its nodes.

Every link is decided on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release
from .common import cut_lineage, join_many, join_small, row_key
from .components import component_labels
from .embedding_copies import join_roots
from .simhash_ring import keep_rows, near_duplicates
from .suffix_dedup import Hashed, Powers, _mixed

SHINGLE = 5
#: Least similarity as a fraction, so that the comparison is exact.
SIMILARITY = (4, 5)
BANDS, BAND_ROWS = 25, 5
#: Nodes of a part of a crowded key, and columns of a block of the incidence matrix.
CROWD, COLUMNS = 2048, 4096
CHUNK = 1 << 12
FACTORS = np.random.default_rng(42).integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(hashed: Hashed, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles; a shorter text is one shingle, a text without words has none."""
    size = min(shingle, hashed.n)
    return np.unique(hashed.runs(np.arange(hashed.n - size + 1), size)) if size else np.array([], dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), CHUNK):
        part = _mixed(shingles[at : at + CHUNK])
        least = np.minimum(least, (part[None, :] * FACTORS[:, None]).min(axis=1))
    each = _mixed(least + np.arange(len(FACTORS), dtype=np.uint64))
    return _mixed(each.reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64))


def _described(docs: DataFrame) -> DataFrame:
    """(row, doc_id, name, name_2, size, keys) of the rows (row, doc_id, text); two words name a set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            names, sizes, keys = ([], []), [], []
            for text in batch.column("text"):
                shingles = shingle_set(Hashed(text.as_py(), powers))
                for salt, name in enumerate(names):
                    mixed = _mixed(shingles ^ (np.uint64(salt) * FACTORS[0]))
                    name.append(int((mixed.sum(dtype=np.uint64) + np.uint64(len(shingles))).view(np.int64)))
                sizes.append(len(shingles))
                keys.append(band_keys(shingles).view(np.int64) if len(shingles) else [])
            own = [*(pa.array(n, pa.int64()) for n in names), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            columns = [batch.column("row"), batch.column("doc_id"), *own]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "name", "name_2", "size", "keys"])

    return docs.mapInArrow(run, "row bigint, doc_id bigint, name bigint, name_2 bigint, size int, keys array<bigint>")


def distinct_sets(described: DataFrame) -> DataFrame:
    """(node, name, name_2, row, size, keys): each set of shingles once, with a row that has it; written, so the numbers hold."""
    each = described.groupBy("name", "name_2").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    return cut_lineage(each.select(F.monotonically_increasing_id().alias("node"), "name", "name_2", "row", "size", "keys"))


def _sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            sets = [shingle_set(Hashed(t.as_py(), powers)).view(np.int64) for t in batch.column("text")]
            columns = [batch.column("node"), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def _sets_of(asked: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes ``asked``, written."""
    rows = cut_lineage(join_many(nodes.select("node", "row"), asked, ["node"]))
    return cut_lineage(_sets(join_small(docs, rows, ["row"], "inner")).dropDuplicates(["node"]))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose ``sets`` have the similarity, written."""
    p, q = SIMILARITY
    one = join_many(pairs, sets.toDF("a", "in_a"), ["a"])
    both = join_many(one, sets.toDF("b", "in_b"), ["b"])
    common, total = F.size(F.array_intersect("in_a", "in_b")), F.size("in_a") + F.size("in_b")
    return cut_lineage(both.where(common * (p + q) >= total * p).select("a", "b"))


def _close(x: Column, y: Column) -> Column:
    """Whether sets of these sizes can have the similarity."""
    p, q = SIMILARITY
    return F.least(x, y) * q >= F.greatest(x, y) * p


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _drawn(keyed: DataFrame) -> DataFrame:
    """(a, b): a node of each key beside the others of the key whose size allows the similarity."""
    of_key = F.min_by(F.struct("node", "size"), F.xxhash64("key", "node")).alias("m")
    met = join_many(keyed, keyed.groupBy("key").agg(of_key), ["key"])
    apart = met.where(F.col("node") != F.col("m.node")).where(_close(F.col("size"), F.col("m.size")))
    return apart.select(*_ordered(F.col("node"), F.col("m.node"))).distinct()


GROUP = ["key", "i", "j"]


def _dealt(placed: DataFrame, crowd: int) -> DataFrame:
    """(key, i, j, side, node, root): the groups in which the nodes of a key meet; j is -1 within a part.

    Parts of the largest component have numbers below 0 and meet only parts of the others.
    """
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "root"))
    shape = counts.groupBy("key").agg(largest["root"].alias("main"), largest["n"].alias("n_main"), F.sum("n").alias("n_all"))
    apart = F.col("n_main") > crowd  # a small component needs no parts of its own
    parts = lambda n: (F.floor(n / crowd) + 1).cast("int")
    shape = shape.select(
        "key",
        F.when(apart, F.col("main")).alias("main"),
        F.when(apart, parts(F.col("n_main"))).otherwise(F.lit(0)).alias("main_parts"),
        parts(F.when(apart, F.col("n_all") - F.col("n_main")).otherwise(F.col("n_all"))).alias("parts"),
    )
    rows = join_many(placed.select("key", "node", "root"), cut_lineage(shape), ["key"])
    is_main = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("main_parts")).otherwise(F.col("parts"))).cast("int")
    rows = rows.withColumns({"_main": is_main, "_own": own})
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.col("_own")
    with_others = F.transform(upto(F.col("parts")), lambda o: place(-1 - mine, o, 0))
    with_main = F.transform(upto(F.col("main_parts")), lambda o: place(-1 - o, mine, 1))
    lower = F.transform(upto(mine), lambda o: place(o, mine, 1))
    higher = F.transform(F.filter(upto(F.col("parts")), lambda o: o > mine), lambda o: place(mine, o, 0))
    among = F.concat(F.array(place(mine, F.lit(-1), 0)), lower, higher, with_main)
    return rows.select("key", "node", "root", F.inline(F.when(F.col("_main"), with_others).otherwise(among)))


def common_counts(shingles: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` has in common with each of ``right``."""
    sizes = np.array([len(x) for x in shingles])
    values, column, count = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    shared = count > 1
    kept = shared[column]
    row, column = np.repeat(np.arange(len(shingles)), sizes)[kept], (np.cumsum(shared) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    kind = np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64  # counts are exact in either
    out = np.zeros((len(left), len(right)), dtype=kind)
    for at in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, (at, at + COLUMNS)))
        held = np.zeros((len(shingles), COLUMNS), dtype=kind)
        held[row[part], column[part] - at] = 1
        out += held[left] @ held[right].T
    return out


def _linked_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of a partition sorted by group: each node beside the first one of its group that it reaches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch)
        if rest and _group(rest[-1], rest[-1].num_rows - 1) != _group(batch, 0):
            yield from _linked(pa.Table.from_batches(rest))
            rest = []
        if len(starts) > 1:
            last = int(starts[-1])
            yield from _linked(pa.Table.from_batches([*rest, batch.slice(0, last)]))
            rest, batch = [], batch.slice(last)
        rest.append(batch)
    if rest:
        yield from _linked(pa.Table.from_batches(rest))


def _starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for c in GROUP:
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _group(rows: pa.RecordBatch, at: int) -> tuple:
    return tuple(rows.column(c)[at].as_py() for c in GROUP)


def _linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    p, q = SIMILARITY
    rows = rows.combine_chunks()
    node, known, side, j = (rows.column(c).to_numpy() for c in ("node", "root", "side", "j"))
    lists = rows.column("shingles").combine_chunks()
    starts = _starts(rows)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
        if b - a < 2:
            continue
        shingles = [lists[k].values.to_numpy() for k in range(a, b)]
        sizes = rows.column("size").to_numpy()[a:b]
        left = right = np.arange(b - a)
        if j[a] >= 0:
            left, right = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
        if not len(left) or not len(right):
            continue
        alike = common_counts(shingles, left, right).astype(np.int64) * (p + q) >= (sizes[left][:, None] + sizes[right][None, :]) * p
        x, y = np.nonzero(alike & (known[a:b][left][:, None] != known[a:b][right][None, :]))
        root = np.arange(b - a)
        join_roots(root, left[x], right[y])
        moved = np.flatnonzero(root != np.arange(b - a))
        if len(moved):
            found.append((node[a:b][moved], node[a:b][root[moved]]))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])


def links_within_keys(placed: DataFrame, sets: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links whose components, with the known roots, are those of all alike pairs that share a key."""
    # A shingle that only one of the nodes has is in no intersection; its place counts in the size.
    listed = sets.select("node", F.explode("shingles").alias("shingle"))
    shared = listed.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    lists = join_many(listed, shared, ["shingle"]).groupBy("node").agg(F.collect_list("shingle").alias("shingles"))
    lists = cut_lineage(lists.join(sets.select("node", F.size("shingles").cast("bigint").alias("size")), "node"))
    rows = join_many(_dealt(placed, crowd), lists, ["node"])
    dealt = rows.select(*GROUP, "side", "node", "root", "size", "shingles").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(_linked_in_groups, "a bigint, b bigint").distinct()


def _placed(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """(key, node, size, root) of the keys whose nodes are in several components, written."""
    labels = cut_lineage(component_labels(links, "a", "b"))
    rooted = join_many(keyed, labels, ["node"], "left")
    rooted = cut_lineage(rooted.select("key", "node", "size", F.coalesce("root", "node").alias("root")))
    parted = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    left = cut_lineage(join_many(rooted, parted.select("key"), ["key"]))
    release(rooted)
    return left


def similar_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links of nodes whose components are those of all pairs of the similarity that share a key."""
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared_keys = cut_lineage(join_many(keyed, shared.select("key"), ["key"]))
    pairs = cut_lineage(_drawn(shared_keys))
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, nodes)
    links = _alike(pairs, sets)
    release(sets)
    placed = _placed(shared_keys, links)
    sets = _sets_of(placed.select("node").distinct(), docs, nodes)
    found = cut_lineage(links_within_keys(placed, sets))
    release(sets)
    return links.unionByName(found)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of ``docs`` with the least id of each component of near copies; a null id comes last.

    Two texts are linked if their shingles have the similarity or by the rule of
    :func:`near_duplicates`. Equal rows are one; texts without words are alike.
    """
    key = row_key(F.col(doc_id), F.col(text))
    listed = docs.select(key.alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    described = cut_lineage(_described(listed))
    nodes = distinct_sets(described)
    links = similar_links(listed.select("row", "text"), nodes)
    named = described.select("row", "doc_id", "name", "name_2").distinct()
    rows = cut_lineage(join_many(named, nodes.select("name", "name_2", "node"), ["name", "name_2"]).select("row", "doc_id", "node"))
    prints = near_duplicates(docs, doc_id, text).select("row", "component").distinct()
    linked = cut_lineage(rows.join(prints, "row").select("component", "node").distinct())
    least = linked.groupBy("component").agg(F.min("node").alias("b"))
    by_print = join_many(linked, least, ["component"]).select(F.col("node").alias("a"), "b").where("a <> b")
    labels = cut_lineage(component_labels(links.unionByName(by_print), "a", "b"))
    placed = join_many(rows, labels, ["node"], "left")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    kept = cut_lineage(placed.groupBy(F.coalesce("root", "node").alias("_of")).agg(best.alias("best")).select("best.doc_id", "best.row"))
    return keep_rows(docs, kept, doc_id, text)
