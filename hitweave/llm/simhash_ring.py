"""SimHash near-dedup with pigeonring filtering.

The 64 bits of a fingerprint are a ring of 8 segments. If two fingerprints differ in at
most 3 bits, some segment starts a chain whose first l segments differ, for every l, in at
most 3 l / 8 bits: two equal segments, then at most one differing bit up to the fifth
segment, two up to the seventh. So a pair shares, for that start, the first two segments
and two of the next three: 24 keys of 32 bits find every pair. Pairs within a key are
tested on the whole chain, then on the full distance.

Only distinct fingerprints are compared. A key's rows never become pairs in a table: the
task that holds them links each fingerprint to the least one it reaches there. Keys with
more than ``crowd`` fingerprints are first divided by 56 further keys, five equal nibbles
of the eight that are left, after which at most 4096 distinct fingerprints can share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_many, row_key
from .components import component_labels

SHINGLE = 3
DISTANCE = 3
SEGMENTS = 8
CROWD = 4096
CHUNK = 1 << 16
SEGMENT_BITS = 64 // SEGMENTS
#: Bits that the first l segments of a viable chain may differ in, for l = 1 .. 8.
BUDGET = [length * DISTANCE // SEGMENTS for length in range(1, SEGMENTS + 1)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42); 0 without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(tokens))
    first, last = starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], 42) for i, j in zip(first, last)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, fingerprint as bigint) of every row; ``row`` is its :func:`row_key`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "fingerprint"])

    key = row_key(F.col(doc_id), F.col(text)).alias("row")
    rows = docs.select(key, F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "row bigint, doc_id bigint, fingerprint bigint")


def _mask(segments: tuple[int, ...]) -> int:
    bits = sum(((1 << SEGMENT_BITS) - 1) << (s * SEGMENT_BITS) for s in segments)
    return bits - (1 << 64) if bits >> 63 else bits


def _keys() -> list[tuple[int, tuple[int, ...]]]:
    """(chain start, segments kept) of the 24 keys."""
    out = []
    for start in range(SEGMENTS):
        ring = [(start + i) % SEGMENTS for i in range(5)]
        out += [(start, (ring[0], ring[1], *pair)) for pair in combinations(ring[2:], 2)]
    return out


KEYS = _keys()
#: Per key, the masks of the 56 finer keys: five of the eight nibbles that the key leaves free.
FINER = [
    [
        sum(0xF << (4 * nibble) for nibble in kept)
        for kept in combinations([n for n in range(16) if n // 2 not in segments], 5)
    ]
    for _, segments in KEYS
]


def _viable(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Pairs within the distance whose chain from ``start`` keeps its budgets."""
    diff = a ^ b
    ok = np.ones(len(diff), dtype=bool)
    total = np.zeros(len(diff), dtype=np.int64)
    for length, budget in enumerate(BUDGET):
        shift = ((start + length) % SEGMENTS * SEGMENT_BITS).astype(np.uint64)
        total += np.bitwise_count((diff >> shift) & np.uint64((1 << SEGMENT_BITS) - 1))
        ok &= total <= budget
    return ok


def least_linked(prints: np.ndarray, group: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per row the first row of its group that it reaches by viable pairs; rows sorted by group."""
    root = np.arange(len(prints))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.bincount(group, minlength=group[-1] + 1 if len(group) else 0)
    left = np.cumsum(size)[group] - np.arange(len(group))  # rows of the group from this one on
    for step in range(1, int(size.max(initial=1))):
        at = np.flatnonzero(left > step)
        at = at[root[at] != root[at + step]]
        hit = at[_viable(prints[at], prints[at + step], start[at])] if len(at) else at
        for i in hit.tolist():
            a, b = find(i), find(i + step)
            root[max(a, b)] = min(a, b)
        while len(hit) and not np.array_equal(root, flat := root[root]):
            root[:] = flat
    return root


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star links within the keys of a partition sorted by key; a key may span batches."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        group = _group_ids(rows)
        open_from = int(np.searchsorted(group, group[-1]))
        rest = rows.iloc[open_from:]
        yield from _stars(rows.iloc[:open_from])
    if rest is not None:
        yield from _stars(rest)


def _group_ids(rows: pd.DataFrame) -> np.ndarray:
    k, a, b = (rows[c].to_numpy() for c in ("k", "key", "finer"))
    new = (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.concatenate(([0], np.cumsum(new)))


def _stars(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if not len(rows):
        return
    prints = rows["fingerprint"].to_numpy().view(np.uint64)
    starts = np.array([start for start, _ in KEYS])[rows["k"].to_numpy()]
    root = least_linked(prints, _group_ids(rows), starts)
    moved = np.flatnonzero(root != np.arange(len(root)))
    if len(moved):
        yield pd.DataFrame({"a": prints[moved].view(np.int64), "b": prints[root[moved]].view(np.int64)})


def ring_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints within the distance."""
    key = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.col("fingerprint").bitwiseAND(F.lit(_mask(segments))).alias("key"))
            for k, (_, segments) in enumerate(KEYS)
        ]
    )
    keyed = prints.select("fingerprint", F.inline(key))
    shared = cut_lineage(keyed.groupBy("k", "key").count().where("count > 1"))
    met = join_many(keyed, shared, ["k", "key"])
    small = met.where(F.col("count") <= crowd).select("k", "key", F.lit(0).cast("bigint").alias("finer"), "fingerprint")
    masks = F.array(*[F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)) for m in row]) for row in FINER])
    parts = F.transform(
        masks[F.col("k")], lambda m: F.struct(m.alias("mask"), F.col("fingerprint").bitwiseAND(m).alias("value"))
    )
    crowded = met.where(F.col("count") > crowd).select("k", "key", "fingerprint", F.inline(parts))
    finer = F.xxhash64("mask", "value")  # two finer keys that collide only cost comparisons
    rows = small.unionByName(crowded.select("k", "key", finer.alias("finer"), "fingerprint"))
    dealt = rows.repartition("k", "key", "finer").sortWithinPartitions("k", "key", "finer", "fingerprint")
    return dealt.mapInPandas(_link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(row, doc_id, fingerprint, component, component_id) of every row.

    Rows are in one component if links of at most 3 differing bits join them: ``component`` is
    its least fingerprint, component_id its least id. Null and empty texts have fingerprint 0
    and link like any other; a null id is never a least id, unless its whole component has
    none. Repeated rows get the same answer each.
    """
    prints = cut_lineage(fingerprints(docs, doc_id, text))
    nodes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    labels = cut_lineage(component_labels(ring_links(nodes.select("fingerprint"), crowd), "a", "b"))
    component = F.coalesce("root", "fingerprint").alias("component")
    placed = nodes.join(labels, F.col("node") == F.col("fingerprint"), "left").select("fingerprint", component, "least")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_all = cut_lineage(join_many(placed.select("fingerprint", "component"), least, ["component"]))
    found = join_many(prints, of_all, ["fingerprint"])
    return found.select("row", "doc_id", "fingerprint", "component", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of ``docs`` with the least id of each component; equal rows are one, a null id comes last."""
    found = near_duplicates(docs, doc_id, text)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    kept = cut_lineage(found.groupBy("component").agg(best.alias("best")).select("best.doc_id", "best.row"))
    return keep_rows(docs, kept, doc_id, text)


def keep_rows(docs: DataFrame, kept: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``kept`` (doc_id, row) names, equal ones once.

    Row and id name a row together, and equal rows are told by two further words, so that two
    documents whose :func:`row_key` is the same by chance both stay. Columns _row, _doc and _twin of the input go.
    """
    known = F.coalesce(F.col(text), F.lit(""))
    inner = docs.drop("_row", "_doc", "_twin")
    marked = inner.withColumn("_row", row_key(F.col(doc_id), F.col(text))).withColumn("_twin", F.xxhash64(F.lit(11), known))
    names = kept.select(F.col("row").alias("_row"), F.col("doc_id").alias("_doc"))
    met = marked.join(names, "_row").where(F.col(doc_id).cast("bigint").eqNullSafe(F.col("_doc")))
    return met.dropDuplicates(["_row", "_doc", "_twin"]).drop("_row", "_doc", "_twin")
