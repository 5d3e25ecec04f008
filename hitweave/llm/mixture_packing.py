"""Mixture-controlled packing: deficit round-robin over one queue per source.

Every window of ``window`` tokens gives each queue a quantum, its target share of the
window. What a queue may send and has not, its deficit, is carried to the next window.
Documents may be cut anywhere, so a queue sends exactly the whole tokens of its credit and
a deficit stays below one token: after r windows queue i has sent min(T_i, floor(r * q_i)).
That closed form lets every document find its windows alone: it needs its start in its
queue, which is a running sum carried over the partitions, and the queue table.

Inside a window the queues follow each other in the order of their names, so documents are
cut at window and sequence ends only. Windows lie end to end; sequences are the same
stream cut every ``length`` ids, so only the last one of all can be short.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

LENGTH = 2048
WINDOW = 64 * LENGTH
END_ID = 1
#: The vocabulary file's one special token: in a text it is read as its own id.
SPECIAL = {"<|endoftext|>": 50256}
RANKS = "byte_bpe_50k.tiktoken"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, window_id bigint, source string"
)


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary as ranks; gives the ids of its tokenizers form, several times as fast."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def document_ids(encoding: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """Ids of a text and the end id; null counts as empty."""
    text = text or ""
    special = any(token in text for token in SPECIAL)
    ids = encoding.encode(text, allowed_special="all") if special else encoding.encode_ordinary(text)
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


def tokenised(docs: DataFrame, doc_id: str, text: str, source: str, path: str) -> DataFrame:
    """(doc_id, source, part, before, n, ids): ids of each row and its start among its task's rows of that source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sent, part = encoder(path), {}, TaskContext.get().partitionId()
        for batch in batches:
            names = batch.column("source").to_pylist()
            before, counts, raw = [], [], []
            for name, words in zip(names, batch.column("text")):
                ids = document_ids(encoding, words.as_py())
                before.append(sent.get(name, 0))
                counts.append(len(ids))
                raw.append(ids.astype("<u2").tobytes())
                sent[name] = before[-1] + len(ids)
            columns = [
                batch.column("doc_id"),
                batch.column("source"),
                pa.array(np.full(len(names), part), pa.int32()),
                pa.array(before, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array(raw, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "part", "before", "n", "ids"])

    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
    )
    return rows.mapInArrow(run, "doc_id bigint, source string, part int, before bigint, n bigint, ids binary")


class Queues:
    """Totals and quanta of the queues; positions in closed form."""

    def __init__(self, totals: Mapping[str, int], targets: Mapping[str, float] | None, window: int):
        self.names = sorted(totals)
        self.place = {name: i for i, name in enumerate(self.names)}
        self.totals = np.array([totals[n] for n in self.names], dtype=np.int64)
        if targets is None:
            weights = self.totals / max(1, self.totals.sum())
        else:
            weights = np.array([targets.get(n, 0.0) for n in self.names], dtype=np.float64)
            # Queues without a target share what the named ones leave, by size.
            unnamed = np.array([n not in targets for n in self.names])
            rest = max(0.0, 1.0 - weights.sum())
            if unnamed.any():
                rest = rest or 0.5
                weights[unnamed] = rest * self.totals[unnamed] / max(1, self.totals[unnamed].sum())
            weights = weights / weights.sum()
        # At least a millionth of a token a window, so that every queue drains.
        self.quantum = np.maximum(weights * window, 1e-6)

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens sent by each queue (column) before each window (row)."""
        return np.minimum(np.floor(rounds[:, None] * self.quantum[None, :]).astype(np.int64), self.totals[None, :])

    def first_window(self, queue: int, token: int) -> int:
        """The window that sends a token, counted from 0 in its queue."""
        q = self.quantum[queue]
        r = max(0, int(token / q) - 1)
        while np.floor((r + 1) * q) <= token:
            r += 1
        return r


def _cut(queues: Queues, rows: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Pieces of the rows: a document is cut where its window or its sequence ends."""
    out: dict[str, list] = {field.split()[0]: [] for field in PIECES.split(", ")}
    for doc_id, source, begin, n, raw in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "source", "begin", "n", "ids"))):
        queue = queues.place[source]
        ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
        first, last = queues.first_window(queue, begin), queues.first_window(queue, begin + n - 1)
        marks = queues.sent(np.arange(first, last + 2, dtype=np.float64))
        for w in range(last - first + 1):
            lo, hi = max(int(marks[w, queue]), begin), min(int(marks[w + 1, queue]), begin + n)
            ahead = int((marks[w + 1, :queue] - marks[w, :queue]).sum())
            at = int(marks[w].sum()) + ahead + lo - int(marks[w, queue])
            while lo < hi:
                size = min(hi - lo, length - at % length)
                start = lo - begin
                crc = zlib.crc32(ids[start : start + size].tobytes())
                piece = (doc_id, start, size, crc, n, at // length, at % length, first + w, source)
                for values, value in zip(out.values(), piece):
                    values.append(value)
                lo, at = lo + size, at + size
    kinds = [pa.int64()] * (len(out) - 1) + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    targets: Mapping[str, float] | None = None,
    length: int = LENGTH,
    window: int = WINDOW,
    ranks: str = RANKS,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_id, source) of all documents.

    ``targets`` are token shares by source; None stands for the sources' own shares, at
    which all queues drain together. With other targets a queue that is empty gives no more
    tokens and later windows are shorter by its quantum; no document is left out. Null and
    empty texts are one end id, a null source is the source "". Repeated rows are documents
    of their own. Ids are stored in two bytes: the vocabulary has at most 65,536. The queue table, one row per source, is read by the driver and goes to all
    tasks: sources are the components of a mixture, not keys that grow with the documents.
    """
    path = public_tokenizers.path(ranks)
    rows = cut_lineage(tokenised(docs, doc_id, text, source, path))
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        sums.select("source", "part", "tokens", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("earlier"))
    )
    totals = {r["source"]: r["tokens"] for r in offsets.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    queues = Queues(totals, targets, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cut(queues, batch, length)

    placed = rows.join(offsets.select("source", "part", "earlier"), ["source", "part"])
    placed = placed.select("doc_id", "source", (F.col("earlier") + F.col("before")).alias("begin"), "n", "ids")
    return placed.mapInArrow(run, PIECES)
