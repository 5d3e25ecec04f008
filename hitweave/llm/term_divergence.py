"""Audit of how the vocabulary of each source diverges from the other sources of its language.

Terms are counted in tasks on packed numbers. A chunk of texts becomes one byte array; a
table lower-cases A-Z and sets every byte outside terms to zero, so that terms are the runs
of other bytes. Terms of up to 16 bytes are dealt to buckets by length, each packed into one
or two uint64 words, which a radix sort of 16-bit digits orders (as many passes as the bucket
has pairs of bytes) and which are then counted by their runs. The sort is stable and texts
come by group, so the runs of a word hold the documents of a group side by side. Longer terms
go to buckets of their own by length, sorted as bytes. What tasks counted is summed by Spark.

Every frequency is an integer, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), so all sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, join_many

MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
SMOOTHING = 5
#: Bytes of text that a task sorts at once.
CHUNK = 1 << 23
#: Bytes of text that are cut into terms at once; a longer text is cut in several steps.
STEP = 1 << 22
PACKED = 16
#: Sources whose pairs are summed in one group, and terms of such a group.
SOURCE_BLOCK, TERM_BLOCK = 256, 4096


def _fold() -> np.ndarray:
    """Per byte its lower-cased value, or 0 where a term cannot hold it."""
    table = np.zeros(256, dtype=np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for first in (0x41, 0x61):
        table[first : first + 26] = np.arange(0x61, 0x61 + 26)
    return table


FOLD = _fold()
#: Terms, their groups, occurrences and documents.
Runs = tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]


def radix_order(words: list[np.ndarray], digits: int) -> np.ndarray:
    """Stable order by ``words`` (least significant first) on their lowest ``digits`` digits of 16 bits."""
    order = np.arange(len(words[0]))
    for digit in range(digits):
        part = (words[digit // 4] >> np.uint64(16 * (digit % 4))).astype(np.uint16)
        order = order[np.argsort(part[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def cut_terms(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, lengths, text number) of the terms of texts that lie end to end, step by step."""
    at, size = 0, len(data)
    while at < size:
        to = min(at + STEP, size)
        while to < size and FOLD[data[to - 1]] and FOLD[data[to]]:  # do not cut a term
            ahead = FOLD[data[to : to + STEP]]
            to += len(ahead) if ahead.all() else int(np.argmin(ahead))
        folded = FOLD[data[at:to]]
        inside = folded != 0
        edges = ends[(ends > at) & (ends < to)] - at  # a text ends before these places
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(opens)
        yield folded, starts, np.flatnonzero(closes) + 1 - starts, np.searchsorted(ends, starts + at, side="right")
        at = to


def _packed(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, count: int) -> list[np.ndarray]:
    """Terms as ``count`` words, least significant first: the term's bytes as one number."""
    words = [np.zeros(len(starts), dtype=np.uint64) for _ in range(count)]
    for back in range(8 * count):
        at = starts + lengths - 1 - back
        value = np.where(lengths > back, folded[np.maximum(at, 0)], 0).astype(np.uint64)
        words[back // 8] |= value << np.uint64(8 * (back % 8))
    return words


def _counted(same_term: np.ndarray, text: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows ordered by term and text: per run of (term, group) its first row, its rows and its texts."""
    by_text = np.flatnonzero(np.concatenate(([True], ~same_term | (text[1:] != text[:-1]))))
    fresh = np.concatenate(([True], ~same_term))
    new = fresh[by_text] | np.concatenate(([True], group[text[by_text[1:]]] != group[text[by_text[:-1]]]))
    # A run of texts may begin anew where the term does not, so terms are looked up at the rows themselves.
    first = np.flatnonzero(new)
    rows = np.diff(np.append(by_text[first], len(text)))
    return by_text[first], rows, np.diff(np.append(first, len(by_text)))


def count_terms(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> Iterator[Runs]:
    """(terms, group, occurrences, documents) of texts that lie end to end and are ordered by ``group``."""
    held: dict[int, list] = {}
    long: dict[int, list] = {}
    for folded, starts, lengths, text in cut_terms(data, ends):
        bucket = np.where(lengths > PACKED, 0, (lengths + 1) // 2)
        for b in np.unique(bucket).tolist():
            at = np.flatnonzero(bucket == b)
            if b:
                words = _packed(folded, starts[at], lengths[at], 1 if b <= 4 else 2)
                held.setdefault(b, []).append((*words, text[at]))
            else:
                for s, n, t in zip(starts[at].tolist(), lengths[at].tolist(), text[at].tolist()):
                    long.setdefault(n.bit_length(), []).append((folded[s : s + n].tobytes(), t))
    for b, parts in held.items():
        *words, text = (np.concatenate(c) for c in zip(*parts))
        order = radix_order(words, b)
        words, text = [w[order] for w in words], text[order]
        same = np.logical_and.reduce([w[1:] == w[:-1] for w in words])
        first, rows, texts = _counted(same, text, group)
        raw = np.stack([w[first] for w in reversed(words)], axis=1).astype(">u8").tobytes()
        width = 8 * len(words)
        terms = [raw[i : i + width].lstrip(b"\0") for i in range(0, len(raw), width)]
        yield terms, group[text[first]], rows, texts
    for rows_of in long.values():
        rows_of.sort(key=lambda x: x[0])
        names, text = [t for t, _ in rows_of], np.array([t for _, t in rows_of])
        same = np.array([x == y for x, y in zip(names[1:], names)], dtype=bool)
        first, rows, texts = _counted(same, text, group)
        yield [names[i] for i in first.tolist()], group[text[first]], rows, texts


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each text ends."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[at[0] : at[-1]] if body is not None else np.array([], dtype=np.uint8)
    return data, at[1:] - at[0]


SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count_chunk(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks().sort_by([("lang", "ascending"), ("source", "ascending")])
    lang, source = (rows.column(c).combine_chunks() for c in ("lang", "source"))
    pairs = list(zip(lang.to_pylist(), source.to_pylist()))
    fresh = [True, *(x != y for x, y in zip(pairs[1:], pairs))]
    group = np.cumsum(fresh) - 1
    firsts = pa.array(np.flatnonzero(fresh))
    names = lang.take(firsts), source.take(firsts)
    text = pa.concat_arrays([c.fill_null("").cast(pa.large_string()) for c in rows.column("text").chunks])
    for terms, of, n, docs in count_terms(*_texts(text), group):
        of = pa.array(of)
        term = pa.array([t.decode("utf-8", "replace") for t in terms], pa.string())
        yield pa.RecordBatch.from_arrays([names[0].take(of), names[1].take(of), term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=SCHEMA)


def term_counts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): occurrences and documents; null counts as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= chunk:
                yield from _count_chunk(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from _count_chunk(pa.Table.from_batches(held))

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = named.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact in decimals."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = wide(count + SMOOTHING, 19) * F.lit(SCALE).cast("decimal(10,0)")
    below = wide(total, 20) + wide(terms, 15) * F.lit(SMOOTHING).cast("decimal(1,0)")
    return F.call_function("div", above, below) + 1


def _pair_sums(rows: DataFrame, sources: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, a, b, value): per pair of source numbers a < b of a language the sum of |p - q| over its kept terms.

    Only present terms are shipped; a group holds a block of terms and two blocks of sources, and
    fills in the frequency of absent terms itself.
    """
    chunk = F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk")
    blocks = sources.groupBy("lang").agg((F.floor(F.max("number") / SOURCE_BLOCK) + 1).alias("blocks"))
    shape = kept.groupBy("lang").agg((F.floor(F.count("*") / TERM_BLOCK) + 1).alias("chunks")).join(blocks, "lang")
    sizes = join_many(kept.select("lang", "term"), shape, ["lang"]).select("lang", chunk).groupBy("lang", "chunk").agg(F.count("*").alias("size"))
    own = F.floor(F.col("number") / SOURCE_BLOCK)
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    no_term, no_size = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    here = join_many(rows.select("lang", "term", "number", "p"), shape, ["lang"]).select("lang", chunk, "term", "number", "p", no_size.alias("size"), F.inline(meets))
    absent = sources.join(shape, "lang").join(sizes, "lang").select("lang", "chunk", no_term.alias("term"), "number", "p_absent", "size", F.inline(meets))

    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        named = table.column("term").is_valid()
        present, base = table.filter(named), table.filter(pa.compute.invert(named))
        numbers, order = np.unique(base.column("number").to_numpy(), return_index=True)
        matrix = np.tile(base.column("p").to_numpy()[order], (base.column("size")[0].as_py(), 1))
        if present.num_rows:
            term = present.column("term").combine_chunks().dictionary_encode()
            at = np.searchsorted(numbers, present.column("number").to_numpy())
            matrix[term.indices.to_numpy(), at] = present.column("p").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        out: list[np.ndarray] = []
        for k in np.flatnonzero(numbers // SOURCE_BLOCK == i).tolist():
            with_ = np.flatnonzero((numbers // SOURCE_BLOCK == j) & (numbers > numbers[k]))
            sums = np.abs(matrix[:, with_] - matrix[:, [k]]).sum(axis=0)
            out.append(np.stack([np.full(len(with_), numbers[k]), numbers[with_], sums]))
        a, b, value = np.concatenate(out, axis=1).astype(np.int64) if out else np.zeros((3, 0), dtype=np.int64)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "value": value})

    every = here.unionByName(absent.withColumnRenamed("p_absent", "p"))
    parts = every.groupBy("lang", "i", "j", "chunk").applyInArrow(run, "lang string, a bigint, b bigint, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text).

    Each language keeps the terms that at least ``min_docs`` of its documents have. Part ``pair``
    compares a source with each other source of its language, part ``term`` names the ``top`` terms
    that a source uses more often than its language does. Null lang, source and text count as '';
    repeated rows are documents of their own; a source without terms still has its pairs, as has a
    language that keeps no term (value 0). Ties go to the lesser item. An empty table gives no rows.
    """
    counts = cut_lineage(term_counts(docs))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
    kept = cut_lineage(by_lang.where(F.col("docs") >= min_docs).select("lang", "term", "n_lang"))
    present = cut_lineage(join_many(counts.select("lang", "source", "term", "n"), kept, ["lang", "term"]))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    of_source = present.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1
    sources = docs.select(*named).distinct().withColumn("number", numbered)
    zero = F.lit(0).cast("bigint")
    sources = sources.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    filled = [F.coalesce(c, zero).alias(c) for c in ("total", "terms", "total_lang")]
    sources = cut_lineage(sources.select("lang", "source", "number", *filled))
    base = sources.withColumn("p_absent", frequency(zero, F.col("total"), F.col("terms"))).where("terms > 0")
    rows = join_many(present, sources, ["lang", "source"]).withColumn("p", frequency(F.col("n"), F.col("total"), F.col("terms")))
    sums = cut_lineage(_pair_sums(rows, base, kept))

    name = sources.select("lang", "source", "number")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    left, right = name.withColumnRenamed("number", "a"), name.select("lang", F.col("source").alias("item"), F.col("number").alias("b"))
    pairs = left.join(right, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    apart = F.col("p") - frequency(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    terms = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart.alias("value")).where("value > 0")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranked).unionByName(terms.withColumn("rank", ranked).where(F.col("rank") <= top))
