"""Repeated passages across documents by sparse suffix arrays.

Of all suffixes only those at minimisers are retained: word positions whose hash of
``gram`` words is the least of some ``reach`` positions in a row. Any ``passage`` words in a
row hold such a position among their first ``reach``, and equal passages hold it at the same
place, so both keep the suffix there and the two agree in their first ``block`` =
``passage - reach + 1`` words. Suffixes that agree so far with one of another document are
joined on the hash of these words. Neighbouring retained positions of a document overlap,
so only the ends of a run of such suffixes are open: there the words before and after are
sorted within the equal suffixes, and comparing neighbours in that order gives how far each
match extends left and right (always fewer than ``reach`` words).

Every passage of at least ``passage`` words that occurs in two documents is covered by the
spans reported; a span joins overlapping repeats of at least ``block`` words, and is
reported if it has at least ``passage``. What may be removed is decided on whole windows of
``passage`` words, which are hashed where the suffix at their minimiser is shared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import release
from .common import cut_lineage, join_many, join_small, row_key

PASSAGE = 50
REACH = 20
GRAM = 6
#: Rows of bare keys that are broadcast, and a seam that may be at any place.
KEYS = 1_000_000
ANYWHERE = -1
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_list(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the hash's factor and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << n.bit_length()
            self.up, self.down = (
                np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, factor)))) for factor in (FACTOR, INVERSE)
            )


class Hashed:
    """A text's word hashes, and hashes of its runs of words from prefix sums."""

    def __init__(self, text: str | None, powers: Powers):
        tokens = word_list(text)
        self.n = len(tokens)
        self.words = np.frombuffer(b"".join(map(xxhash.xxh64_digest, tokens)), dtype=">u8").astype(np.uint64)
        self.powers = powers
        self.sums: dict[int, np.ndarray] = {}

    def runs(self, at: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
        """Hash of the ``size`` words from each place."""
        self.powers.reach(self.n)
        if salt not in self.sums:
            terms = _mixed(self.words + np.uint64(salt)) * self.powers.up[: self.n]
            self.sums[salt] = np.concatenate(([np.uint64(0)], np.cumsum(terms)))
        sums = self.sums[salt]
        return _mixed((sums[at + size] - sums[at]) * self.powers.down[at] + np.uint64(size))

    def minima(self, gram: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``gram`` words, and the least of the ``reach`` from each place."""
        hashes = self.runs(np.arange(self.n - gram + 1), gram)
        least, width = hashes, 1
        while width < reach:  # least of ever wider windows
            step = min(width, reach - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        return hashes, least

    def retained(self, gram: int, reach: int, block: int) -> np.ndarray:
        """Minimiser places that a whole block of words follows."""
        count = self.n - gram + 1
        if count < reach or self.n < block:
            return np.array([], dtype=np.int64)
        hashes, least = self.minima(gram, reach)
        # A place is kept if it is the least of a window that holds it: the greatest least there is its own.
        padded = np.concatenate((np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)))
        most, width = padded, 1
        while width < reach:
            step = min(width, reach - width)
            most, width = np.maximum(most[:-step], most[step:]), width + step
        places = np.flatnonzero(hashes == most[:count])
        return places[places + block <= self.n]


def retained_suffixes(docs: DataFrame, gram: int, reach: int, block: int) -> DataFrame:
    """(key, row, pos, nth) of the retained suffixes of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            rows, parts = batch.column("row").to_numpy(), []
            for row, text in zip(rows, batch.column("text")):
                hashed = Hashed(text.as_py(), powers)
                places = hashed.retained(gram, reach, block)
                if len(places):
                    keys = hashed.runs(places, block).view(np.int64)
                    parts.append((keys, np.full(len(places), row), places, np.arange(len(places))))
            if parts:
                key, row, pos, nth = (np.concatenate(c) for c in zip(*parts))
                columns = [pa.array(key), pa.array(row), pa.array(pos.astype(np.int32)), pa.array(nth.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "row", "pos", "nth"])

    return docs.mapInArrow(run, "key bigint, row bigint, pos int, nth int")


def _contexts(docs: DataFrame, places: DataFrame, reach: int, block: int) -> DataFrame:
    """(row, pos, check, left, right): 4 bytes for each word beside the blocks at ``places`` (row, pos list), nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, text, at in zip(batch.column("row"), batch.column("text"), batch.column("at")):
                hashed = Hashed(text.as_py(), powers)
                short = (hashed.words >> np.uint64(32)).astype(">u4")
                place = np.array(at.as_py(), dtype=np.int64)
                out[0] += [row.as_py()] * len(place)
                out[1] += place.tolist()
                out[2] += hashed.runs(place, block, salt=1).view(np.int64).tolist()
                out[3] += [short[max(0, p - reach + 1) : p][::-1].tobytes() for p in place]
                out[4] += [short[p + block : p + block + reach - 1].tobytes() for p in place]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            names = ["row", "pos", "check", "left", "right"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    met = join_small(docs, places, ["row"], "inner")
    return met.select("row", "text", "at").mapInArrow(run, "row bigint, pos int, check bigint, left binary, right binary")


def _common_words(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    x, y = np.frombuffer(a, ">u4", n), np.frombuffer(b, ">u4", n)
    return int(np.argmin(x == y))


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words that each context has in common with the nearer of its sorted neighbours; flags the ends of the partition."""
    names = ["side", "key", "check"]
    held, before = None, 0  # the row that still waits for its successor, what it shares with its predecessor
    first = True
    for batch in batches:
        out = []
        for row in zip(*(batch[c] for c in [*names, "context"])):
            shared = 0
            if held is not None:
                shared = _common_words(held[3], row[3]) if held[:3] == row[:3] else 0
                out.append((*held, max(before, shared), first))
                first = False
            held, before = row, shared
        if out:
            yield pd.DataFrame(out, columns=[*names, "context", "shared", "at_end"])
    if held is not None:
        yield pd.DataFrame([(*held, before, True)], columns=[*names, "context", "shared", "at_end"])


def extensions(contexts: DataFrame) -> DataFrame:
    """(side, key, check, context, words): the words that a context shares with another of its key, at most.

    The distinct contexts are sorted over all tasks by ranges, so the contexts of one key may
    fill many of them; the ends of the ranges meet in a second, small pass.
    """
    order = ["side", "key", "check", "context"]
    kind = "side int, key bigint, check bigint, context binary, shared int, at_end boolean"
    distinct = contexts.groupBy(*order).agg(F.count("*").alias("n"))
    counted = cut_lineage(distinct)
    own = counted.where("n > 1").select(*order, F.floor(F.octet_length("context") / 4).cast("int").alias("shared"))
    ranged = counted.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    inside = cut_lineage(ranged.mapInPandas(_neighbours, kind))
    ends = inside.where("at_end").select(*order).repartition(1).sortWithinPartitions(*order).mapInPandas(_neighbours, kind)
    every = own.unionByName(inside.select(*order, "shared")).unionByName(ends.select(*order, "shared"))
    return every.groupBy(*order).agg(F.max("shared").alias("words"))


def _windows(docs: DataFrame, places: DataFrame, passage: int, reach: int, gram: int) -> DataFrame:
    """(row, pos, key, check) of the ``passage`` words from each pos whose minimiser is in ``places`` (row, pos list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row, text, at in zip(batch.column("row"), batch.column("text"), batch.column("at")):
                hashed = Hashed(text.as_py(), powers)
                hashes, least = hashed.minima(gram, reach)
                place = at.values.to_numpy()
                starts = place[:, None] - np.arange(reach)
                inside = (starts >= 0) & (starts + passage <= hashed.n)
                kept = inside & (least[np.where(inside, starts, 0)] == hashes[place][:, None])
                starts = np.unique(starts[kept])
                if len(starts):
                    names = [pa.array(hashed.runs(starts, passage, salt=salt).view(np.int64)) for salt in (0, 1)]
                    columns = [pa.array(np.full(len(starts), row.as_py())), pa.array(starts.astype(np.int32)), *names]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "pos", "key", "check"])

    met = join_small(docs, places, ["row"], "inner")
    return met.select("row", "text", "at").mapInArrow(run, "row bigint, pos int, key bigint, check bigint")


def _covered(starts: DataFrame, passage: int) -> DataFrame:
    """(row, begin, end): the windows from ``starts`` (row, sorted pos list), joined where they overlap or touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for row, at in zip(batch.column("row"), batch.column("at")):
                at = at.values.to_numpy()
                gaps = np.flatnonzero(np.diff(at) > passage)
                begins, ends = at[np.concatenate(([0], gaps + 1))], at[np.concatenate((gaps, [len(at) - 1]))] + passage
                out[0] += [row.as_py()] * len(begins)
                out[1] += begins.tolist()
                out[2] += ends.tolist()
            kinds = [pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["row", "begin", "end"])

    return starts.select("row", "at").mapInArrow(run, "row bigint, begin int, end int")


@dataclass(frozen=True)
class Repeats:
    """Suffixes that another document shares.

    ``places`` (row, pos, nth, first_row, key) is a written table, ``docs`` (row, text) the
    documents. Rows are named by :func:`row_key`.
    """

    places: DataFrame
    docs: DataFrame
    passage: int
    reach: int
    gram: int
    block: int

    def _at(self, places: DataFrame) -> DataFrame:
        return cut_lineage(places.groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("at")))

    def _flagged(self) -> DataFrame:
        """Places with whether they open or close a run of neighbouring retained suffixes."""
        place = Window.partitionBy("row").orderBy("nth")
        return cut_lineage(
            self.places.select(
                "*",
                (F.coalesce(F.lag("nth").over(place), F.lit(-9)) != F.col("nth") - 1).alias("opens"),
                (F.coalesce(F.lead("nth").over(place), F.lit(-9)) != F.col("nth") + 1).alias("closes"),
            )
        )

    def _beside(self, flagged: DataFrame) -> DataFrame:
        """(row, pos, key, check, side, context): the words beside the open ends, and beside all suffixes of their keys."""
        open_keys = cut_lineage(flagged.where("opens or closes").select("key").distinct())
        wanted = join_small(flagged.select("key", "row", "pos"), open_keys, ["key"], "left_semi")
        beside = _contexts(self.docs, self._at(wanted), self.reach, self.block).distinct().join(wanted, ["row", "pos"])
        sides = F.array(
            F.struct(F.lit(0).alias("side"), F.col("left").alias("context")),
            F.struct(F.lit(1).alias("side"), F.col("right").alias("context")),
        )
        return cut_lineage(beside.select("row", "pos", "key", "check", F.inline(sides)))

    def spans(self) -> DataFrame:
        """(row, begin, end, first_row): word ranges of at least ``passage`` words that repeat in another document.

        ``first_row`` is the least row that has the first of their blocks.
        """
        order = ["side", "key", "check", "context"]
        flagged = self._flagged()
        contexts = self._beside(flagged)
        words = join_many(contexts, extensions(contexts), order)
        grown = lambda side: F.max(F.when(F.col("side") == side, F.col("words")))
        ends = cut_lineage(words.groupBy("row", "pos").agg(grown(0).alias("grown_0"), grown(1).alias("grown_1")))
        marked = join_many(flagged, ends, ["row", "pos"], "left")
        more = lambda flag, c: F.when(F.col(flag), F.coalesce(c, F.lit(0))).otherwise(0)
        begin, end = F.col("pos") - more("opens", "grown_0"), F.col("pos") + self.block + more("closes", "grown_1")
        by = F.struct("pos", "first_row").alias("by")
        spans = _merged(marked.select("row", begin.alias("begin"), end.alias("end"), by))
        return spans.where(F.col("end") - F.col("begin") >= self.passage)

    def removable(self) -> DataFrame:
        """(row, begin, end): the words of every window of ``passage`` words that a lesser row has too.

        Windows are compared whole, so the least row that has one keeps it unless overlapping
        ones are in rows less still, and each other row gives it up. A word goes only with a
        window that a lesser row has, so at its place there it stays or goes for a row less
        again: the least of them keeps it and nothing is lost.
        """
        at = self._at(self.places)
        windows = cut_lineage(_windows(self.docs, at, self.passage, self.reach, self.gram))
        least = windows.groupBy("key", "check").agg(F.min("row").alias("least"), F.max("row").alias("_last"))
        held = least.where("least < _last").select("key", "check", "least")
        later = join_many(windows, held, ["key", "check"]).where("row > least")
        starts = self._at(later)
        release(windows)
        return _covered(starts, self.passage)


def find_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    passage: int = PASSAGE,
    reach: int = REACH,
    gram: int = GRAM,
) -> Repeats:
    """The repeated suffixes of ``docs``. Null and empty texts and texts shorter than ``passage`` have none; equal rows count once."""
    block = passage - reach + 1
    if reach < 1 or gram > block:
        raise ValueError("a gram must fit the part of a passage that follows its first retained place")
    listed = _listed(docs, doc_id, text)
    suffixes = cut_lineage(retained_suffixes(listed, gram, reach, block))
    met = _shared(suffixes)
    release(suffixes)
    return Repeats(met, listed, passage, reach, gram, block)


def _listed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("text"))


def _shared(suffixes: DataFrame) -> DataFrame:
    """The suffixes whose key another row has too, with the first row that has it, written."""
    shared = (
        suffixes.groupBy("key")
        .agg(F.min("row").alias("first_row"), F.max("row").alias("_last"))
        .where(F.col("first_row") != F.col("_last"))
        .select("key", "first_row")
    )
    return cut_lineage(join_many(suffixes, shared, ["key"]).distinct())


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a row as one, with the first row of its first block."""
    order = Window.partitionBy("row").orderBy("begin", "end", "by")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", (F.coalesce(ahead, F.lit(-1)) < F.col("begin")).cast("int"))
    numbered = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("row", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("by").alias("by"))
    return out.select("row", "begin", "end", F.col("by.first_row").alias("first_row"))


def span_report(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, begin, end, n_words, first_doc_id) of the spans, by the ids of the documents."""
    named = docs.select(row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(doc_id).alias("doc_id")).distinct()
    first = named.toDF("first_row", "first_doc_id")
    of_doc = named.join(spans, "row").join(first, "first_row")
    return of_doc.select("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), "first_doc_id")


def without_repeats(docs: DataFrame, removable: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removable words taken out of ``text``, and without the documents that had no other words.

    Texts without such words, null and empty ones too, stay as they are.
    """
    names = [f.name for f in docs.drop("_row", "_spans", "_text").schema.fields]
    spans = _span_lists(removable).withColumnRenamed("row", "_row")
    marked = docs.select(*names).withColumn("_row", row_key(F.col(doc_id), F.col(text)))
    return _cut_texts(join_small(marked, spans, ["_row"], "left"), names, text).drop("_seams")


def _span_lists(removable: DataFrame) -> DataFrame:
    return cut_lineage(removable.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("_spans")))


def _cut_texts(marked: DataFrame, names: list[str], text: str) -> DataFrame:
    """``marked`` without the words of its ``_spans``, and without the rows that had no other words; ``_seams`` are the
    places of the words that the cuts gave another word before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seams, keep = [], [], []
            for t, s in zip(batch.column(text), batch.column("_spans")):
                spans = None if s.as_py() is None else [(x["begin"], x["end"]) for x in s.as_py()]
                texts.append(t.as_py() if spans is None else _cut_out(t.as_py(), spans))
                seams.append(None if spans is None else _seams(t.as_py(), texts[-1], spans))
                keep.append(spans is None or texts[-1] != "")
            columns = [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(seams, pa.list_(pa.int32()))], [*names, "_seams"])
            yield out.filter(pa.array(keep))

    schema = marked.select(*names, F.lit(None).cast("array<int>").alias("_seams")).schema
    return marked.select(*names, "_spans").mapInArrow(run, schema)


def one_of_each_passage(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE) -> DataFrame:
    """``docs`` with the removable words taken out until no ``passage`` words in a row are in two documents.

    A cut brings the words beside it together, which may make a passage that another document
    has, so the search is repeated; every round but the last removes words. A round leaves no passage in
    two documents but those over a seam of its cuts. The next therefore searches all documents, but only for
    passages over those seams, and hashes only texts that were cut.
    """
    reach, gram = REACH, GRAM
    block = passage - reach + 1
    names = [c for c in docs.columns if c not in ("_row", "_spans", "_seams")]
    docs = docs.select(*names)
    keyed = docs.withColumn("_row", row_key(F.col(doc_id), F.col(text)))
    listed = _listed(docs, doc_id, text)
    # Suffixes of the documents as they came; those of cut documents are replaced by the ones of what is left of them.
    suffixes = cut_lineage(retained_suffixes(listed, gram, reach, block))
    places, gone, cut, of_cut = _shared(suffixes), None, None, None
    while True:
        removable = cut_lineage(Repeats(places, listed, passage, reach, gram, block).removable())
        release(places)
        spans = _span_lists(removable).withColumnRenamed("row", "_row")
        if removable.isEmpty():
            for table in (suffixes, spans, removable, *([of_cut] if of_cut is not None else [])):
                release(table)
            return docs if cut is None else _now(keyed, gone, cut).select(*names)
        whole = keyed if cut is None else _now(keyed, gone, cut)
        fresh = _cut_texts(join_small(whole, spans, ["_row"], "inner"), names, text)
        fresh = cut_lineage(fresh.withColumn("_row", row_key(F.col(doc_id), F.col(text))))
        of_fresh = cut_lineage(retained_suffixes(fresh.select(F.col("_row").alias("row"), F.col(text).alias("text")), gram, reach, block))
        new_keys = _over_seams(of_fresh, fresh.select(F.col("_row").alias("row"), "_seams"), passage, reach)
        cut_now = cut_lineage(spans.select("_row"))
        if cut is None:
            gone, cut, of_cut = cut_now, fresh, of_fresh
        else:
            before = [gone, cut, of_cut, cut_now, fresh, of_fresh]
            gone = cut_lineage(gone.unionByName(cut_now).distinct())
            cut = cut_lineage(_without(cut, cut_now, "_row").unionByName(fresh))
            of_cut = cut_lineage(_without(of_cut, cut_now, "row").unionByName(of_fresh))
            for table in before:
                release(table)
        listed = _now(keyed, gone, cut).select(F.col("_row").alias("row"), F.col(text).alias("text"))
        of_uncut = _without(join_small(suffixes, new_keys, ["key"], "left_semi"), gone, "row")
        met = cut_lineage(of_uncut.unionByName(join_small(of_cut, new_keys, ["key"], "left_semi")))
        places = _shared(met)
        for table in (removable, met, new_keys):
            release(table)


def _without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    return join_small(rows, gone.withColumnRenamed("_row", name), [name], "left_anti", KEYS)


def _now(keyed: DataFrame, gone: DataFrame, cut: DataFrame) -> DataFrame:
    """The documents that were never cut, and what the cuts left of the others."""
    return _without(keyed, gone, "_row").unionByName(cut.drop("_seams"))


def _over_seams(suffixes: DataFrame, seams: DataFrame, passage: int, reach: int) -> DataFrame:
    """The keys of the suffixes that may be at the minimiser of a passage over a seam, written.

    A passage over a seam begins less than ``passage`` words before it, and its minimiser is among its first ``reach`` places.
    """
    near = F.exists("_seams", lambda c: (c == ANYWHERE) | F.col("pos").between(c - passage + 1, c + reach - 2))
    return cut_lineage(join_many(suffixes, seams.distinct(), ["row"]).where(near).select("key").distinct())


def _cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    at, kept = 0, []
    for begin, end in spans:
        kept.append(text[at : starts[begin]])
        at = starts[end]
    kept.append(text[at:])
    return "".join(kept).strip()


def _seams(text: str, left: str, spans: list[tuple[int, int]]) -> list[int]:
    """The places in ``left``, the text without the words of the spans, of the words that have another word before them than they had."""
    words, kept, seams, at = word_list(text), [], [], 0
    for begin, end in spans:
        kept += words[at:begin]
        seams.append(len(kept))
        at = end
    # White space of other scripts goes with the ends of a text, and it is part of words.
    return seams if word_list(left) == kept + words[at:] else [ANYWHERE]
