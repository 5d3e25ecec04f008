"""Grouping of spelling variants over a reduced alphabet.

Every code point of a word is hashed to one of a few symbols. If two words differ by one
inserted, deleted or replaced code point, their reduced words are equal or differ by one such
edit of symbols. So each distinct reduced word is spelled out with its full neighbourhood of
one edit (itself, all deletions, replacements and insertions of symbols), the neighbourhood is
joined with the reduced vocabulary, and the words behind both are compared as they are.

Reduced words travel as 64-bit polynomial hashes: a neighbour's hash follows from the sums
before and after the edited place, so a neighbourhood costs a few numbers per place, however
long the word is. Two reduced words with one hash only cost comparisons, as the last step is exact.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release
from .common import cut_lineage, join_many

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
SYMBOLS = 8
#: A-Z, a-z and U+00C0 to U+00FF as UTF-8, after A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xC3[\x80-\xBF])+")
DELETED_ONE_IN = 199
#: Distinct words that a task counts before it passes them on, and hashes that it passes on at once.
HELD_WORDS, BATCH = 500_000, 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)


def without_one_letter(doc_id: bytes, run: bytes) -> bytes:
    """The run, without one code point where 199 divides the CRC-32 of ``<doc_id>:<run>``."""
    h = zlib.crc32(run, zlib.crc32(doc_id + b":"))
    if h % DELETED_ONE_IN:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n) of (doc_id, text): words of at least ``min_length`` code points after the deletion, and their occurrences.

    A null text has no words; a null id counts as an empty one in the CRC-32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                name = (doc_id or "").encode()
                for word, n in Counter(RUN.findall((text.as_py() or b"").lower())).items():
                    if len(word) >= min_length:
                        held[without_one_letter(name, word)] += n
                if len(held) > HELD_WORDS:
                    yield counted(held)
                    held.clear()
        if held:
            yield counted(held)

    def counted(held: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode() for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = named.mapInArrow(run, "word string, n bigint").where(F.length("word") >= min_length)
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def reduced(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """Symbols 1 to ``symbols`` of words of one length, a row each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64).reshape(len(words), -1)
    return ((points * BASE) >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, BASE))), dtype=np.uint64)


def reduced_hash(rows: np.ndarray) -> np.ndarray:
    return (rows * _powers(rows.shape[1] - 1)).sum(axis=1, dtype=np.uint64)


def neighbourhood(rows: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Hashes of the words (rows of symbols) of at most one edit from each, itself included; a row each, repeats too."""
    n, length = rows.shape
    powers = _powers(length + 1)
    terms = rows * powers[:length]
    before = np.concatenate((np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)
    whole = before[:, -1:]
    after = whole - before  # of the symbols from each place on
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    deleted = before[:, :-1] + after[:, 1:] * inverse
    replaced = (whole - terms)[:, :, None] + powers[:length, None] * every
    inserted = (before + after * BASE)[:, :, None] + powers[: length + 1, None] * every
    return np.concatenate((whole, deleted, replaced.reshape(n, -1), inserted.reshape(n, -1)), axis=1)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places, words) of one length, at most as many as make a batch of neighbours."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, BATCH // (length * 2 * SYMBOLS + SYMBOLS))
        for i in range(0, len(at), step):
            yield at[i : i + step], [words[k] for k in at[i : i + step].tolist()]


def with_reduced(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n) with the hash of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            for at, some in _by_length(batch.column("word").to_pylist()):
                out[at] = reduced_hash(reduced(some, symbols))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], ["word", "n", "reduced"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, reduced bigint")


def neighbours(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(own, reduced): each reduced word's hash beside all hashes of its neighbourhood, of (word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in _by_length(batch.column("word").to_pylist()):
                hashes = neighbourhood(reduced(some, symbols), symbols)
                own = np.repeat(hashes[:, 0], hashes.shape[1]).reshape(hashes.shape)
                hashes.sort(axis=1)
                new = np.ones(hashes.shape, dtype=bool)
                new[:, 1:] = hashes[:, 1:] != hashes[:, :-1]
                columns = [pa.array(x[new].view(np.int64)) for x in (own, hashes)]
                yield from pa.Table.from_arrays(columns, ["own", "reduced"]).to_batches(BATCH)

    return words.select("word").mapInArrow(run, "own bigint, reduced bigint")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n): all pairs of the distinct ``words`` (word, n) that differ by exactly one code point, both ways."""
    listed = cut_lineage(with_reduced(words, symbols))
    # One word stands for all with its reduced form: their neighbourhoods are the same.
    forms = listed.groupBy("reduced").agg(F.min("word").alias("word"))
    found = neighbours(forms, symbols).join(forms.select("reduced"), "reduced")
    met = cut_lineage(found.select("own", F.col("reduced").alias("other")))
    left = listed.select(F.col("reduced").alias("own"), "word")
    right = listed.select(F.col("reduced").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = join_many(met, left, ["own"]).join(right, "other")
    exact = F.levenshtein("word", "near", 1) == 1
    return pairs.where(exact).select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word of each chain of forms.

    Pointers are doubled, so the rounds grow with the logarithm of the longest chain, which is
    itself a logarithm of the greatest count.
    """
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(join_many(steps, ahead, ["root"], "left"))
        if moved.where("next IS NOT NULL").isEmpty():
            return steps
        release(steps)
        steps = moved.select("word", F.coalesce("next", "root").alias("root"))


def variant_groups(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, symbols: int = SYMBOLS
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text).

    Words have at least ``min_length`` code points and ``min_count`` occurrences; a word's form is
    its most frequent near word (ties: the least), if that is ``ratio`` times as frequent. Null and
    empty texts have no words; repeated rows count each; long words cost in proportion to their length.
    """
    words = cut_lineage(word_counts(docs, min_length).where(F.col("n") >= min_count))
    near = near_pairs(words, symbols)
    best = F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("word")))
    of_word = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    listed = words.join(of_word, "word", "left")
    often = -F.col("best.least") >= F.col("n") * ratio
    formed = cut_lineage(
        listed.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(often, F.col("best.word")).alias("form"),
            F.when(often, -F.col("best.least")).alias("form_n"),
        )
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
