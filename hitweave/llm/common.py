"""Column helpers shared by the text operators."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, cut_lineage

WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000
#: Rows of one Arrow batch; texts may be long, so that batches are kept small.
BATCH_ROWS = "1000"

__all__ = ["cut_lineage", "table", "ready", "ascii_lower", "words", "bind", "grams", "text_key", "row_key", "join_small", "join_many"]


def ready(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches that fit long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and characters beyond ASCII, lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAKS), "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once, however often the body or a lambda in it names it."""
    return F.transform(F.array(value), body)[0]


def grams(items: Column, size: int, make: Callable[[Column], Column], empty: str) -> Column:
    """``make`` of every run of ``size`` consecutive items, in order; ``empty`` is the array type for fewer items."""
    count = F.size(items) - (size - 1)
    return F.when(count < 1, F.array().cast(empty)).otherwise(
        F.transform(F.sequence(F.lit(1), count), lambda i: make(F.slice(items, i, F.lit(size))))
    )


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text; null counts as empty."""
    known = F.coalesce(text, F.lit(""))
    return [F.xxhash64(known).alias("_k1"), F.xxhash64(F.lit(7), known).alias("_k2")]


KEY = ["_k1", "_k2"]


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells documents apart: equal rows are one document, an id with two texts is two."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def join_small(rows: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table whose written size decides: broadcast up to ``limit`` rows, shuffled above it.

    ``small`` must be cheap to count (a written table). The result is the same either way.
    """
    if small.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(small), on, how)
    return join_many(rows, small, on, how)


def join_many(rows: DataFrame, values: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Bring one row per key to the many rows of it.

    The extra key is always 0 but no literal: both sides become plain shuffles of this
    join, which the adaptive skew join cuts where one key holds a large part of the rows.
    Its name is one that neither side has.
    """
    zero, name = F.pmod(F.xxhash64(*on), F.lit(1)), "_zero"
    while name in {c.lower() for c in (*rows.columns, *values.columns)}:
        name += "_"
    return rows.withColumn(name, zero).join(values.withColumn(name, zero), [*on, name], how).drop(name)
