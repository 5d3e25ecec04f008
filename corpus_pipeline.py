"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from hitweave.llm import language_kernel, mixture_packing, shingle_copies, suffix_dedup, winnowing  # noqa: E402
from hitweave.llm.common import ready, table  # noqa: E402
from hitweave.session import checkpoint_root  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: null texts and texts without a letter go."""
    found = language_kernel.identify(docs.select(*COLUMNS))
    return found.where(F.col("_lang") != language_kernel.UNKNOWN).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the least id.

    Near copies share 0.8 of their five-word shingles or are linked by op10's rule.
    """
    return shingle_copies.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that another document has are taken out of the text."""
    left = suffix_dedup.one_of_each_passage(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more are benchmark passages go."""
    checked = winnowing.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return checked.where(~winnowing.contaminated(F.col("_report"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, mixed by source."""
    return mixture_packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language identification", keep_known_languages),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", remove_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("mixture packing", pack_sequences),
]

#: The language classifier, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{checkpoint_root(spark)}/pipeline/{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        ready(spark)
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{n}")
        docs = spark.read.parquet(f"{root}/{n}")
    return docs
