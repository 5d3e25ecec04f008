"""Nested branch tables: one row per event, one array per branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import E
from .schemas import rename_branches


def flatten_branches(branches: DataFrame) -> DataFrame:
    """Rename the branches and turn the parallel arrays into rows."""
    named = rename_branches(branches)
    arrays = [c for c in named.columns if c != E]
    return named.select(E, F.inline(F.arrays_zip(*arrays)))


def clean_nested_spacepoints(spacepoints: DataFrame) -> DataFrame:
    """-1 as second cluster means "same as the first"."""
    second = F.coalesce(F.nullif("cluster_index_2", F.lit(-1)), "cluster_index_1")
    return spacepoints.withColumn("cluster_index_2", second)


def link_arrays(clusters: DataFrame) -> DataFrame:
    """(event, cluster, subevent, barcode) rows from the two parallel link arrays."""
    return clusters.select(E, "cluster_id", F.inline(F.arrays_zip("subevent", "barcode")))
