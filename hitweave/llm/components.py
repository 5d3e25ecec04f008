"""Connected components of integer links by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release
from .common import cut_lineage, join_many


def component_labels(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every linked node and the least node it reaches.

    Each round is a grouping with a map-side minimum and a join, over a written table, so
    neither a component nor a hub has to fit a task; the rounds grow with the logarithm of
    the longest path.
    """
    pairs = cut_lineage(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = None
    while before != (before := _digest(pairs)):
        large = cut_lineage(_large_star(pairs))
        release(pairs)
        pairs = cut_lineage(_small_star(large))
        release(large)
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the least of its neighbourhood."""
    both = pairs.toDF("a", "b").unionByName(pairs.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return join_many(both.where("b > a"), least, ["a"]).select(F.col("b").alias("u"), F.col("m").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link every lesser neighbour of a node, and the node, to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_many(pairs, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
