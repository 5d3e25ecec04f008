"""Neighbour aggregation: the data steps of message passing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import add
from .joins import E, join_per_key

STD_FLOOR = math.sqrt(1e-5)


def _std(c: Column) -> Column:
    value = F.stddev_pop(c)
    return F.when(value > STD_FLOOR, value).otherwise(F.lit(0.0))


REDUCE = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "std": _std}


def _vector_agg(column: str, dims: int, kinds: list[str]) -> Column:
    return F.array(*[REDUCE[kind](F.element_at(column, i + 1)) for kind in kinds for i in range(dims)])


def aggregate_messages(hits: DataFrame, edges: DataFrame, column: str, dims: int, kinds: list[str]) -> DataFrame:
    """Edge vectors combined at dst and at src, concatenated in that order; zeros without edges."""
    empty = F.array_repeat(F.lit(0.0), dims * len(kinds))
    at_dst = edges.groupBy(E, F.col("dst").alias("hit_id")).agg(_vector_agg(column, dims, kinds).alias("_in"))
    at_src = edges.groupBy(E, F.col("src").alias("hit_id")).agg(_vector_agg(column, dims, kinds).alias("_out"))
    joined = hits.join(at_dst, [E, "hit_id"], "left").join(at_src, [E, "hit_id"], "left")
    message = F.concat(F.coalesce("_in", empty), F.coalesce("_out", empty))
    return joined.withColumn("message", message).drop("_in", "_out")


def edge_inputs(edges: DataFrame, hits: DataFrame, node_vector: str, edge_vector: str) -> DataFrame:
    """``concat(x_src, x_dst, e)`` per edge."""
    x = hits.select(E, "hit_id", F.col(node_vector).alias("_x"))
    both = join_per_key(edges, x.toDF(E, "src", "_xs"), [E, "src"])
    both = join_per_key(both, x.toDF(E, "dst", "_xd"), [E, "dst"])
    return both.withColumn("edge_input", F.concat("_xs", "_xd", edge_vector)).drop("_xs", "_xd")


def residual_update(edges: DataFrame, edge_vector: str, update: str) -> DataFrame:
    return edges.withColumn(edge_vector, add(edge_vector, update))


def weighted_pooling(
    hits: DataFrame, edges: DataFrame, vector: str, dims: int, weight: str, kinds: list[str]
) -> DataFrame:
    """Source vectors times the edge weight, combined at dst."""
    x = hits.select(E, F.col("hit_id").alias("src"), F.col(vector).alias("_x"))
    weighted = join_per_key(edges, x, [E, "src"]).withColumn(
        "_wx", F.transform("_x", lambda v: v * F.col(weight))
    )
    pooled = weighted.groupBy(E, F.col("dst").alias("hit_id")).agg(_vector_agg("_wx", dims, kinds).alias("pooled"))
    empty = F.array_repeat(F.lit(0.0), dims * len(kinds))
    return hits.join(pooled, [E, "hit_id"], "left").withColumn("pooled", F.coalesce("pooled", empty))


def typed_aggregation(edges: DataFrame, column: str, within: str, across: str) -> DataFrame:
    """Edge values combined at dst by edge type, then over the types of a dst."""
    by_type = edges.groupBy(E, "edge_type", "dst").agg(REDUCE[within](F.col(column)).alias(column))
    return by_type.groupBy(E, "dst").agg(REDUCE[across](F.col(column)).alias(column))
