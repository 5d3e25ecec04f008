"""Scores of edges from endpoint features, by a given network or a fitted model."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import sigmoid
from ..functions.inference import Mlp, score_udf
from ..functions.vectors import stack
from ..session import cut_lineage, release
from .joins import E, gather


def edge_vectors(edges: DataFrame, hits: DataFrame, features: list[str]) -> DataFrame:
    """``features``: src then dst hit features."""
    x = hits.select(E, "hit_id", stack(features).alias("_x"))
    return gather(edges, x, ["_x"]).withColumn("features", F.concat("_x_src", "_x_dst")).drop("_x_src", "_x_dst")


def score_edges(edges: DataFrame, hits: DataFrame, features: list[str], network: Mlp) -> DataFrame:
    """Raw ``output`` of the network and its sigmoid ``score``, in Arrow batches of edges."""
    vectors = edge_vectors(edges.drop("score"), hits, features)
    scored = vectors.withColumn("output", score_udf(network)("features")).drop("features")
    return scored.withColumn("score", sigmoid("output"))


def fit_edge_classifier(
    edges: DataFrame, hits: DataFrame, features: list[str], max_iter: int = 20
) -> LogisticRegressionModel:
    """Weighted logistic fit: positives are true edges of positive weight, negative weights count as fakes.

    The rows of the fit are written first, so that its passes read one narrow table and do not repeat the joins.
    """
    usable = edges.where("weight <> 0").select(E, "src", "dst", (F.col("y") & (F.col("weight") > 0)).alias("label"), F.abs("weight").alias("w"))
    rows = cut_lineage(edge_vectors(usable, hits, features).select("features", "label", "w"))
    vectors = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), "w")
    model = LogisticRegression(maxIter=max_iter, weightCol="w").fit(vectors)
    release(rows)
    return model


def apply_edge_classifier(
    model: LogisticRegressionModel, edges: DataFrame, hits: DataFrame, features: list[str]
) -> DataFrame:
    """``score``: the fitted probability, as a column expression of the coefficients; plans hold no fitted object."""
    vectors = edge_vectors(edges.drop("score"), hits, features)
    return vectors.withColumn("score", _probability(model, "features")).drop("features")


def _probability(model: LogisticRegressionModel, features: str) -> Column:
    margin = F.lit(float(model.intercept))
    for i, weight in enumerate(model.coefficients):
        margin = margin + F.get(features, F.lit(i)) * F.lit(float(weight))
    return sigmoid(margin)


def mean_gradient(scored: DataFrame, hits: DataFrame, features: list[str]) -> DataFrame:
    """(n_used, worst): the largest part of the weighted mean gradient of the fit, which is 0 at its optimum."""
    usable = edge_vectors(scored.where("weight <> 0"), hits, features)
    label = (F.col("y") & (F.col("weight") > 0)).cast("double")
    miss = F.abs("weight") * (F.col("score") - label)
    parts = [F.abs(F.sum(miss)), *[F.abs(F.sum(miss * F.get("features", F.lit(i)))) for i in range(2 * len(features))]]
    return usable.agg(F.count("*").alias("n_used"), (F.greatest(*parts) / F.sum(F.abs("weight"))).alias("worst"))
