"""Seeded samples: query points, random pairs, negatives and training edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..session import cut_lineage
from .joins import E, join_per_key
from .neighbours import radius_neighbours
from .ranking import dense_index


def query_points(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` random points of every event, by a seeded hash; the rank limit is applied before the shuffle."""
    order = Window.partitionBy(E).orderBy(draw(E, "hit_id", seed=seed), "hit_id")
    return points.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def _drawn(
    draws: DataFrame, pool: DataFrame, keys: list[str], out: str, seed: int, by: tuple[str, ...] = ("_draw",)
) -> DataFrame:
    """One pool id per draw, uniform with replacement; ``by`` tells the draws of a key apart."""
    numbered = dense_index(pool.select(*keys, "_id"), keys, "_id", "_place", width=None)
    sizes = pool.groupBy(*keys).agg(F.count("*").alias("_size"))
    place = F.pmod(draw(*keys, *by, seed=seed), F.col("_size"))
    placed = join_per_key(draws, sizes, keys).withColumn("_place", place).drop("_size")
    return placed.join(numbered, [*keys, "_place"]).withColumnRenamed("_id", out).drop("_place")


def random_pairs(queries: DataFrame, points: DataFrame, per_query: float, seed: int = 0) -> DataFrame:
    """``int(per_query * queries)`` pairs per event: a random query and a random point."""
    ids = dense_index(queries.select(E, "hit_id"), [E], "hit_id", "_i")
    sizes = ids.groupBy(E).agg(F.count("*").alias("_queries"))
    turns = F.explode(F.sequence(F.lit(0), F.lit(int(-(-per_query // 1)))))
    draws = join_per_key(ids, sizes, [E]).select(E, "_queries", "_i", turns.alias("_turn"))
    draws = draws.withColumn("_draw", F.col("_i") + F.col("_turn") * F.col("_queries"))
    draws = draws.where(F.col("_draw") < F.floor(F.col("_queries") * per_query)).select(E, "_draw")
    src = queries.select(E, F.col("hit_id").alias("_id"))
    dst = points.select(E, F.col("hit_id").alias("_id"))
    both = _drawn(_drawn(draws, src, [E], "src", seed), dst, [E], "dst", seed + 1)
    return both.select(E, "src", "dst")


def training_edges(
    points: DataFrame,
    vector: str,
    dims: int,
    signal: DataFrame,
    n_queries: int,
    r: float,
    k: int,
    randomisation: float,
    undirected: bool = True,
    seed: int = 0,
) -> DataFrame:
    """Distinct union of hard negatives (near pairs of sampled queries), random pairs and signal edges."""
    queries = query_points(points, n_queries, seed)
    near = radius_neighbours(points, vector, dims, r, k, queries=queries).select(E, "src", "dst")
    drawn = random_pairs(queries, points, randomisation, seed)
    true = signal.select(E, "src", "dst")
    if undirected:
        true = true.unionByName(true.select(E, F.col("dst").alias("src"), F.col("src").alias("dst")))
    return near.unionByName(drawn).unionByName(true).distinct()


def subsample_negatives(edges: DataFrame, ratio: int, cut: float, seed: int = 0) -> DataFrame:
    """All signal-true edges, and per event ``ratio`` times as many hard and as many easy negatives.

    Negatives are drawn with replacement; an empty class falls back to all negatives.
    Draws are made from the true edges themselves, so they are as spread as those.
    """
    edges = cut_lineage(edges)
    true = edges.where(F.col("y") & (F.col("weight") > 0))
    negative = edges.where((~F.col("y") & (F.col("weight") != 0)) | (F.col("weight") < 0))
    hard = (F.col("score") > cut).cast("int")
    pool = negative.select(E, F.col("edge_id").alias("_id"), hard.alias("_hard"))
    sizes = pool.groupBy(E).agg(F.sum("_hard").alias("_n_hard"), F.sum(1 - F.col("_hard")).alias("_n_easy"))
    turns = F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))).alias("_turn")
    draws = true.select(E, "edge_id", turns, F.explode(F.array(F.lit(1), F.lit(0))).alias("_hard"))
    missing = F.when(F.col("_hard") == 1, F.col("_n_hard")).otherwise(F.col("_n_easy")) == 0
    draws = join_per_key(draws, sizes, [E]).select(
        E,
        F.when(missing, F.lit(2)).otherwise(F.col("_hard")).alias("_class"),
        F.struct("edge_id", "_turn", "_hard").alias("_draw"),
    )
    classes = pool.select(E, "_id", F.explode(F.array(F.col("_hard"), F.lit(2))).alias("_class"))
    by = ("_draw.edge_id", "_draw._turn", "_draw._hard")
    drawn = _drawn(draws, classes, [E, "_class"], "edge_id", seed, by).select(E, "edge_id", F.col("_draw._hard").alias("_hard"))
    kind = F.when(F.col("_hard") == 1, F.lit("hard")).otherwise(F.lit("easy"))
    sampled = drawn.select(E, "edge_id", kind.alias("sample")).join(edges, [E, "edge_id"])
    return true.withColumn("sample", F.lit("true")).unionByName(sampled.select(*true.columns, "sample"))
