"""Edge lists: features, types, direction and de-duplication."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import safe_slope, wrap_angle
from ..session import checkpoint_root
from .joins import E, endpoints, gather, join_per_key


def add_edge_features(edges: DataFrame, hits: DataFrame, features: list[str]) -> DataFrame:
    """Differences dst - src; phi is in units of pi."""
    both = gather(edges, hits, ["r", "phi", "z", "eta"])

    def diff(c: str) -> Column:
        return F.col(f"{c}_dst") - F.col(f"{c}_src")

    dphi = wrap_angle(diff("phi") * math.pi) / math.pi
    slope = safe_slope(dphi, diff("r"))
    known = {
        "dr": diff("r"),
        "dphi": dphi,
        "dz": diff("z"),
        "deta": diff("eta"),
        "phislope": slope,
        "rphislope": F.nanvl((F.col("r_dst") + F.col("r_src")) / 2.0 * slope, F.lit(0.0)),
    }
    out = both.withColumns({f: known[f] for f in features})
    return out.drop(*[f"{c}_{s}" for c in ("r", "phi", "z", "eta") for s in ("src", "dst")])


def scale(df: DataFrame, scales: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(s)) for c, s in scales.items()})


def unscale(df: DataFrame, scales: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(float(s)) for c, s in scales.items()})


def add_node_type(hits: DataFrame, groups: list[dict]) -> DataFrame:
    """``node_type``: number of the last region group that holds the hit's region, else 0."""
    kind = F.lit(0)
    for i, group in enumerate(groups):
        kind = F.when(F.col("region").isin(group["id"]), F.lit(i)).otherwise(kind)
    names = F.array(*[F.lit(g["name"]) for g in groups])
    typed = hits.withColumn("node_type", kind.cast("bigint"))
    return typed.withColumn("node_type_name", F.get(names, F.col("node_type").cast("int")))


def add_edge_type(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """``edge_type``: number of (src type, dst type) in the product of the types present in the event."""
    present = hits.groupBy(E).agg(F.array_sort(F.collect_set("node_type")).alias("_types"))
    both = join_per_key(gather(edges, hits, ["node_type", "node_type_name"]), present, [E])
    place = lambda c: F.array_position("_types", F.col(c)) - 1
    number = place("node_type_src") * F.size("_types") + place("node_type_dst")
    return both.withColumns(
        {
            "edge_type": number.cast("bigint"),
            "edge_type_name": F.concat_ws("__", "node_type_name_src", F.lit("to"), "node_type_name_dst"),
        }
    ).drop("_types")


def split_by_type(hits: DataFrame, edges: DataFrame, names: list[str]) -> tuple[dict, dict]:
    """Typed parts of a graph: hits by type name and edges by (src, "to", dst).

    Both tables are written once, in a folder for each type, and a part reads its folder alone.
    """
    spark = hits.sparkSession
    path = f"{checkpoint_root(spark)}/typed/{uuid.uuid4().hex}"
    ends = ["node_type_name_src", "node_type_name_dst"]
    hits.write.partitionBy("node_type_name").parquet(f"{path}/nodes")
    edges.write.partitionBy(*ends).parquet(f"{path}/edges")
    read = lambda name, like: spark.read.schema(like.schema).parquet(f"{path}/{name}").select(*like.columns)
    nodes, links = read("nodes", hits), read("edges", edges)
    by_type = {n: nodes.where(F.col("node_type_name") == n) for n in names}
    by_ends = {(a, "to", b): links.where((F.col(ends[0]) == a) & (F.col(ends[1]) == b)) for a in names for b in names}
    return by_type, by_ends


def undirected_unique(edges: DataFrame, track_edges: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """One edge per unordered pair (true if either direction is), direction flipped by a hash bit.

    The new ``edge_id`` is the least of the pair's; track edges are linked to it.
    """
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = edges.groupBy(E, lo.alias("_lo"), hi.alias("_hi")).agg(
        F.min("edge_id").alias("edge_id"), F.bool_or("y").alias("y")
    )
    flip = F.pmod(F.xxhash64(E, "_lo", "_hi", F.lit(seed)), F.lit(2)) == 1
    kept = pairs.select(
        E,
        "edge_id",
        F.when(flip, F.col("_hi")).otherwise(F.col("_lo")).alias("src"),
        F.when(flip, F.col("_lo")).otherwise(F.col("_hi")).alias("dst"),
        "y",
    )
    keyed = track_edges.drop("edge_id").withColumns({"_lo": lo, "_hi": hi})
    linked = keyed.join(pairs.select(E, "_lo", "_hi", "edge_id"), [E, "_lo", "_hi"], "left").drop("_lo", "_hi")
    return kept, linked


def to_undirected(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse; ``reversed`` tells them apart, features repeat."""
    forward = edges.withColumn("reversed", F.lit(False))
    back = edges.withColumns({"src": F.col("dst"), "dst": F.col("src"), "reversed": F.lit(True)})
    return forward.unionByName(back)


def directed_decision(edges: DataFrame, cut: float) -> DataFrame:
    """Per unordered pair of bidirectional scored edges: ``loose`` any, ``tight`` all above the cut."""
    passes = F.col("score") > cut
    return edges.groupBy(E, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.bool_or(passes).alias("loose"), F.bool_and(passes).alias("tight")
    )


def mean_of_directions(edges: DataFrame, column: str = "score") -> DataFrame:
    """Average of a value over both directions of a pair."""
    return edges.groupBy(E, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.avg(column).alias(column)
    )


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every hit that has an edge."""
    ends = endpoints(edges)
    return ends.groupBy(E, "hit_id").agg(
        F.count_if(F.col("place") == 1).alias("in_degree"), F.count_if(F.col("place") == 0).alias("out_degree")
    )
