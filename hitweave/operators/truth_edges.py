"""Truth-track edges: consecutive modules of one particle, outward from its origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import E, first_rows, join_per_key
from .ranking import dense_index


def build_truth_edges(hits: DataFrame, module_columns: list[str], features: list[str]) -> DataFrame:
    """All pairs between the hits of consecutive module groups of a particle.

    Modules are ordered by their nearest hit (``big_r``, then ``hit_id``). The window
    runs over module groups, so its partitions are bounded by the number of modules.
    Hits are shuffled once, by particle; noise, the key of a third of them, is left out.
    """
    keys = [E, "particle_id"]
    signal = hits.where(f"particle_id <> 0 and {E} is not null").repartition(*keys)
    module = F.struct(*module_columns).alias("module")
    start = F.struct(
        F.col("hit_id").alias("src"), F.col("big_r").alias("src_r"), *[F.col(f) for f in features if f not in keys]
    )
    groups = signal.groupBy(*keys, module).agg(
        F.min(F.struct("big_r", "hit_id")).alias("_first"), F.collect_list(start).alias("_starts")
    )
    ends = F.transform("_starts", lambda h: F.struct(h["src"].alias("dst"), h["src_r"].alias("dst_r")))
    outward = Window.partitionBy(*keys).orderBy("_first", "module")
    steps = groups.withColumn("_ends", ends).select(
        *keys,
        F.lead("module").over(outward).alias("next_module"),
        "module",
        "_starts",
        F.lead("_ends").over(outward).alias("_ends"),
    )
    starts = steps.where("next_module is not null").select(*keys, "next_module", "module", "_ends", F.inline("_starts"))
    return starts.select("*", F.inline("_ends")).drop("_ends")


def mark_redundant(edges: DataFrame, module: str = "next_module") -> DataFrame:
    """True on every edge of a particle into a module but the one with the least (R src, R dst)."""
    keys = [E, "particle_id", module]
    place = F.struct("src_r", "dst_r", "src", "dst")
    first = F.min(place).over(Window.partitionBy(*keys))
    return edges.withColumn("redundant_split_edges", place != first)


def inconsistent_features(edges: DataFrame, hits: DataFrame, features: list[str]) -> DataFrame:
    """Edges whose two ends differ in a particle feature; must be empty."""
    values = F.struct(*features)
    src = hits.select(E, "particle_id", F.col("hit_id").alias("src"), values.alias("_src"))
    dst = hits.select(E, "particle_id", F.col("hit_id").alias("dst"), values.alias("_dst"))
    both = edges.select(E, "particle_id", "src", "dst").join(src, [E, "particle_id", "src"]).join(
        dst, [E, "particle_id", "dst"]
    )
    return both.where(~F.col("_src").eqNullSafe(F.col("_dst"))).select(E, "particle_id", "src", "dst")


def unique_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst) of an event: that of the least particle."""
    rest = [c for c in edges.columns if c not in (E, "src", "dst")]
    ordered = ["particle_id", *[c for c in rest if c != "particle_id"]] if "particle_id" in rest else rest
    return first_rows(edges.select(E, "src", "dst", *ordered), [E, "src", "dst"])


def remap_nodes(hits: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hit ids become dense node numbers 0..n-1 by event, in hit-id order."""
    known = hits.select(E, "hit_id").where(f"{E} is not null and hit_id is not null")
    ids = dense_index(known.distinct(), [E], "hit_id", "node_id")
    nodes = hits.join(ids, [E, "hit_id"])
    src = ids.select(E, F.col("hit_id").alias("src"), F.col("node_id").alias("node_src"))
    dst = ids.select(E, F.col("hit_id").alias("dst"), F.col("node_id").alias("node_dst"))
    # Edges that are already placed by source stay there.
    return nodes, join_per_key(edges.join(src, [E, "src"]), dst, [E, "dst"])


def orient_outward(edges: DataFrame, hits: DataFrame, ties_by_id: bool = False) -> DataFrame:
    """Swap the ends of edges that point inward by r^2 + z^2.

    Equally far ends keep their direction, or with ``ties_by_id`` point to the
    greater id, which rules out cycles.
    """
    d = hits.select(E, "hit_id", (F.col("r") * F.col("r") + F.col("z") * F.col("z")).alias("_d"))
    inward = F.col("_ds") > F.col("_dd")
    if ties_by_id:
        inward = inward | ((F.col("_ds") == F.col("_dd")) & (F.col("src") > F.col("dst")))
    placed = join_per_key(edges, d.toDF(E, "src", "_ds"), [E, "src"])
    placed = join_per_key(placed, d.toDF(E, "dst", "_dd"), [E, "dst"])
    return (
        placed.withColumns(
            {
                "src": F.when(inward, F.col("dst")).otherwise(F.col("src")),
                "dst": F.when(inward, F.col("src")).otherwise(F.col("dst")),
            }
        )
        .select(*edges.columns)
    )
