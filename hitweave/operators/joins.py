"""Join helpers that keep sentinel keys from piling up in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

E = "event_id"
SPREAD = 1024


def left_join_spread(
    left: DataFrame, right: DataFrame, on: list[str], unmatched: Column, by: list[str], spread: int = SPREAD
) -> DataFrame:
    """Left join where rows flagged ``unmatched`` are known to match nothing.

    Such rows (noise particle 0, null links) can be a third of the table and share
    one key; an extra key drawn from ``by`` sends them to many tasks.
    """
    salt = F.when(F.coalesce(unmatched, F.lit(True)), F.pmod(F.xxhash64(*by), F.lit(spread)) + 1).otherwise(F.lit(0))
    # pmod(.., 1) is always 0, yet not a literal the optimizer could fold away.
    zero = F.pmod(F.xxhash64(*on), F.lit(1))
    return (
        left.withColumn("_salt", salt.cast("bigint"))
        .join(right.withColumn("_salt", zero), [*on, "_salt"], "left")
        .drop("_salt")
    )


def endpoints(edges: DataFrame, *keep: str) -> DataFrame:
    """One row per (edge, endpoint): columns event_id, hit_id, place (0 src, 1 dst)."""
    ends = F.array(
        F.struct(F.lit(0).alias("place"), F.col("src").alias("hit_id")),
        F.struct(F.lit(1).alias("place"), F.col("dst").alias("hit_id")),
    )
    return edges.select(E, *keep, F.inline(ends))


def gather(edges: DataFrame, hits: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Add ``<column>_src`` and ``<column>_dst`` to every edge."""
    narrow = hits.select(E, "hit_id", *columns)
    src = narrow.toDF(E, "src", *[f"{c}_src" for c in columns])
    dst = narrow.toDF(E, "dst", *[f"{c}_dst" for c in columns])
    # A hub may be an end of a large part of the edges.
    return join_per_key(join_per_key(edges, src, [E, "src"], how), dst, [E, "dst"], how)


def keep_both_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    nodes = nodes.select(E, "hit_id")
    kept = join_per_key(edges, nodes.toDF(E, "src"), [E, "src"], "left_semi")
    return join_per_key(kept, nodes.toDF(E, "dst"), [E, "dst"], "left_semi")


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the least of the remaining columns, pruned to one row per key and task before the shuffle.

    Unlike ``dropDuplicates`` the choice does not depend on row order. Plain columns take fewer bytes in the
    shuffle than the least struct would.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    least = Window.partitionBy(*keys).orderBy(*rest)
    return df.withColumn("_place", F.row_number().over(least)).where("_place = 1").drop("_place")


def join_per_key(rows: DataFrame, values: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Bring one row per key (an aggregate, a hit) to the many rows of that key.

    Without care the partitioning of an aggregate would be reused and a hot key would
    meet in one task. The extra key, always 0 but not a literal, makes both sides plain
    shuffles of this join, and those the adaptive skew join cuts into as many tasks
    as a hot key needs.
    """
    zero = F.pmod(F.xxhash64(*keys), F.lit(1))
    return (
        rows.withColumn("_zero", zero).join(values.withColumn("_zero", zero), [*keys, "_zero"], how).drop("_zero")
    )
