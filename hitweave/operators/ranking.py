"""Ranks and running sums over groups that may be too large for one task.

A plain window over ``event_id`` would sort a whole event in one task. Here rows
are cut into key buckets, ranked inside a bucket, and shifted by the total of the
earlier buckets, so only the tiny table of bucket totals is ordered per group.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WIDTH = 1 << 16
ROWS_PER_BUCKET = 1 << 17


def dense_index(
    df: DataFrame,
    group: list[str],
    order: str,
    out: str,
    width: int | None = BUCKET_WIDTH,
    start: int = 0,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Number the rows of each group by the integer column ``order``, then by ``ties``; together they are unique.

    ``width`` is the key range of a bucket, right for ids that are nearly dense;
    ``None`` measures the range first, for ids such as hashes.
    """
    if width is None:
        low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
        # Few hashes may span all of 64 bits; a bucket then takes a quarter of that range at most.
        width = min(max(1, (high - low + 1) * BUCKET_WIDTH // n), 1 << 62) if n else 1
    bucketed = df.withColumn("_bucket", F.expr(f"{order} div {width}L"))
    keys = [*group, "_bucket"]
    totals = bucketed.groupBy(*keys).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(order, *ties)
    return (
        bucketed.withColumn("_within", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(out, F.col("_offset") + F.col("_within") - 1 + start)
        .drop("_bucket", "_within", "_offset")
    )


def pair_index(edges: DataFrame, group: str, out: str) -> DataFrame:
    """Number the distinct (src, dst) pairs of each group from 0: ids that never collide, in the order of a hash."""
    hashed = edges.withColumn("_hash", F.xxhash64("src", "dst"))
    return dense_index(hashed, [group], "_hash", out, width=None, ties=("src", "dst")).drop("_hash")


def successive_pairs(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, first, second): neighbours in the order of each group, for groups of any size."""
    placed = dense_index(df.select(*group, order), group, order, "_n", width=None)
    first = placed.select(*group, F.col(order).alias("first"), F.col("_n"))
    second = placed.select(*group, F.col(order).alias("second"), (F.col("_n") - 1).alias("_n"))
    return first.join(second, [*group, "_n"]).drop("_n")


def running_sums(df: DataFrame, order: str, sums: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """Inclusive running sums in ascending ``order`` over the whole table.

    Bucket edges come from approximate quantiles, their number from the rows; they shape the
    load only, never the result.
    """
    if buckets is None:
        buckets = max(8, -(-df.count() // ROWS_PER_BUCKET))
    probabilities = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(df.approxQuantile(order, probabilities, 0.5 / buckets)))
    splits = [float("-inf"), *edges, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=order, outputCol="_bucket").transform(
        df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    )
    totals = bucketed.groupBy("_bucket").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy("_bucket").orderBy(order)
    ranked = bucketed.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(offsets, "_bucket")
    return ranked.withColumns({n: F.col(f"_s_{n}") + F.col(f"_o_{n}") for n in sums}).select(*df.columns, *sums)
