"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters the records by a seeded hash of all their columns into buckets that fit a
task's memory. Pass two shuffles each bucket with Fisher-Yates and writes it. Buckets lie end to
end in one global order, whose equal ranges are the shards: their counts differ by at most
one, and a bucket goes to as few shards as it can.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..session import checkpoint_root

SHARDS = 24
BUCKET_BYTES = 8 << 20
SEED = 20240613
#: Buckets whose running count one task keeps; the groups of them are summed in one more.
GROUP = 4096
#: Columns of these names in the input give way to the operator's own.
OWN = ["_bucket", "_tie", "_rows", "_from", "_shard", "_slot"]


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 8; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """Random order of n rows: each place from the last swaps with one drawn from those up to it."""
    order = np.arange(n)
    draws = rng.integers(0, np.arange(1, n + 1)) if n else order
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def _starts(counts: DataFrame) -> DataFrame:
    """(_bucket, _from): rows in the buckets before each, summed inside groups of buckets and over the groups."""
    grouped = counts.withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    upto = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda column, order: F.coalesce(F.sum(column).over(upto(order)), F.lit(0))
    totals = grouped.groupBy("_group").agg(F.sum("_rows").alias("_total"))
    ahead = totals.select("_group", earlier("_total", Window.orderBy("_group")).alias("_ahead"))
    inside = grouped.withColumn("_inside", earlier("_rows", Window.partitionBy("_group").orderBy("_bucket")))
    return inside.join(ahead, "_group").select("_bucket", (F.col("_ahead") + F.col("_inside")).alias("_from"))


def external_shuffle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    path: str | None = None,
) -> DataFrame:
    """Write all rows, shuffled, as Parquet under ``path`` by ``_shard`` and return the written table.

    The result has the columns of ``docs`` and ``_shard`` and ``_slot`` (gapless from 0 in
    each shard). One seed gives one order, whatever the partitions. Rows with the same id
    are scattered like any others; only rows equal in every column share a bucket, where they
    may trade places. A null id is a value like any other and a null text has size 8. Without ``path`` the table goes to the folder of
    ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    docs = docs.drop(*OWN)
    path = path or f"{checkpoint_root(spark)}/shards/{uuid.uuid4().hex}"
    size = docs.agg(F.coalesce(F.sum(record_size(F.col(text))), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    total, buckets = size["n"], max(1, -(-size["b"] // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *docs.columns), F.lit(buckets))
    counts = docs.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_rows"))
    starts = _starts(counts)
    scattered = docs.withColumns({"_bucket": bucket, "_tie": F.xxhash64(*docs.columns)}).join(starts, "_bucket")
    schema = StructType([*docs.schema.fields]).add("_shard", IntegerType()).add("_slot", LongType())
    names = docs.columns

    def deal(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(doc_id, "ascending"), ("_tie", "ascending")])
        order = fisher_yates(len(rows), np.random.default_rng([seed, key[0].as_py()]))
        place = rows["_from"][0].as_py() + np.arange(len(rows))
        shard = place * shards // total
        out = rows.select(names).take(pa.array(order))
        slot = place - -(-shard * total // shards)
        return out.append_column("_shard", pa.array(shard, pa.int32())).append_column("_slot", pa.array(slot, pa.int64()))

    dealt = scattered.groupBy("_bucket").applyInArrow(deal, schema)
    dealt.write.partitionBy("_shard").parquet(path)
    return spark.read.schema(schema).parquet(path)
