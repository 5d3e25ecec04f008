import numpy as np
from pyspark.sql import functions as F

from hitweave.operators.joins import first_rows, join_per_key, left_join_spread
from hitweave.operators.ranking import dense_index, pair_index, running_sums


def test_dense_index_over_buckets(spark):
    rng = np.random.default_rng(0)
    data = [(e, int(i)) for e in (1, 2) for i in rng.choice(1000, 60, replace=False)]
    df = spark.createDataFrame(data, "event_id long, hit_id long")
    for width in (7, 1 << 16, None):
        got = {(r.event_id, r.hit_id): r.n for r in dense_index(df, ["event_id"], "hit_id", "n", width).collect()}
        for e in (1, 2):
            ids = sorted(i for ev, i in data if ev == e)
            assert [got[(e, i)] for i in ids] == list(range(60))


def test_dense_index_over_few_hashes(spark):
    data = [(1, -(2**63)), (1, 2**63 - 1), (1, 0), (2, 5)]
    df = spark.createDataFrame(data, "event_id long, h long")
    got = sorted((r.event_id, r.h, r.n) for r in dense_index(df, ["event_id"], "h", "n", width=None).collect())
    assert got == [(1, -(2**63), 0), (1, 0, 1), (1, 2**63 - 1, 2), (2, 5, 0)]


def test_pair_index_is_dense(spark):
    df = spark.createDataFrame([(e, a, b) for e in (1, 2) for a in range(30) for b in range(20)], "event_id long, src long, dst long")
    rows = pair_index(df, "event_id", "n").collect()
    assert sorted(r.n for r in rows if r.event_id == 1) == list(range(600)) and len({(r.src, r.dst) for r in rows}) == 600


def test_running_sums(spark):
    data = [(float(x), int(x) % 5) for x in np.random.default_rng(1).permutation(500)]
    df = spark.createDataFrame(data, "x double, v long")
    got = {r.x: r.s for r in running_sums(df, "x", {"s": F.col("v")}, buckets=8).collect()}
    total = 0
    for x, v in sorted(data):
        total += v
        assert got[x] == total


def test_left_join_spread_keeps_rows(spark):
    left = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 5, 3), (2, 5, 1), (2, None, 4)], "event_id int, pid int, h int")
    right = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "event_id int, pid int, v string")
    out = left_join_spread(left, right, ["event_id", "pid"], F.col("pid") == 0, ["h"])
    got = sorted((r.event_id, r.h, r.v or "") for r in out.collect())
    assert got == [(1, 1, ""), (1, 2, ""), (1, 3, "a"), (2, 1, "b"), (2, 4, "")]


def test_hot_key_is_split(spark):
    """The aggregate's partitioning is not reused, so the adaptive skew join can cut the hot key."""
    names = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000 + 100).alias("event_id"),
            F.xxhash64("id").alias("x"),
        )
        values = rows.groupBy("event_id").agg(F.max("x").alias("m"))
        out = join_per_key(rows, values, ["event_id"])
        assert out.count() == 200_000
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_first_rows_is_order_free(spark):
    data = [(1, "b", 2), (1, "a", 9), (2, "z", 0)]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "k int, s string, n int")
        assert sorted(map(tuple, first_rows(df, ["k"]).collect())) == [(1, "a", 9), (2, "z", 0)]
