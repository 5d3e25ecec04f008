"""The shuffled table holds every row once, in equal shards, in an order that only the seed decides."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from hitweave.llm import external_shuffle as X


def rows(n):
    out = [(i, f"text {i} " * (i % 50), "é") for i in range(n)]
    return out + [(5, "text 5 " * 5, "é")] * 3 + [(None, None, None), (None, "", "x"), (n + 1, "long " * 30_000, None)]


@pytest.mark.parametrize("n,bucket_bytes", [(500, 4096), (500, 1 << 30), (3, 4096)])
def test_shards(spark, n, bucket_bytes):
    data = rows(n)
    frame = spark.createDataFrame([(a, b, c, 7) for a, b, c in data], "doc_id long, text string, lang string, _slot int")
    first = X.external_shuffle(frame.repartition(3), bucket_bytes=bucket_bytes).collect()
    second = X.external_shuffle(frame.repartition(7), bucket_bytes=bucket_bytes).collect()
    place = lambda got: sorted((r._shard, r._slot, str(r.doc_id), r.text) for r in got)
    assert place(first) == place(second)
    assert Counter((r.doc_id, r.text, r.lang) for r in first) == Counter(data)
    slots = defaultdict(list)
    for r in first:
        slots[r._shard].append(r._slot)
    sizes = [len(slots[s]) for s in range(X.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    other = X.external_shuffle(frame, bucket_bytes=bucket_bytes, seed=1).collect()
    assert n < 10 or place(other) != place(first)


@pytest.mark.parametrize("hot", ["7", "CAST(null AS long)"])
def test_hot_id_is_scattered(spark, hot):
    """Rows of one id, or of none, do not share a bucket, so that they lie in every shard like the rest."""
    frame = spark.range(6000).selectExpr(f"CASE WHEN id % 3 = 0 THEN {hot} ELSE id END doc_id", "concat('text ', id) text")
    got = X.external_shuffle(frame, bucket_bytes=4096).collect()
    held = Counter(r._shard for r in got if r.doc_id is None or r.doc_id == 7)
    assert len(got) == 6000 and len(held) == X.SHARDS and max(held.values()) < 200


def test_order_is_uniform():
    rng = np.random.default_rng(1)
    counts = Counter(tuple(X.fisher_yates(4, rng)) for _ in range(24_000))
    assert len(counts) == 24 and min(counts.values()) > 800 and max(counts.values()) < 1200


def test_empty(spark):
    assert X.external_shuffle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
