"""The audit finds the damaged records, whole trees agree with hashing by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from hitweave.llm import merkle_audit as M


def pages(spark, n):
    rows = [(i, f"http://x/{i}", f"<p>page {i}</p>" * (i % 7)) for i in range(n)]
    rows += [(2, "http://x/2", "<p>page 2</p>" * 2), (None, None, None), (None, "u", "")] if n else []
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, archive string")


@pytest.mark.parametrize("n,archives", [(0, 1), (1, 1), (300, 1), (300, 7)])
def test_damage(spark, n, archives):
    left = pages(spark, n)
    bad = [5, 17, 18, 299]
    changed = F.when(F.col("page_id").isin(bad), F.concat(F.lit("!"), "html")).otherwise(F.col("html"))
    a, b = (M.archive_records(x, archives) for x in (left, left.withColumn("html", changed)))
    got = M.compare_replicas(a, b, fanout=4, levels=3).collect()
    found = {r.page_id for r in got if r.record_no is not None}
    assert found == {i for i in bad if i < n}
    intact = [r for r in got if r.record_no is None]
    assert all(r.root_a == r.root_b for r in intact)
    assert all(r.root_a != r.root_b for r in got if r.record_no is not None)
    assert sum({r.archive: r.n_records for r in got}.values()) == (n + 3 if n else 0)


def test_tree_by_hand(spark):
    leaves = M.archive_records(pages(spark, 20), 1).orderBy("record_no").collect()
    for r in leaves:
        assert r.end > r.begin
    assert [r.begin for r in leaves][1:] == [r.end for r in leaves][:-1]
    sha = lambda parts: hashlib.sha256("\n".join(f"{n}:{d}" for n, d in parts).encode()).hexdigest()
    level = [(r.end - r.begin, r.digest) for r in leaves]
    up = [(sum(n for n, _ in level[i : i + 4]), sha(level[i : i + 4])) for i in range(0, len(level), 4)]
    nodes = M.merkle_nodes(M.archive_records(pages(spark, 20), 1), fanout=4, levels=2)
    assert [r.digest for r in nodes.where("level = 1").orderBy("place").collect()] == [d for _, d in up]
    assert [r.digest for r in nodes.where("level = 2").collect()] == [sha(up)]


def test_missing_record_and_archive(spark):
    left = M.archive_records(pages(spark, 40), 3)
    gone = left.where("archive <> 1 and not (archive = 0 and record_no = 2)")
    got = M.compare_replicas(left, gone).collect()
    assert {r.record_no for r in got if r.archive == 0} == {2}
    assert all(r.root_b is None for r in got if r.archive == 1)
