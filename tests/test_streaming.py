from pyspark.sql import functions as F

from hitweave.streaming.ingest import ingest_stream, write_new_events, written_parts

SCHEMA = "event_id long, hit_id long"


def events(spark, *ids):
    return spark.createDataFrame([(e, h) for e in ids for h in range(3)], SCHEMA)


def counts(spark, path):
    return sorted((r.event_id, r["count"]) for r in spark.read.parquet(path).groupBy("event_id").count().collect())


def test_batches_skip_written_events(spark, tmp_path):
    out = f"{tmp_path}/out"
    write_new_events(events(spark, 1, 2), out, 0)
    write_new_events(events(spark, 2, 3), out, 1)
    assert counts(spark, out) == [(1, 3), (2, 3), (3, 3)]
    # the same batch once more, as after a failure
    write_new_events(events(spark, 2, 3), out, 1)
    assert counts(spark, out) == [(1, 3), (2, 3), (3, 3)]


def test_rows_that_come_twice(spark, tmp_path):
    """Parts {a, a} and {b, b} of one event differ, as do {a, a, c} and {b, b, c}; both stay."""
    out = f"{tmp_path}/out"
    rows = lambda *hits: spark.createDataFrame([(1, h) for h in hits], SCHEMA)
    parts = [rows(5, 5), rows(7, 7), rows(5, 5, 1), rows(7, 7, 1), rows(5)]
    for batch, part in enumerate(parts):
        write_new_events(part, out, batch)
    assert counts(spark, out) == [(1, 11)]
    for batch, part in enumerate(parts):
        write_new_events(part, out, 10 + batch)
    assert counts(spark, out) == [(1, 11)]
    both = parts[0].withColumn("origin", F.lit("x")).unionByName(parts[1].withColumn("origin", F.lit("y")))
    write_new_events(both, f"{tmp_path}/other", 0)
    assert counts(spark, f"{tmp_path}/other") == [(1, 4)]


def test_a_batch_looks_at_its_own_events(spark, tmp_path):
    out = f"{tmp_path}/out"
    write_new_events(events(spark, 1, 50), out, 0)
    write_new_events(events(spark, 90), out, 1)
    near = written_parts(spark, out, "batch", 7, (40, 60))
    assert [r.event_id for r in near.collect()] == [50]
    write_new_events(events(spark, 50, 60), out, 2)
    assert counts(spark, out) == [(1, 3), (50, 3), (60, 3), (90, 3)]


def test_crash_before_the_ledger(spark, tmp_path):
    out = f"{tmp_path}/out"
    events(spark, 1).withColumn("origin", F.lit("")).write.parquet(f"{out}/run=a/batch_id=0")
    write_new_events(events(spark, 1, 2), out, 0, "b")
    assert counts(spark, out) == [(1, 3), (2, 3)]


def test_event_in_two_files_and_a_new_checkpoint(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(state):
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest_stream(stream, lambda df: df, out, f"{tmp_path}/{state}").awaitTermination()

    spark.createDataFrame([(1, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run("state")
    spark.createDataFrame([(1, 1), (2, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run("state")
    assert counts(spark, out) == [(1, 2), (2, 1)]
    run("other")
    assert counts(spark, out) == [(1, 2), (2, 1)]
    run("state")
    assert counts(spark, out) == [(1, 2), (2, 1)]


def test_stream_takes_only_new_files(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest_stream(stream, lambda df: df.withColumn("twice", F.col("hit_id") * 2), out, state).awaitTermination()

    events(spark, 1, 2).write.mode("append").parquet(source)
    run()
    assert counts(spark, out) == [(1, 3), (2, 3)]
    run()
    events(spark, 2, 5).write.mode("append").parquet(source)
    run()
    assert counts(spark, out) == [(1, 3), (2, 3), (5, 3)]
    assert "twice" in spark.read.parquet(out).columns
