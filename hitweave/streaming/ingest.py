"""Incremental ingest: what is already written is skipped, in batch and from a file stream.

The rows of an event from one origin (a file) are a part, told from others by a digest of
its rows. An event that is spread over several files is kept whole, as every file adds a
part; a part that arrives again, whatever its file, is not written twice. Rows lie in
folders by run and batch; beside them a small ledger lists the parts of each batch, so that
later batches do not read the rows again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import E, join_per_key
from ..session import cut_lineage

RUN, BATCH, ORIGIN = "run", "batch_id", "origin"
#: Spark's readers pass over folders whose names begin with an underscore.
LEDGER = "_ledger"
PART = [E, "n_rows", "digest", "digest_2"]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before the first write."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _folder(path: str, run: str, batch: int) -> str:
    return f"{path}/{RUN}={run}/{BATCH}={batch}"


def parts_of(df: DataFrame) -> DataFrame:
    """(event, origin, n_rows, digests) of each part; the digests depend on the rows and how often each comes, not on their order."""
    columns = sorted(c for c in df.columns if c not in (ORIGIN, RUN, BATCH))
    # Sums, unlike exclusive or, do not cancel rows that come twice; decimals hold them exactly.
    one, two = (F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)") for h in (F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)))
    return df.groupBy(E, ORIGIN).agg(F.count("*").alias("n_rows"), one.alias("digest"), two.alias("digest_2"))


def _note(spark: SparkSession, path: str, run: str, batch: int) -> None:
    """Enter a written batch into the ledger."""
    rows = spark.read.parquet(_folder(path, run, batch))
    parts_of(rows).select(*PART).sortWithinPartitions(E).write.mode("overwrite").parquet(_folder(f"{path}/{LEDGER}", run, batch))


def _batches(spark: SparkSession, path: str) -> set[tuple[str, int]]:
    """(run, batch) of the folders whose write has ended, by their names alone."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{path}/{RUN}=*/{BATCH}=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    folders = [str(f.getPath().getParent()) for f in found or []]
    names = [f.rsplit("/", 2)[1:] for f in folders]
    return {(run.removeprefix(f"{RUN}="), int(batch.removeprefix(f"{BATCH}="))) for run, batch in names}


def written_parts(spark: SparkSession, path: str, run: str, batch: int, events: tuple | None = None) -> DataFrame | None:
    """The parts that batches other than this one have written, of the range of ``events`` (first, last) if given.

    A batch whose rows were written but not entered, as after a crash between the two, is entered
    first. Batches are told from the names of their folders. The ledger is sorted by event, so that
    a range of events reads only the row groups that hold it.
    """
    entered = _batches(spark, f"{path}/{LEDGER}")
    for other in sorted(_batches(spark, path) - entered - {(run, batch)}):
        _note(spark, path, *other)
    ledger = _read(spark, f"{path}/{LEDGER}")
    if ledger is None:
        return None
    if events is not None:
        ledger = ledger.where(F.col(E).between(*events))
    return ledger.where((F.col(RUN) != run) | (F.col(BATCH) != batch)).select(*PART).distinct()


def write_new_events(df: DataFrame, path: str, batch: int, run: str = "batch") -> None:
    """Write the parts that no other batch has written.

    ``df`` may name the ``origin`` of its rows; without, an event's rows in the batch are one
    part. The batch has a folder of its own that is overwritten, so running the same batch of
    the same run again after a failure neither loses nor doubles rows; another run never
    touches it.
    """
    df = df if ORIGIN in df.columns else df.withColumn(ORIGIN, F.lit(""))
    # The same part from two files of this batch is taken once.
    new = cut_lineage(parts_of(df).groupBy(*PART).agg(F.min(ORIGIN).alias(ORIGIN)))
    first, last = new.agg(F.min(E), F.max(E)).first()
    done = None if first is None else written_parts(df.sparkSession, path, run, batch, (first, last))
    if done is not None:
        new = new.join(done, PART, "left_anti")
    rows = join_per_key(df, new.select(E, ORIGIN), [E, ORIGIN], "left_semi")
    rows.write.mode("overwrite").parquet(_folder(path, run, batch))
    _note(df.sparkSession, path, run, batch)


def ingest_stream(
    source: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Start a run over all files that have arrived.

    ``transform`` sees the rows of one micro-batch as an ordinary table with their ``origin``
    and must keep that column. Which files were read is kept in ``checkpoint``, so a later run
    takes only new ones; a run with another checkpoint reads all files and writes those
    parts that are missing, under a run id of its own.
    """
    spark = source.sparkSession
    run = _run_id(spark, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_new_events(transform(batch), path, batch_id, run)

    return (
        source.withColumn(ORIGIN, F.input_file_name())
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint keeps beside its state, made on first use."""
    kept = f"{checkpoint}-run"
    try:
        return spark.read.text(kept).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    run = uuid.uuid4().hex
    spark.range(1).select(F.lit(run).alias("value")).coalesce(1).write.text(kept)
    return run
