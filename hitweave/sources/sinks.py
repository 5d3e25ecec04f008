"""Sinks: event tables, graph tables, track lines and the result summary."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.joins import E

#: Files that get their final names at once.
RENAMES = 16


def write_event_csv(df: DataFrame, path: str) -> None:
    """CSV files in folders by dataset and event."""
    keys = [c for c in ("dataset", E) if c in df.columns]
    df.repartition(*keys).write.partitionBy(*keys).mode("overwrite").option("header", "true").csv(path)


def write_event_files(df: DataFrame, path: str, name: str, kind: str, order: list[str], columns: list[str] | None = None) -> None:
    """One file per event in ``path``, called ``name`` with the event's number, rows in ``order``, all columns or those named.

    Spark writes the files of all events into a folder beside their own, commits them, and only then
    are they renamed, so a failed job leaves no file under a final name; writing again replaces them.
    A file is written by one task, which sorts its event on disk where memory does not hold it.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    hidden = f"{path}/_writing-{uuid.uuid4().hex}"
    dealt = df.repartition(E).sortWithinPartitions(E, *order)
    # Dropping a column keeps the order of the rows.
    dealt = dealt.select(E, *(columns or [c for c in df.columns if c != E]))
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def name_file(folder: str) -> None:
        target = hadoop.Path(path, name.format(int(folder.removeprefix(f"{E}="))))
        for found in files.listStatus(hadoop.Path(hidden, folder)):
            files.delete(target, False)
            if not files.rename(found.getPath(), target):
                raise OSError(f"{found.getPath()} could not be renamed to {target}")

    try:
        # Nobody reads the hidden folder before the job is done: tasks move their own files into it (version 2),
        # instead of the driver, after the job, one event at a time.
        written = dealt.write.partitionBy(E).option("header", "true").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        written.format(kind).save(hidden)
        folders = (status.getPath().getName() for status in files.listStatus(hadoop.Path(hidden)))
        # A name is a round trip to the store, so many are under way at once.
        with ThreadPoolExecutor(RENAMES) as pool:
            for _ in pool.map(name_file, [f for f in folders if f.startswith(f"{E}=")]):
                pass
    finally:
        files.delete(hadoop.Path(hidden), True)


def write_graph(
    nodes: DataFrame, edges: DataFrame, track_edges: DataFrame, path: str, config: dict, checks: dict[str, dict[str, Column]] | None = None
) -> dict[str, dict[str, int]]:
    """Nodes, edges and track edges as Parquet, each row carrying the configuration it was made with.

    Returns, for each table, the number of rows written and of the rows for which each of its
    ``checks`` holds; they are counted by the jobs that write.
    """
    counted = {}
    provenance = F.lit(json.dumps(config, sort_keys=True))
    for name, df in (("nodes", nodes), ("edges", edges), ("track_edges", track_edges)):
        keys = ["dataset"] if "dataset" in df.columns else []
        # Range partitioning on the event splits a large event over several files,
        # and keeps row-group statistics on event_id tight.
        second = next(c for c in ("hit_id", "src") if c in df.columns)
        out = df.withColumn("config", provenance).repartitionByRange(*keys, E, second).sortWithinPartitions(*keys, E)
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        found = {c: F.count_if(holds) for c, holds in (checks or {}).get(name, {}).items()}
        out = out.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[n.alias(c) for c, n in found.items()])
        out.write.partitionBy(*keys).mode("overwrite").parquet(f"{path}/{name}")
        counted[name] = seen.get
    return counted


def track_lines(track_hits: DataFrame) -> DataFrame:
    """(event_id, track_id, value): hit ids of one track, ascending, separated by blanks."""
    hits = F.array_sort(F.collect_list("hit_id"))
    return (
        track_hits.where("track_id >= 0")
        .groupBy(E, "track_id")
        .agg(F.concat_ws(" ", F.transform(hits, lambda h: h.cast("string"))).alias("value"))
    )


def write_track_lines(track_hits: DataFrame, path: str) -> None:
    """One text folder per event, tracks in id order."""
    lines = track_lines(track_hits).repartitionByRange(E, "track_id").sortWithinPartitions(E, "track_id")
    lines.select(E, "value").write.partitionBy(E).mode("overwrite").text(path)


def write_track_files(track_hits: DataFrame, path: str) -> None:
    """One text file ``event000000001.txt`` per event, a line for each track in the order of their ids."""
    write_event_files(track_lines(track_hits), path, "event{:09d}.txt", "text", ["track_id"], ["value"])


def summary_lines(summary: DataFrame) -> DataFrame:
    """Eight text lines (line, value) of a one-row summary table."""

    def count(name):
        return F.col(name).cast("bigint").cast("string")

    def rate(name):
        # Three decimals; exact halves, which are multiples of 1/16, go to the even digit.
        even = F.bround(F.col(name).cast("decimal(20,6)"), 3).cast("decimal(20,3)").cast("string")
        is_half = F.col(name) * 16 == F.floor(F.col(name) * 16)
        return F.when(is_half, even).otherwise(F.format_string("%.3f", F.col(name)))

    lines = [
        ("Number of reconstructed particles", count("n_reconstructed_particles")),
        ("Number of particles", count("n_particles")),
        ("Number of matched tracks", count("n_matched_tracks")),
        ("Number of tracks", count("n_tracks")),
        ("Number of duplicate reconstructed particles", count("n_duplicates")),
        ("Efficiency", rate("efficiency")),
        ("Fake rate", rate("fake_rate")),
        ("Duplication rate", rate("duplication_rate")),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("line"), F.concat(F.lit(f"{text}: "), value).alias("value"))
            for i, (text, value) in enumerate(lines)
        ]
    )
    return summary.select(F.inline(rows))


def write_summary(summary: DataFrame, path: str) -> None:
    summary_lines(summary).coalesce(1).sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)
