"""Event files: discovery, CSV tables, event selection and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import DRAW_BITS, draw
from ..operators.joins import E

EVENT_NUMBER = "([0-9]+)[^0-9]*$"


def event_files(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """(event_id, term, path) of the events that have a file for every term.

    The listing is a ``binaryFile`` scan that never reads file content.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return complete_events(paths, terms)


def complete_events(paths: DataFrame, terms: list[str]) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    term = F.explode(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(name, t)))
    tagged = paths.select("path", F.regexp_extract("path", EVENT_NUMBER, 1).alias("_number"), term.alias("term"))
    tagged = tagged.where("_number <> ''").select(F.col("_number").cast("bigint").alias(E), "term", "path")
    chosen = tagged.groupBy(E, "term").agg(F.min("path").alias("path"))
    whole = chosen.groupBy(E).agg(F.count("term").alias("n")).where(F.col("n") == len(terms))
    return chosen.join(whole.select(E), E, "left_semi")


def read_event_csv(spark: SparkSession, path: str, schema: str, number: str = EVENT_NUMBER) -> DataFrame:
    """CSV files of many events as one table, event number from the path by the pattern ``number``."""
    reader = spark.read.schema(schema).option("header", "true")
    folder, _, pattern = path.rpartition("/")
    if pattern.endswith(".csv") and not set(folder) & set("*?[{"):
        # The folder is listed once; as a path, each file that the pattern names would be listed by itself.
        columns = reader.option("pathGlobFilter", pattern).csv(folder)
    else:
        columns = reader.csv(path)
    event = F.regexp_extract("_metadata.file_path", number, 1).cast("bigint")
    return columns.select(event.alias(E), *columns.columns)


def first_events(df: DataFrame, n: int, require: bool = False) -> DataFrame:
    """Rows of the ``n`` lowest event ids; the n ids are a top-n, not a window."""
    chosen = df.select(E).distinct().orderBy(E).limit(n)
    if require and chosen.count() < n:
        raise ValueError(f"fewer than {n} events")
    return df.join(chosen, E, "left_semi")


def assign_events(entries: DataFrame) -> DataFrame:
    """One dataset per event; the later entry of an event wins.

    ``entries`` has event_id, dataset, entry, file and ``ordinal`` (position over
    all lists).
    """
    last = F.max(F.struct("ordinal", "dataset", "entry", "file")).alias("last")
    return entries.groupBy(E).agg(last).select(E, "last.dataset", "last.entry", "last.file")


def overlapping_events(entries: DataFrame) -> DataFrame:
    """Events named by more than one split."""
    return (
        entries.groupBy(E)
        .agg(F.count_distinct("dataset").alias("n_datasets"))
        .where("n_datasets > 1")
    )


def split_events(
    events: DataFrame, fractions: dict[str, float] | None = None, counts: dict[str, int] | None = None, seed: int = 42
) -> DataFrame:
    """Exact-size random split of the distinct events: (event_id, dataset).

    Events are ordered by a seeded draw that any engine can repeat. Sizes are ``int(n * fraction)`` or the
    given counts; the last dataset takes the rest when its size is ``None``.
    """
    ids = events.select(E).distinct()
    n = ids.count()
    sizes = counts if counts is not None else {k: None if f is None else int(n * f) for k, f in fractions.items()}
    # Cut points by rank: the range of the draws is cut into buckets so no task sorts all events.
    bucketed = ids.withColumn("_h", draw(E, seed=seed)).withColumn("_bucket", F.shiftright("_h", DRAW_BITS - 10))
    totals = bucketed.groupBy("_bucket").count()
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy("_h", E)
    ranked = bucketed.withColumn("_place", F.row_number().over(inside)).join(offsets, "_bucket")
    rank = F.col("_offset") + F.col("_place")
    label = F.lit(None).cast("string")
    upper = 0
    bounds = []
    for name, size in sizes.items():
        upper = n if size is None else upper + size
        bounds.append((name, upper))
    for name, bound in reversed(bounds):
        label = F.when(rank <= bound, F.lit(name)).otherwise(label)
    return ranked.select(E, label.alias("dataset")).where("dataset is not null")
