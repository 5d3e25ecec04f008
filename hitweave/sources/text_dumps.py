"""Text dumps: particles, spacepoints, clusters, module lookup and module map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import E
from ..operators.ranking import dense_index
from . import schemas as S

EVENT_NUMBER = "([0-9]+)[^0-9]*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the event number, the last number in the file path."""
    return spark.read.text(path).select(
        F.regexp_extract("_metadata.file_path", EVENT_NUMBER, 1).cast("bigint").alias(E), "value"
    )


def _fields(group, names: list[str]) -> list:
    parts = F.split(group, ",")
    return [F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)]


def parse_particles(lines: DataFrame) -> DataFrame:
    """19 typed columns from the part of each line before ``,#``."""
    head = F.get(F.split("value", ",?#"), F.lit(0))
    return S.coerce(lines.select(E, *_fields(head, list(S.PARTICLE_TYPES))), S.PARTICLE_TYPES)


def parse_spacepoints(lines: DataFrame) -> DataFrame:
    names = ["hit_id", "x", "y", "z", "cluster_index_1", "cluster_index_2"]
    parsed = lines.select(E, *_fields(F.col("value"), names)).select(
        E,
        F.col("hit_id").cast("bigint"),
        *[F.col(c).cast("double") for c in "xyz"],
        F.col("cluster_index_1").cast("bigint"),
        F.expr("cast(cast(nullif(cluster_index_2, '') as double) as bigint)").alias("cluster_index_2"),
    )
    return parsed.withColumn("cluster_index_2", F.coalesce("cluster_index_2", "cluster_index_1"))


def renumber_spacepoints(spacepoints: DataFrame) -> DataFrame:
    """Hit ids 0..n-1 in each event, in the order of the ids read."""
    numbered = dense_index(spacepoints, [E], "hit_id", "_dense")
    return numbered.withColumn("hit_id", F.col("_dense")).drop("_dense")


def parse_clusters(lines: DataFrame) -> DataFrame:
    """Seven groups per line, split into typed columns; links stay text.

    The shape group holds 2 or 14 fields; anything else fails the job.
    """
    groups = F.split("value", ",#,|#,|,#")
    raw = lines.select(
        E,
        *[
            F.get(groups, F.lit(i)).alias(name)
            for i, name in enumerate(["_coordinates", "_region", "links", "_cells", "_shape", "_norms", "_covariance"])
        ],
    )
    shape = F.split("_shape", ",")
    size = F.size(shape)

    def shape_field(name: str):
        long_at = S.SHAPE_LONG.index(name)
        short = F.get(shape, F.lit(S.SHAPE_SHORT.index(name))) if name in S.SHAPE_SHORT else F.lit(None).cast("string")
        return (
            F.when(size == len(S.SHAPE_LONG), F.get(shape, F.lit(long_at)))
            .when(size == len(S.SHAPE_SHORT), short)
            .otherwise(F.raise_error(F.lit("cluster shape group must have 2 or 14 fields")).cast("string"))
            .cast("double")
            .alias(name)
        )

    types = {"cluster_id": "bigint", "hardware": "string"}
    types |= {c: "double" for c in (*S.COORDINATE_COLUMNS[2:], *S.NORM_COLUMNS)}
    types |= {c: "bigint" for c in S.REGION_COLUMNS}
    columns = [
        E,
        *_fields(F.col("_coordinates"), S.COORDINATE_COLUMNS),
        *_fields(F.col("_region"), S.REGION_COLUMNS),
        *_fields(F.col("_norms"), S.NORM_COLUMNS),
        *[shape_field(n) for n in S.SHAPE_LONG],
        "links",
    ]
    return S.coerce(raw.select(*columns), types)


def read_module_lookup(spark: SparkSession, path: str) -> DataFrame:
    return clean_module_lookup(spark.read.csv(path, sep=" ", schema=S.MODULE_LOOKUP_SCHEMA))


def clean_module_lookup(lookup: DataFrame) -> DataFrame:
    """Side-0 rows, once each."""
    return lookup.where("side = 0").dropDuplicates()


def parse_module_map(lines: DataFrame) -> DataFrame:
    """24 whitespace-separated columns."""
    parts = F.split(F.trim("value"), "\\s+")
    return lines.select(
        *[
            F.get(parts, F.lit(i)).cast("bigint" if i < 4 else "double").alias(name)
            for i, name in enumerate(S.MODULE_MAP_COLUMNS)
        ]
    )


def module_map_parts(module_map: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First-pair, second-pair and triplet thresholds, each with the three module ids."""
    ids = ["mid_1", "mid_2", "mid_3"]

    def pick(names):
        return module_map.select(*ids, *names)

    pair = [f"{f}{side}" for f in S.MODULE_MAP_PAIR_FEATURES for side in ("max", "min")]
    return (
        pick([f"{p}_12" for p in pair]),
        pick([f"{p}_23" for p in pair]),
        pick([f"{f}_{side}" for f in S.MODULE_MAP_TRIPLET_FEATURES for side in ("max", "min")]),
    )


def parse_event_list(lines: DataFrame, dataset: str) -> DataFrame:
    """Lines ``run event entry file`` as an event assignment; ``ordinal`` keeps file order if present."""
    parts = F.split(F.trim("value"), "\\s+")
    keep = [c for c in lines.columns if c != "value"]
    return lines.select(
        *keep,
        F.lit(dataset).alias("dataset"),
        F.get(parts, F.lit(1)).cast("bigint").alias(E),
        F.get(parts, F.lit(2)).cast("bigint").alias("entry"),
        F.get(parts, F.lit(3)).alias("file"),
    )
