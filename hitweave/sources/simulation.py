"""CSV files of a simulated event sample, one set of files an event, and the detector file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .files import read_event_csv

EVENT_IN_NAME = "event([0-9]+)-[^/]*$"

# Columns of the files by their stems.
HITS = "particle_id bigint, geometry_id bigint, tx double, ty double, tz double, tt double, index int"
MEASUREMENTS = "measurement_id bigint, geometry_id bigint, local0 double, local1 double"
HIT_MAP = "measurement_id bigint, hit_id bigint"
PARTICLES = "particle_id bigint, vx double, vy double, vz double, px double, py double, pz double"
CELLS = "hit_id bigint, channel0 int, channel1 int, value double"
DETECTOR = (
    "geometry_id bigint, volume_id int, layer_id int, module_id int, cx double, cy double, cz double, "
    "rot_xu double, rot_xv double, rot_xw double, rot_yu double, rot_yv double, rot_yw double, "
    "rot_zu double, rot_zv double, rot_zw double, pitch_u double, pitch_v double, module_t double"
)


@dataclass(frozen=True)
class SimulationTables:
    """All events of a sample; ``cells`` only where cell features are asked for."""

    hits: DataFrame
    measurements: DataFrame
    hit_map: DataFrame
    particles: DataFrame
    cells: DataFrame | None = None


def _read(spark: SparkSession, folder: str, stem: str, columns: str) -> DataFrame:
    """The named columns of all events' files, which may hold others in any order."""
    path = f"{folder}/event*-{stem}.csv"
    whole = spark.read.option("header", "true").csv(path)
    text = ", ".join(f"`{c}` string" for c in whole.columns)
    wanted = [c.split() for c in columns.split(", ")]
    read = read_event_csv(spark, path, text, EVENT_IN_NAME)
    return read.select("event_id", *[read[name].cast(kind).alias(name) for name, kind in wanted])


def read_simulation(spark: SparkSession, folder: str, hit_stem: str = "truth", with_cells: bool = False) -> SimulationTables:
    cells = None
    if with_cells:
        cells = _read(spark, folder, "cells", CELLS).withColumnsRenamed({"channel0": "ch0", "channel1": "ch1"})
    return SimulationTables(
        _read(spark, folder, hit_stem, HITS),
        _read(spark, folder, "measurements", MEASUREMENTS),
        _read(spark, folder, "measurement-simhit-map", HIT_MAP),
        _read(spark, folder, "particles_initial", PARTICLES),
        cells,
    )


def read_detector(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.option("header", "true").csv(path)
    return whole.select(*[whole[name].cast(kind).alias(name) for name, kind in (c.split() for c in DETECTOR.split(", "))])
