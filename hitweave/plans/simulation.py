"""Simulated samples: from the event files' tables to hits with truth, and particles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detector as D
from ..operators.joins import E
from ..operators.ranking import dense_index
from ..operators.truth import region_label
from ..session import cut_lineage
from ..sources.simulation import SimulationTables


def build_simulation(
    tables: SimulationTables, detector: DataFrame, regions: dict[int, dict], use_true_hits: bool
) -> tuple[DataFrame, DataFrame]:
    """(hits, particles) of all events.

    Hits are the simulated ones, or the measurements placed in space with the hit and
    particle that the map gives them. With cells, only measurements that have some stay, all
    cells must be of a measurement in the event, and counts and directions are added.
    Particles get radius, pt, eta and their number of hits.
    """
    detector = detector.dropDuplicates(["geometry_id"])
    if use_true_hits:
        hits = D.true_hits(tables.hits, detector)
    else:
        # The map names a hit by its place in the event's file.
        numbered = dense_index(tables.hits.select(E, "index", "particle_id"), [E], "index", "hit_id")
        hits = D.measurements_to_hits(tables.measurements, detector, tables.hit_map, numbered)
    if tables.cells is not None:
        hits = D.restrict_to_cells(cut_lineage(hits), tables.cells, strict=True)
        by_measurement = hits.withColumnRenamed("hit_id", "_hit").withColumnRenamed("measurement_id", "hit_id")
        hits = D.add_cell_directions(by_measurement, tables.cells, detector)
        hits = hits.withColumnRenamed("hit_id", "measurement_id").withColumnRenamed("_hit", "hit_id")
    hits = cut_lineage(hits.withColumn("region", region_label(regions)))
    return hits, D.particle_kinematics(tables.particles, hits)
