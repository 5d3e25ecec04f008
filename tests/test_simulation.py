"""Simulated event files, read and joined, for both ways of placing hits."""

import csv
import math

import pytest

from hitweave.plans.simulation import build_simulation
from hitweave.sources import simulation as S

REGIONS = {1: {"volume_id": 16}, 2: {"volume_id": [23, 28]}}


def write(path, columns, rows):
    with open(path, "w", newline="") as out:
        csv.writer(out).writerows([columns.split(), *rows])


@pytest.fixture
def folder(tmp_path):
    names = [c.split()[0] for c in S.DETECTOR.split(", ")]
    half = math.sqrt(0.5)
    turned = [half, -half, 0, half, half, 0, 0, 0, 1]
    rows = [[7, 16, 2, 4, 1.0, 2.0, 3.0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0.05, 0.1, 0.15], [9, 28, 4, 1, -5.0, 0.0, 8.0, *turned, 0.1, 0.1, 0.2]]
    write(tmp_path / "detectors.csv", " ".join(names), [*rows, rows[0]])
    for event in (0, 1):
        stem = f"{tmp_path}/event{event:09d}"
        # local (1, 0) and (0, 2) on the first module, (1, 1) on the second
        write(f"{stem}-hits.csv", "index particle_id geometry_id tx ty tz tt extra",
              [[0, 4, 7, 2.0, 2.0, 3.0, 0.5, "a"], [1, 5, 9, -5.0, 2 * half, 8.0, 0.25, "b"], [2, 4, 7, 1.0, 4.0, 3.0, 0.75, "c"]])
        write(f"{stem}-measurements.csv", "measurement_id geometry_id local0 local1", [[0, 7, 1, 0], [1, 9, 1, 1], [2, 7, 0, 2]])
        write(f"{stem}-measurement-simhit-map.csv", "measurement_id hit_id", [[0, 0], [1, 1], [2, 2]])
        write(f"{stem}-particles_initial.csv", "particle_id vx vy vz px py pz", [[4, 3, 4, 0, 0, 2, 0], [5, 0, 0, 1, 3, 4, 0], [6, 0, 0, 0, 1, 0, 1]])
        write(f"{stem}-cells.csv", "hit_id channel0 channel1 value", [[0, 10, 3, 0.5], [0, 11, 3, 0.25], [1, 1, 1, 1.0], [2, 5, 5, 2.0]])
    return str(tmp_path)


@pytest.mark.parametrize("use_true_hits,tolerance", [(True, 1e-9), (False, 1e-3)])
@pytest.mark.parametrize("with_cells", [False, True])
def test_positions_and_counts(spark, folder, use_true_hits, tolerance, with_cells):
    tables = S.read_simulation(spark, folder, "hits", with_cells)
    hits, particles = build_simulation(tables, S.read_detector(spark, f"{folder}/detectors.csv"), REGIONS, use_true_hits)
    half = math.sqrt(0.5)
    want = {0: (2.0, 2.0, 3.0, 4, 1), 1: (-5.0, 2 * half, 8.0, 5, 2), 2: (1.0, 4.0, 3.0, 4, 1)}
    got = hits.collect()
    assert len(got) == 6
    for r in got:
        x, y, z, particle, region = want[r.hit_id]
        assert abs(r.x - x) < tolerance and abs(r.y - y) < tolerance and abs(r.z - z) < tolerance
        assert (r.particle_id, r.region) == (particle, region)
        if with_cells:
            assert r.cell_count == (2 if r.measurement_id == 0 else 1)
            assert r.lx == pytest.approx(0.1 if r.measurement_id != 2 else 0.05)
    rows = {(r.event_id, r.particle_id): r for r in particles.collect()}
    assert len(rows) == 6
    assert [rows[0, p].nhits for p in (4, 5, 6)] == [2, 1, 0]
    assert rows[1, 4].radius == 5.0 and rows[1, 5].pt == 5.0


def test_cells_of_no_measurement_are_refused(spark, folder):
    write(f"{folder}/event000000001-cells.csv", "hit_id channel0 channel1 value", [[0, 1, 1, 1.0], [9, 1, 1, 1.0]])
    tables = S.read_simulation(spark, folder, "hits", True)
    with pytest.raises(ValueError, match="event 1"):
        build_simulation(tables, S.read_detector(spark, f"{folder}/detectors.csv"), REGIONS, False)
