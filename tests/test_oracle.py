"""Every registered query against its oracle SQL on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from hitweave.catalog import ORACLES, QUERIES
from oracle_check import compare, connect

SF_DIR = os.environ.get("HITWEAVE_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def outcomes(spark):
    """All comparisons, several at a time: most of a small query is waiting for small jobs."""
    duck = connect(SF_DIR)

    def outcome(name):
        try:
            return compare(spark, duck.cursor(), name, QUERIES[name], ORACLES.get(name), SF_DIR)
        except Exception as error:  # noqa: BLE001
            return False, f"{type(error).__name__}: {str(error)[:900]}"

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(NAMES, pool.map(outcome, NAMES)))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query(outcomes, name):
    ok, note = outcomes[name]
    assert ok, note


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
