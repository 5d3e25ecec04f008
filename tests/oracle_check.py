"""Run the registered queries beside their oracle SQL and compare the results.

usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, int) and not isinstance(v, bool):
        return str(v)
    return None if v is None else str(v)


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple("" if x is None else x for x in t))


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return True, f"rows-only {len(rows)} rows, {took:.1f}s"
    t1 = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    oracle = time.time() - t1
    kinds = {n: t for n, t in zip(columns, [str(d[1]) for d in cursor.description])}
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    got, want = canonical(df.columns, rows), canonical(columns, expected)
    note = f"{len(rows)} rows, spark {took:.1f}s, oracle {oracle:.1f}s"
    if got != want:
        gs, ws = set(got), set(want)
        only_got, only_want = sorted(gs - ws, key=str)[:3], sorted(ws - gs, key=str)[:3]
        return False, f"{note}; want {len(want)} rows; spark-only {only_got}; oracle-only {only_want}"
    types = []
    for field in df.schema.fields:
        spark_kind, duck_kind = field.dataType.simpleString(), kinds[field.name].upper()
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        if same.get(spark_kind) != duck_kind:
            types.append(f"{field.name}: {spark_kind}/{duck_kind}")
    if not rows:
        note += "; EMPTY"
    return True, note + (f"; types differ: {', '.join(types)}" if types else "")


def main() -> int:
    from hitweave.catalog import ORACLES, QUERIES
    from hitweave.session import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = get_session(
        "oracle-check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, "-", note, flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
