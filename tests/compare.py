"""Run registered queries and compare them with their oracle SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, decimal.Decimal):
        return f"decimal:{value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def check(spark, connection, folder, name, function, sql):
    """Return (problem or None, rows, seconds)."""
    start = time.time()
    frame = function(spark, folder)
    got = [tuple(r) for r in frame.collect()]
    seconds = time.time() - start
    if sql is None:
        return None, len(got), seconds
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(columns)}", len(got), seconds
    left, right = rows_of(frame.columns, got), rows_of(columns, expected)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        return f"{len(left)} vs {len(right)} rows; spark {only_left} oracle {only_right}", len(got), seconds
    return None, len(got), seconds


def main() -> None:
    from quiltomics import registry
    from quiltomics.session import local_session

    folder = "/root/testdata/" + (sys.argv[1] if len(sys.argv) > 1 else "sf0.01")
    wanted = sys.argv[2:]
    registry.load()
    spark = local_session()
    connection = oracle_connection(folder)
    bad = 0
    for name, function in registry.QUERIES.items():
        if wanted and not any(name == w or function.__module__.endswith("." + w) for w in wanted):
            continue
        try:
            problem, rows, seconds = check(spark, connection, folder, name, function, registry.ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            problem, rows, seconds = f"{type(error).__name__}: {str(error)[:900]}", -1, 0.0
        mark = "ok  " if problem is None else "FAIL"
        if problem is None and rows == 0:
            mark = "EMPT"
        if problem is not None:
            bad += 1
        kind = "oracle" if name in registry.ORACLES else "rows"
        print(f"{mark} {name} [{kind}] rows={rows} {seconds:.2f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
