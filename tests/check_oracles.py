"""Runs registered queries beside their oracle SQL and reports differences.

    python tests/check_oracles.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tidemark.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, connection, sf_dir: str, name: str) -> tuple[str, int, float, float]:
    start = time.time()
    frame = entry.queries()[name](spark, sf_dir)
    found = frame.collect()
    spark_seconds = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(found), spark_seconds, 0.0
    start = time.time()
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    wanted = result.fetchall()
    sql_seconds = time.time() - start
    if sorted(columns) != sorted(frame.columns):
        return f"COLUMNS {sorted(frame.columns)} != {sorted(columns)}", len(found), spark_seconds, sql_seconds
    left, right = rows_of(frame.columns, found), rows_of(columns, wanted)
    if left != right:
        extra = sorted(set(left) - set(right))[:3]
        lacking = sorted(set(right) - set(left))[:3]
        return (
            f"DIFFERENT {len(left)} vs {len(right)} rows\n  {sorted(columns)}\n  only spark {extra}\n  only sql   {lacking}",
            len(found), spark_seconds, sql_seconds,
        )
    return "ok", len(found), spark_seconds, sql_seconds


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    arguments = parser.parse_args()
    sf_dir = f"/root/testdata/sf{arguments.sf}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failures = 0
    for name in arguments.names or list(entry.queries()):
        try:
            verdict, rows, spark_seconds, sql_seconds = compare(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - a failing query must not hide the others
            verdict, rows, spark_seconds, sql_seconds = f"ERROR {type(error).__name__} {str(error)[:1500]}", 0, 0.0, 0.0
        failures += verdict not in ("ok", "rows-only")
        print(f"{name:28s} {rows:8d} rows  spark {spark_seconds:6.2f}s  sql {sql_seconds:6.2f}s  {verdict}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main())
