"""Run every registered query next to its SQL counterpart and compare all values.

    python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value: object) -> str:
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (float, Decimal)):
        return repr(float(value))
    return str(value)


def _table(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(_cell(row[i]) for i in order) for row in rows
    )


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between the two results, or None."""
    mine = _table(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = _table(columns, result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} and {len(theirs[1])} rows"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1], strict=True) if a != b]
    return f"{len(wrong)} rows, first {wrong[0]}" if wrong else None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as contract

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = contract.queries(), contract.oracle_sql()
    failed = 0
    for name in names or queries:
        started = time.time()
        try:
            found = difference(queries[name](spark, folder), con, sqls[name])
        except Exception as error:  # report and go on with the other queries
            found = f"{type(error).__name__}: {str(error)[:500]}"
        failed += found is not None
        print(f"{name:24s} {time.time() - started:6.2f}s {found or 'equal'}", flush=True)
    print(f"{failed} of {len(names or queries)} differ")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(1 if main(args[0], args[1:]) else 0)
