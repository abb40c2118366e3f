"""Run registered queries and their oracle texts side by side.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


def _canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(spark_rows: tuple[list[str], list[tuple]],
            oracle_rows: tuple[list[str], list[tuple]]) -> str | None:
    """None if equal, else the first difference in words."""
    (left_names, left), (right_names, right) = _canonical(*spark_rows), _canonical(*oracle_rows)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"row {a} != {b}"
    return None


def run_oracle(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def type_mismatch(df, connection, sql: str) -> list[str]:
    """Columns whose Spark type and DuckDB type differ in kind."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
             "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    described = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{name}: {kind} / {described.get(name)}" for name, kind in df.dtypes
            if kinds.get(kind, kind) != described.get(name)]


def main() -> None:
    import __spark_entry__ as contract
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(folder)
    texts = contract.oracle_sql()
    bad = 0
    for name, query in contract.queries().items():
        if args and name not in args:
            continue
        started = time.time()
        try:
            df = query(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - started
            if name not in texts:
                print(f"{name:45s} {len(rows):7d} rows {took:6.2f}s  rows only")
                continue
            problem = compare((df.columns, rows), run_oracle(connection, texts[name]))
            kinds = type_mismatch(df, connection, texts[name])
        except Exception as error:  # report and go on with the next query
            problem, kinds, rows, took = f"{type(error).__name__}: {str(error)[:600]}", [], [], 0
        bad += problem is not None
        print(f"{name:45s} {len(rows):7d} rows {took:6.2f}s  {problem or 'ok'} {kinds or ''}",
              flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
