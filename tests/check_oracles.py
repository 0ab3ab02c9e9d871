"""Compare registered queries with their SQL: `python tests/check_oracles.py [sf_dir] [name ...]`."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def sql_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(row[i] for i in order) for row in cursor.fetchall())
    return [names[i] for i in order], rows


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(row) for row in df.select(*names).collect())


def differences(actual: tuple[list[str], Counter], expected: tuple[list[str], Counter]) -> str:
    """Empty when the two results hold the same rows under the same names."""
    if actual[0] != expected[0]:
        return f"columns {actual[0]} instead of {expected[0]}"
    extra, missing = actual[1] - expected[1], expected[1] - actual[1]
    if not extra and not missing:
        return ""
    return f"{extra.total()} extra {list(extra)[:2]}, {missing.total()} missing {list(missing)[:2]}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as registered

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(registered.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            actual = spark_rows(registered.queries()[name](spark, sf_dir))
            middle = time.time()
            found = differences(actual, sql_rows(connection, registered.oracle_sql()[name]))
            note = f"{actual[1].total()} rows, spark {middle - start:.1f}s, sql {time.time() - middle:.1f}s"
        except Exception as error:
            found, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += bool(found)
        print("FAIL" if found else "ok  ", name, note, found, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
