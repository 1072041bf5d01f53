"""Compare a Spark result with a DuckDB result as unordered tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("orders",)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, list):
        return tuple(_value(v) for v in value)
    return value


def table(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark_df, connection, sql: str) -> str:
    """Empty when both results have the same columns, kinds of value and rows."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    expected, actual = table(names, result.fetchall()), table(spark_df.columns, spark_df.collect())
    if expected == actual:
        kinds = [{type(v) for row in side for v in row} for side in (expected, actual)]
        return "" if kinds[0] == kinds[1] else f"value types {kinds}"
    return (
        f"{sum(actual.values())} rows, expected {sum(expected.values())}; columns {sorted(names)}; "
        f"only here {list((actual - expected))[:3]}; missing {list((expected - actual))[:3]}"
    )
