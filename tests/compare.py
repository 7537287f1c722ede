"""Side-by-side run of a registered query and its SQL twin."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def normal(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda row: tuple((v is None, type(v).__name__, v if v is not None else 0) for v in row))


def both_sides(spark, connection, query, sql: str, sf_dir: str):
    df = query(spark, sf_dir)
    spark_rows = normal(df.columns, [tuple(row) for row in df.collect()])
    relation = connection.sql(sql)
    duck_rows = normal(relation.columns, relation.fetchall())
    return sorted(df.columns), sorted(relation.columns), spark_rows, duck_rows
