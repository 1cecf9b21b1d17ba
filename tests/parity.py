"""Compare a query with its SQL on the driver tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 6)
    return value


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What sets the two results apart, or None."""
    cursor = connection.execute(sql)
    wanted_columns = [d[0] for d in cursor.description]
    wanted = rows_of(wanted_columns, cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(wanted_columns):
        return f"columns {sorted(df.columns)} != {sorted(wanted_columns)}"
    if got != wanted:
        extra, missing = list((got - wanted).items())[:3], list((wanted - got).items())[:3]
        return f"{sum(got.values())} rows vs {sum(wanted.values())}; extra {extra}; missing {missing}"
    return None
