"""Compare a query with its SQL text: rows, column names and values in any order."""

from __future__ import annotations

import math
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(made, key=repr)


def difference(df, connection, sql: str) -> str | None:
    """None when equal, else what differs first."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want_columns, want = rows_of(names, result.fetchall())
    got_columns, got = rows_of(df.columns, df.collect())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 5000 else []
        lost = [r for r in want if r not in set(got)][:2] if len(got) < 5000 else []
        return f"rows {len(got)} != {len(want)}; only here {extra}; only there {lost}"
    for a, b in zip(got, want):
        if a != b:
            return f"{dict(zip(got_columns, a))} != {dict(zip(got_columns, b))}"
    return None
