"""Run a registered query in Spark and its SQL twin in DuckDB and compare the row sets."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def close(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, int | float) and isinstance(b, int | float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def compare(df, con, sql):
    """(verdict, detail): 'exact', 'close', or 'diff'."""
    left = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return "diff", f"columns {sorted(df.columns)} vs {sorted(names)}"
    right = rows_of(names, cur.fetchall())
    if len(left) != len(right):
        only = [r for r in left if r not in set(right)][:1], [r for r in right if r not in set(left)][:1]
        return "diff", f"rows {len(left)} vs {len(right)}; e.g. {str(only)[:900]}"
    if left == right:
        return "exact", f"{len(left)} rows"
    for a, b in zip(left, right):
        if not close(a, b):
            n = sum(not close(x, y) for x, y in zip(left, right))
            return "diff", f"{n}/{len(left)} rows differ; cols {sorted(names)}\n  spark {str(a)[:700]}\n  duck  {str(b)[:700]}"
    first = next((a, b) for a, b in zip(left, right) if a != b)
    return "close", f"{len(left)} rows; e.g. {str(first)[:400]}"
