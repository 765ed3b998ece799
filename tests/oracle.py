"""Side-by-side comparison of a registered query with its DuckDB SQL."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"]


def _cell(value):
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 9)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def compare(df, sf_dir: str, sql: str) -> tuple[str, int]:
    """``("ok", n)`` or the first difference, with the Spark row count."""
    names, expected = oracle_rows(sf_dir, sql)
    got_names = df.columns
    got = _rows(got_names, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(got_names):
        return f"columns {sorted(got_names)} != {sorted(names)}", sum(got.values())
    want = _rows(names, expected)
    if got != want:
        return f"extra {list((got - want).items())[:2]} missing {list((want - got).items())[:2]}", sum(got.values())
    return "ok", sum(got.values())
