"""Side-by-side comparison of a catalogue query with its SQL, as a set of typed rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def compare(spark_rows, spark_cols, con, sql) -> str | None:
    """None when equal, otherwise what differs."""
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(spark_cols):
        return f"columns {sorted(spark_cols)} vs {sorted(cols)}"
    order = sorted(cols)
    a = sorted(tuple(_cell(row[c]) for c in order) for row in spark_rows)
    b = sorted(tuple(_cell(row[cols.index(c)]) for c in order) for row in want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if a == b:
        return None
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, {order}: {bad[0][0]} vs {bad[0][1]}"
