"""A query's rows against its SQL in DuckDB: names, counts and values, in no order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{folder}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 3) + 0.0
    return v


def compare(spark, query, sql: str, folder: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    found = connect(folder).execute(sql)
    order = [d[0] for d in found.description]
    if sorted(order) != names:
        return f"columns {names} and {sorted(order)}"
    at = [order.index(n) for n in names]
    want = sorted((tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in found.fetchall()), key=str)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    kinds = [next((type(r[i]).__name__ for r in rows if r[i] is not None), None) for rows in (got, want) for i in range(len(names))]
    if kinds[: len(names)] != kinds[len(names) :]:
        return f"types {dict(zip(names, zip(kinds[: len(names)], kinds[len(names) :], strict=True), strict=True))}"

    def same(a, b) -> bool:
        return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-3 + 1e-9 * abs(a)

    return next((f"{a} and {b}" for a, b in zip(got, want, strict=True) if not all(map(same, a, b))), "")
