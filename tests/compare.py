"""Rows of a query and of its SQL, in a form that compares."""

from __future__ import annotations

import math
import os

import duckdb

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}" if value else "0"
    return str([plain(v) for v in value]) if isinstance(value, (list, tuple)) else str(value)


def connection(sf_dir: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(frame, sql: str, con: duckdb.DuckDBPyConnection) -> bool:
    columns = sorted(frame.columns)
    ours = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    return ours == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
