"""Run a query in Spark and its SQL in DuckDB and compare the whole results."""

import glob
import math
import os

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def _sorted(rows):
    return sorted((tuple(_norm(v) for v in r) for r in rows), key=repr)


def check(df, con, sql):
    """None when equal, else a short description."""
    names = sorted(df.columns)
    got_types = {n: t for n, t in df.dtypes}
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} != {sorted(rel.columns)}"
    want_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    wrong = [(n, got_types[n], want_types[n]) for n in names if TYPES.get(got_types[n]) != want_types[n]]
    if wrong:
        return f"types {wrong}"
    table = df.select(*[f"`{n}`" for n in names]).toArrow()
    got = _sorted(zip(*[table.column(n).to_pylist() for n in names])) if names else []
    want = _sorted(rel.project(", ".join(f'"{n}"' for n in names)).fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return f"{len(diff)} of {len(got)} rows differ, e.g. {diff[:3]}"
    if not got:
        return "no rows"
    return None
