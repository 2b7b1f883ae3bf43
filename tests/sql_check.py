"""Comparing a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def differences(df, con, sql):
    """The first rows in one result and not in the other; empty if they agree, repeated rows included."""
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    expected = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in result.fetchall())
    return [] if got == expected else [x for x in got if x not in expected][:3] + [x for x in expected if x not in got][:3] or ["other multiplicities"]
