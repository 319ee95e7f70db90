"""Comparing a Spark result with the same result from DuckDB."""

import datetime
import decimal
import math
import os

import duckdb

DATA = os.environ.get("VIEWLENS_DATA", "/root/testdata/sf0.001")

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}


def duck(data=None):
    data = data or DATA
    con = duckdb.connect()
    for name in os.listdir(data):
        if name.endswith(".parquet"):
            path = os.path.join(data, name)
            glob = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{glob}')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _plain(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    return v


def compare(df, con, sql):
    """Differences between a DataFrame and a query, as a list of short texts."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return [f"columns {names} != {sorted(rel.columns)}"]
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    spark_types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    problems = [f"type of {n}: {spark_types[n]} != {duck_types[n]}" for n in names if spark_types[n] != duck_types[n]]
    order = [rel.columns.index(n) for n in names]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=_key)
    got = sorted((tuple(_plain(v) for v in r) for r in df.select(*names).collect()), key=_key)
    if len(want) != len(got):
        return problems + [f"rows {len(got)} != {len(want)}"]
    for g, w in zip(got, want):
        for n, a, b in zip(names, g, w):
            same = a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12))
            if not same:
                return problems + [f"{n}: {a!r} != {b!r} in {g} / {w}"]
    if not got:
        problems.append("no rows")
    return problems
