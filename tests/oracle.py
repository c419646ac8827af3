"""Compares queries with their SQL, names, types and values, as a driver would."""

import math
import os

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def database(sf):
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return db


def key(row):
    return tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


def difference(df, db, sql):
    """None, or what differs."""
    found = db.execute(sql)
    kinds = {x[0]: str(x[1]) for x in found.description}
    if sorted(kinds) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(kinds)}"
    wrong = {c: (k, kinds[c]) for c, k in df.dtypes if KINDS.get(k) != kinds[c]}
    if wrong:
        return f"types {wrong}"
    columns = list(kinds)
    want = sorted(map(tuple, found.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    same = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9)
    return next((f"{g} and {w}" for g, w in zip(got, want) if not all(map(same, g, w))), None)
