"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, normal(x)) for k, x in v.items()))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return str(v) if hasattr(v, "as_tuple") else v


def compare(spark, sf_dir: str, query, sql: str) -> tuple[int, list]:
    """Row count and up to five differing rows."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols, (sorted(names), cols)
    want = sorted((tuple(normal(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    bad = [("extra", x) for x in list(set(got) - set(want))[:5]] + [("missing", x) for x in list(set(want) - set(got))[:5]]
    if len(got) != len(want):
        bad.append(("rows", len(got), len(want)))
    return len(got), bad
