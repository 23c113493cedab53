"""Compares a Spark result with DuckDB's, as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)


def same(df, sql: str, sf_dir: str) -> int:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(v) for v in r) for r in cur.fetchall())
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
    return sum(got.values())
