"""Comparison of a query's rows with DuckDB's, regardless of order."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return float(f"{x:.10g}")
    return x


def check(spark, query, sql: str, sf_dir: str) -> None:
    frame = query(spark, sf_dir)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(sf_dir) / name}.parquet')")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    want = Counter(tuple(value(r[names.index(c)]) for c in order) for r in result.fetchall())
    got = Counter(tuple(value(r[c]) for c in order) for r in frame.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
