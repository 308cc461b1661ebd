"""Runs a query in Spark and its oracle in DuckDB and compares rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def same(spark, name, queries, oracles, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    df = queries[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = con.sql(oracles[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    want = sorted((tuple(norm(r[i]) for i in at) for r in out.fetchall()), key=repr)
    assert got == want
