"""Runs a query beside its SQL in DuckDB."""

import math

import duckdb

from tracewell.llm.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def same(spark, name, sf_dir="/root/testdata/sf0.01", queries=QUERIES, oracles=ORACLES):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(oracles[name])
    names = [c[0] for c in want.description]
    rows = sorted((tuple(norm(x) for _, x in sorted(zip(names, r, strict=True))) for r in want.fetchall()), key=repr)
    df = queries[name](spark, sf_dir)
    got = sorted((tuple(norm(x) for _, x in sorted(zip(df.columns, r, strict=True))) for r in df.collect()), key=repr)
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    assert got == rows, [(a, b) for a, b in zip(got, rows, strict=False) if a != b][:3]
    return len(got)
