"""Every registered query equals its SQL on the small tables."""

import math

import duckdb
import pytest

from tracewell.jobs.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.01"


def norm(x):
    return ("nan" if math.isnan(x) else float(f"{x:.9g}")) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    rows = sorted((tuple(norm(x) for _, x in sorted(zip(names, r, strict=True))) for r in want.fetchall()), key=repr)
    df = QUERIES[name](spark, DIR)
    got = sorted((tuple(norm(x) for _, x in sorted(zip(df.columns, r, strict=True))) for r in df.collect()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(rows), (len(got), len(rows), got[:2], rows[:2])
    assert got == rows, [(a, b) for a, b in zip(got, rows, strict=True) if a != b][:3]
    assert rows


def test_each_query_without_sql_runs(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
