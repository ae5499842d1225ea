import hashlib
import json

from pyspark.sql import functions as F

from tracewell.operators import records

HEAD = ["| " + " | ".join(records.MATRIX) + " |", "|--|"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_cut_once(spark):
    df = spark.createDataFrame([("a", [*HEAD, "　| q\xa0|\x85LOST | `f` | |\x1fn\t|"])], "packet_id string, lines array<string>")
    rows = records.matrix_rows(df, F.col("lines"))
    assert _plan(rows).count("split(") == 1 and "regexp_replace" not in _plan(rows)
    assert [tuple(r) for r in rows.collect()] == [("a", None, 0, "q", "LOST", "`f`", "", "\x1fn")]


def test_rows_are_not_made_for_each_check(spark):
    df = spark.createDataFrame([("a", [*HEAD, "| q | EVIDENCED | f and g | s | n |", "| r | LOST | | | |"])], "packet_id string, lines array<string>")
    scope = spark.createDataFrame([("a", "z", False)], "packet_id string, question string, out boolean")
    files = spark.createDataFrame([("a", "f")], "packet_id string, path string")
    found = records.coverage_rows_check(records.matrix_rows(df, F.col("lines")), scope, files)
    assert "posexplode" not in _plan(found)
    assert {tuple(r)[1:] for r in found.collect()} == {(0, "in-scope row not declared", "q"), (0, "evidence missing", "g"), (1, "unknown status", "LOST")}


def test_plain_results_are_canonical_without_python(spark, monkeypatch):
    rows = [("p", "b", True, "x/", "1", None), ("p", "a", False, "y", None, "s"), ("q", "a", True, "é", "\\", None)]
    df = spark.createDataFrame(rows, "pack string, claim_id string, passed boolean, expected string, actual string, severity string")
    names = ["claim_id", "passed", "expected", "actual", "severity"]
    of = lambda pack: {"policy_hash": "", "results": [dict(zip(names, r[1:])) for r in sorted(rows, key=lambda r: r[1]) if r[0] == pack], "suite_hash": ""}
    want = {p: hashlib.sha256(json.dumps(of(p), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for p in "pq"}
    assert {r.pack: r.fingerprint for r in records.result_fingerprints(df, "pack").collect()} == want
    monkeypatch.setattr(records, "canonical_json", lambda raw: F.when(raw == "", raw))
    assert {r.pack: r.fingerprint for r in records.result_fingerprints(df, "pack").collect()} == {"p": want["p"], "q": None}
