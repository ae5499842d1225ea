import hashlib
import json
import random

from pyspark.sql import functions as F

from tracewell.operators import integrity, lifecycle, records, textgate
from tracewell.streaming import streams

sha = lambda b: hashlib.sha256(b).digest()


def test_decision_shape(spark):
    names = [*records.REQUIRED, "confidence", "source_organ", "proof_tier", "dissent_severity"]
    good = dict.fromkeys(records.REQUIRED, "x") | {"receipt_type": "decision_v1", "receipt_version": "1", "verdict": "APPROVE", "authority_class": "BINDING", "disposition": "execute"}
    rows = [good | {"receipt_id": "a", "refs": [("receipt", "r", "supporting")]}, good | {"receipt_id": "b", "verdict": "MAYBE", "policy_id": None, "confidence": "", "source_organ": "y", "refs": [None, ("lie", None, "supporting"), ("", "r", "")]}, good | {"receipt_id": "c", "verdict": "", "refs": None}]
    ddl = ", ".join(f"{n} string" for n in names) + ", evidence_refs array<struct<ref_type: string, ref_id: string, ref_role: string>>"
    df = spark.createDataFrame([tuple(r.get(n) for n in names) + (r["refs"],) for r in rows], ddl)
    want = {("b", "policy_id", "missing"), ("b", "verdict", "unknown"), ("b", "confidence", "unknown"), ("b", "evidence_refs[0]", "no object"), ("b", "evidence_refs[1].ref_id", "missing"), ("b", "evidence_refs[1].ref_type", "unknown")}
    assert {tuple(r) for r in records.decision_shape(df, ["1"]).collect()} == want
    assert {tuple(r) for r in records.decision_shape(df, ["1"], ["x"]).collect()} == want | {("b", "source_organ", "unknown")}


def test_foreign_names(spark):
    rows = ['{"a": {"b": [1, {"é": 1}]}, "ü": 2}', '{"ü": {"é": 1}}', '{"a": "é"}', "[[{}, {\"x\": {\"ß\": null}}]]", "broken", None, "3", ""]
    got = [tuple(r[0] or (None, None)) for r in spark.createDataFrame([(r,) for r in rows], "raw string").coalesce(1).select(records.foreign_name("raw")).collect()]
    assert got == [("$.a.b[1]", "é"), ("$", "ü"), (None, None), ("$[0][1].x", "ß")] + [(None, None)] * 4


def test_fingerprints_are_of_canonical_json(spark):
    rows = [("p", "b", True, None, "1", "critical"), ("p", "a", False, "é\n", "2", None)]
    df = spark.createDataFrame(rows, "pack string, claim_id string, passed boolean, expected string, actual string, severity string")
    want = {"policy_hash": "x", "suite_hash": "", "results": [{"claim_id": c, "passed": p, "expected": e, "actual": a, "severity": s} for _, c, p, e, a, s in sorted(rows, key=lambda r: r[1])]}
    want = hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert records.result_fingerprints(df, "pack", "x").first().fingerprint == want
    assert df.limit(1).select(records.stable_id("n", F.struct(F.lit(1).alias("b"), F.lit("x").alias("a")))).first()[0] == "n_" + hashlib.sha256(b'{"a":"x","b":1}').hexdigest()[:24]


def test_matrix_problems_and_references(spark):
    head = ["# t", "| " + " | ".join(records.MATRIX) + " |", "|--|"]
    tables = {"ok": [*head, "  | a|EVIDENCED | `f#x`; g and h | | |", "text", "|| b | LOST | None | s | n ||"], "none": ["x"], "rows": head, "skip": head[:2], "cells": [*head, "| a | b |"], "row": [*head, "| a | b | c | d | e"], "above": ["| x", *head], "null": None}
    df = spark.createDataFrame(list(tables.items()), "packet_id string, lines array<string>")
    rows = records.matrix_rows(df, F.col("lines"))
    got = {}
    for r in rows.collect():
        got.setdefault(r.packet_id, []).append(r.problem or (r.row, r.question, r.status))
    assert sorted(got.pop("ok")) == [(0, "a", "EVIDENCED"), (1, "b", "LOST")]
    assert got == {"none": ["missing header"], "rows": ["no rows"], "skip": ["no rows"], "cells": ["wrong column count"], "row": ["invalid row"], "above": ["invalid row"], "null": ["missing header"]}
    cells = spark.createDataFrame([("`f#x`; g and h",), ("None",), (None,), (" ; `` ",)], "c string").coalesce(1)
    assert [r[0] for r in cells.select(records.evidence_refs(F.col("c"))).collect()] == [["f#x", "g", "h"], [], [], []]
    scope = spark.createDataFrame([("ok", "z", False)], "packet_id string, question string, out boolean")
    files = spark.createDataFrame([("ok", "f"), ("ok", "h")], "packet_id string, path string")
    found = {(r.row, r.error, r.what) for r in records.coverage_rows_check(rows, scope, files).collect()}
    assert found == {(0, "in-scope row not declared", "a"), (0, "evidence missing", "g"), (1, "unknown status", "LOST")}


def test_claim_policy(spark):
    found = spark.createDataFrame([("x", "one", "low"), ("y", "one", "low"), ("y", "two", "low"), ("z", "three", "low")], "id string, transition string, severity string")
    paths = spark.createDataFrame([("x", "t/a/b.py"), ("x", "r.md"), ("y", "t/a.py"), ("y", "xr.md"), ("y", None)], "id string, path string")
    evidence = textgate.claim_evidence_paths(paths, {"tests": ["t/*.py", "t/a*"], "review": ["r.md"], "none": []}, "id")
    assert {tuple(r) for r in evidence.collect()} == {("x", "tests", "t/a/b.py"), ("x", "review", "r.md"), ("y", "tests", "t/a.py")}
    judged = textgate.apply_policy(found, {"one": ("BLOCK", "high", ["tests", "review"]), "two": ("NEEDS_REVIEW", "", ["tests"])}, evidence, "id", "PASS")
    assert {(r.id, r.transition, r.severity, r.verdict, tuple(r.missing)) for r in judged.collect()} == {("x", "one", "high", "PASS", ()), ("y", "one", "high", "BLOCK", ("review",)), ("y", "two", "low", "PASS", ()), ("z", "three", "medium", "PASS", ())}
    assert {tuple(r) for r in textgate.overall_claims(judged, "id").collect()} == {("x", "PASS"), ("y", "BLOCK"), ("z", "PASS")}


def test_merkle_proofs(spark):
    sizes = (1, 2, 3, 5, 8, 13)
    rows = [(f"t{n}", i, sha(f"{n}-{i}".encode()).hex()) for n in sizes for i in range(n)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "t string, i int, h string")
    got = {(r.t, r.place): r.proof for r in integrity.merkle_proofs(df, "t", "i", "h").collect()}
    for n in sizes:
        level, want = [bytes.fromhex(h) for t, _, h in rows if t == f"t{n}"], [[] for _ in range(n)]
        at = list(range(n))
        while len(level) > 1:
            for k in range(n):
                other = at[k] ^ 1
                want[k].append(level[other if other < len(level) else at[k]].hex())
                at[k] //= 2
            level = [sha(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        assert [got[f"t{n}", k] for k in range(n)] == want, n
    checked = integrity.merkle_proofs(df, "t", "i", "h").join(integrity.merkle_roots(df, "t", "i", "h"), "t")
    test = lambda leaf: [r[0] for r in checked.select(integrity.merkle_included(leaf, F.col("proof"), F.col("root"), F.col("place"))).collect()]
    assert all(test(F.col("leaf"))) and not any(test(F.sha2("leaf", 256)))
    assert integrity.merkle_proofs(df.limit(0), "t", "i", "h").count() == 0


def test_timeline_without_registration(spark):
    ddl = "commitment_id string, seq int, type string, result_id string, terminal_reason string, idempotency_key string, due_at string, actor_id string, replacement_id string"
    rows = [("a", 1, lifecycle.REGISTERED, None, None, None, "", "me", None), ("a", 2, lifecycle.OBSERVED, "r", None, None, None, None, None), ("a", 3, lifecycle.FULFILLED[0], "r", None, None, None, None, None), ("a", 4, lifecycle.TERMINATED, None, "x", "k", None, None, "b"), ("b", 9, lifecycle.FULFILLED[1], "r", None, None, None, None, None), ("b", 9, lifecycle.TERMINATED, None, "y", "k", None, None, "c"), ("", 1, lifecycle.OBSERVED, "r", None, None, None, None, None)]
    got = [(r.commitment_id, r.line, r.summary, r.note) for r in lifecycle.commitment_timeline(spark.createDataFrame(rows, ddl)).orderBy("commitment_id", "line").collect()]
    assert got == [("a", 1, "registered by actor_id='me', due_at=perpetual", "ok"), ("a", 2, "observed result_id='r'", "anchor edge present"), ("a", 3, "fulfillment for result_id='r'", "closes commitment"), ("b", 1, "fulfillment for result_id='r'", "invalid anchor (no registration; no anchor)"), ("b", 2, "terminated (reason=y, replacement='c')", "terminates commitment")]


def test_grace_stream_keeps_state_between_batches(spark, tmp_path):
    flags = {1: "0111000101", 2: "11", 3: "1n1111"}
    for part in range(5):
        rows = [(k, i, None if f == "n" else f == "1") for k, s in flags.items() for i, f in list(enumerate(s))[part * 2 : part * 2 + 2]]
        spark.createDataFrame(rows[::-1], "user_id long, seq long, passes boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema("user_id long, seq long, passes boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p*"))
    streams.run_available(streams.grace(stream), str(tmp_path / "out"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect():
        got[r.user_id] = got.get(r.user_id, "") + "01"[r.in_grace]
    assert got == {1: "0001110000", 2: "00", 3: "000011"}
