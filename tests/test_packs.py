"""Packs: a pack written, hashed and signed by a plain loop is spoilt file by file; the writer beside a sort."""

import base64
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import packs
from tracewell.operators.integrity import canonical

SHA = lambda b: hashlib.sha256(b).hexdigest()


def build(receipts, **over):
    lines = [canonical({k: v for k, v in r.items() if k not in packs.PROJECTIONS["v0"]}) for r in receipts]
    body = "".join(x + "\n" for x in lines).encode()
    files = {"receipt_pack.jsonl": body, "verify_report.json": b"{}", "verify_transcript.md": b"# ok\n"}
    att = {"pack_id": "p", "receipt_integrity": "PASS", "head_hash": SHA(lines[-1].encode() if lines else b"empty"), "n_receipts": len(lines), "timestamp_start": "2024-01-01T00:00:00Z", "timestamp_end": "2024-01-02T00:00:00Z", "ci_binding": {"commit_sha": "abc"}}
    att |= over.pop("attestation", {})
    sig, key = b"\x01\x02sig", b"key"
    m = dict.fromkeys(packs.MANIFEST_FIELDS, "x") | {
        "attestation": att, "attestation_sha256": SHA(canonical(att).encode()), "receipt_count_expected": len(lines), "expected_files": [*files], "files": [{"path": p, "sha256": SHA(b), "bytes": len(b)} for p, b in files.items()],
        "signature": base64.b64encode(sig).decode(), "signer_pubkey": base64.b64encode(key).decode(), "signer_pubkey_sha256": SHA(key), "pack_root_sha256": SHA(canonical(att).encode()),
    }
    m |= over
    return files | {"pack_signature.sig": sig, "pack_manifest.json": json.dumps(m).encode()}


R = [{"receipt_id": f"r{i}", "type": "model_call", "timestamp": "2024-01-01T00:00:00Z", "x": [1.5, {"y": None}], "signature": "s"} for i in range(3)]
OK = build(R)


def flip(name, at=-1):
    data = bytearray(OK[name])
    data[at] = (data[at] + 1) % 256
    return OK | {name: bytes(data)}


def without(name):
    return {k: v for k, v in OK.items() if k != name}


T, G, O = "E_MANIFEST_TAMPER", "E_PACK_SIG_INVALID", "E_PACK_OMISSION_DETECTED"
CASES = {
    "fine": (OK, set()),
    "empty": (build([]), set()),
    "flip_report": (flip("verify_report.json"), {(T, "verify_report.json")}),
    "flip_transcript": (flip("verify_transcript.md", 0), {(T, "verify_transcript.md")}),
    "flip_receipts": (flip("receipt_pack.jsonl", 2), {(T, "receipt_pack.jsonl"), (T, "receipt_integrity"), ("W_RECEIPTS", "receipt_pack.jsonl")}),
    "flip_signature": (flip("pack_signature.sig"), {(G, "pack_signature.sig")}),
    "cut_receipts": (OK | {"receipt_pack.jsonl": OK["receipt_pack.jsonl"][: OK["receipt_pack.jsonl"].index(b"\n") + 1]}, {(T, "receipt_pack.jsonl"), ("W_SIZE", "receipt_pack.jsonl"), (O, "receipt_count_expected"), (T, "head_hash")}),
    "cut_line": (OK | {"receipt_pack.jsonl": OK["receipt_pack.jsonl"][:-9]}, {(T, "receipt_pack.jsonl"), ("W_SIZE", "receipt_pack.jsonl"), (T, "receipt_pack.jsonl:3"), (T, "receipt_integrity"), (T, "head_hash")}),
    "no_receipts": (without("receipt_pack.jsonl"), {(T, "receipt_pack.jsonl"), (O, "receipt_count_expected"), (T, "head_hash")}),
    "no_report": (without("verify_report.json"), {(T, "verify_report.json")}),
    "no_signature_file": (without("pack_signature.sig"), {(G, "pack_signature.sig")}),
    "unsigned": (build(R, signature=""), {(G, "signature")}),
    "not_base64": (build(R, signature="***"), {(G, "signature")}),
    "other_key": (build(R, signer_pubkey_sha256="0" * 64), {(G, "signer_pubkey_sha256")}),
    "no_key": (build(R, signer_pubkey=""), {(G, "signer_pubkey")}),
    "edited": (build(R, attestation_sha256="1" * 64), {(T, "attestation_sha256"), (T, "pack_root_sha256")}),
    "escape": (build(R, expected_files=["../../etc/passwd", "/etc/passwd", "b/../verify_report.json"]), {("E_PATH_ESCAPE", "../../etc/passwd"), ("E_PATH_ESCAPE", "/etc/passwd")}),
    "twice": (build([R[0], R[0]]), {(T, "receipt_integrity"), ("W_RECEIPTS", "receipt_pack.jsonl")}),
    "claims_fail": (build([R[0] | {"type": ""}], attestation={"receipt_integrity": "FAIL"}), {("W_RECEIPTS", "receipt_pack.jsonl")}),
    "future": (build(R, attestation={"timestamp_end": "2024-03-01T00:00:00Z"}), {("E_TIMESTAMP_INVALID", "timestamp_end")}),
    "stale": (build(R, attestation={"timestamp_end": "2023-12-01T00:00:00Z"}), {("E_PACK_STALE", "timestamp_end")}),
    "no_time": (build(R, attestation={"timestamp_end": None, "timestamp_start": None}), {("E_TIMESTAMP_INVALID", "timestamp_end")}),
    "no_binding": (build(R, attestation={"ci_binding": None}), {("E_CI_BINDING_MISSING", "ci_binding")}),
    "other_commit": (build(R, attestation={"ci_binding": {"commit_sha": "def"}}), {("E_CI_BINDING_MISMATCH", "ci_binding.commit_sha")}),
    "not_json": (OK | {"pack_manifest.json": b"{"}, {(T, "pack_manifest.json")}),
    "extra_field": (build(R, extra=1), {(T, "extra")}),
}


@pytest.fixture(scope="module")
def verified(spark):
    rows = [(p, name, bytearray(data)) for p, (files, _) in CASES.items() for name, data in files.items()]
    files = spark.createDataFrame(rows, "pack_id string, path string, content binary")
    found = packs.verify(files, "2024-01-05 00:00:00", max_age_hours=24 * 7, require_ci=True, commit="abc", signatures=spark.createDataFrame([("no_report", False)], "pack_id string, signature_ok boolean"))
    return found.collect(), packs.stage_results(files, found).collect()


def test_every_tampering_is_found(verified):
    got = {p: set() for p in CASES}
    for r in verified[0]:
        got[r["pack_id"]].add((r["code"], r["field"]))
    want = {p: codes for p, (_, codes) in CASES.items()}
    want["no_report"] = want["no_report"] | {(G, "signer_pubkey")}
    assert got == want


def test_stages(verified):
    got = {(r["pack_id"], r["stage"]): r["passed"] for r in verified[1]}
    assert all(got["fine", s] and got["empty", s] for s in packs.STAGES)
    assert {s for (p, s) in got if p == "not_json"} == {"validate_schema"} and not got["not_json", "validate_schema"]
    assert not got["escape", "validate_paths"] and got["escape", "validate_file_hashes"]
    assert not got["claims_fail", "validate_receipts"]


def test_paths(spark):
    cases = {"a/b": "a/b", "./a//b": "a/b", "a/../b": "b", "a/../../b": None, "..": None, "/a": None, "a/../../c/../d": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", packs.normal_path(F.col("p"))).collect()} == cases


def test_writer_is_ordered_and_repeatable(spark, tmp_path):
    draw = random.Random(2)
    made = [(f"p{draw.randint(0, 2)}", json.dumps({"seq": draw.choice([None, 1, 2, 3]), "receipt_id": f"r{i}", "run_id": draw.choice("ab"), "anchor": "z", "n": {"b": 1, "a": "é"}} | ({"_trace_id": "t"} if i % 3 else {}))) for i in range(400)]
    out = str(tmp_path / "packs")

    def read():
        found = {}
        for folder in sorted(os.listdir(out)):
            if folder.startswith("pack_id="):
                names = sorted(n for n in os.listdir(f"{out}/{folder}") if n.endswith(".txt"))
                found[folder[8:]] = b"".join(open(f"{out}/{folder}/{n}", "rb").read() for n in names)
        return found

    packs.write_packs(spark.createDataFrame(made, "pack_id string, raw string").repartition(7), out)
    first = read()
    packs.write_packs(spark.createDataFrame(made[::-1], "pack_id string, raw string").repartition(3), out)
    assert read() == first
    packs.write_packs(spark.createDataFrame([m for m in made if m[0] == "p1"], "pack_id string, raw string"), out)
    assert read() == first
    for p, body in first.items():
        mine = [json.loads(raw) for q, raw in made if q == p]
        mine.sort(key=lambda r: (r.get("_trace_id", r["run_id"]), r["seq"] or 0, r["receipt_id"]))
        assert body == "".join(canonical({k: v for k, v in r.items() if k != "anchor"}) + "\n" for r in mine).encode()


def test_files_are_read_by_pack(spark, tmp_path):
    for p in ("one", "two"):
        os.makedirs(tmp_path / "all" / p)
        for name, data in OK.items():
            (tmp_path / "all" / p / name).write_bytes(data)
    files = packs.read_files(spark, str(tmp_path / "all"))
    assert files.count() == 2 * len(OK)
    assert packs.verify(files, "2024-01-05 00:00:00").count() == 0
