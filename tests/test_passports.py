"""Minted passports and scanned source files."""

import hashlib
import json

from tracewell.operators import passports
from tracewell.sources.files import scan_sources, snapshots


def test_mint(spark):
    good = json.dumps({"attestation": {"pack_id": "p", "receipt_integrity": "PASS", "claim_check": "PASS", "pack_root_sha256": "h"}})
    part = json.dumps({"attestation": {"receipt_integrity": "PASS", "claim_check": "N/A"}})
    rows = [("a", good, json.dumps({"attestation": {"pack_root_sha256": "h", "timestamp_start": "s", "timestamp_end": "e"}})), ("b", part, None), ("c", None, "{}"), ("d", "{", "["), ("e", "{}", "[]")]
    got = {r.pack_id: r for r in passports.mint(spark.createDataFrame(rows, "pack_id string, report string, manifest string"), "2026-01-31 10:00:00").collect()}
    a = got["a"]
    assert (a.issued_at, a.valid_until, a.window_start, a.window_end, a.pack_ref) == ("2026-01-31T10:00:00+00:00", "2026-03-02T10:00:00+00:00", "s", "e", "sha256:h")
    assert [(c.claim_id, c.result, c.evidence_ref) for c in a.claims] == [("C-001", "pass", "proof_pack/p/verify_report.json#integrity"), ("C-002", "pass", "proof_pack/p/verify_report.json#hash_chain"), ("C-003", "pass", "proof_pack/p/verify_report.json#claims")]
    assert a.evidence_summary.core_claims_passed == "3/3" and a.evidence_mix == "3 machine / 0 human" and a.reliance == "R0" and a.error is None
    assert len(got["b"].claims) == 2 and got["b"].pack_ref is None
    assert [(got[k].error, len(got[k].claims), got[k].pack_ref) for k in "cd"] == [("report_missing", 0, "sha256:"), ("report_missing", 0, None)]
    assert [c.result for c in got["e"].claims] == ["fail", "fail"] and got["e"].pack_ref is None


def test_reliance(spark):
    kind = "signed boolean, claims array<struct<result:string,claim_type:string>>"
    ok, bad, cover = ("pass", "integrity"), ("fail", "integrity"), ("pass", "coverage")
    rows = [(True, [ok, cover]), (True, [ok]), (True, [bad, cover]), (False, [ok]), (None, []), (True, []), (True, [(None, None)])]
    df = spark.createDataFrame(rows, kind)
    assert [r[0] for r in df.select(passports.reliance_class(df.claims, df.signed)).collect()] == ["R3", "R2", "R1", "R0", "R0", "R2", "R1"]


def test_scan_of_files(spark, tmp_path):
    files = {"a.py": b"x = 1\n", "b/c.md": "é".encode(), "b/d.txt": b"\xff\xfe", "b/e.bin": b"x", "dist/f.py": b"", "b/.py": b"x", "g h+%20i.txt": b"z", "empty.txt": b"", "b/build/x.md": b"1"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.relative_path: r for r in scan_sources(spark, f"file://{tmp_path}", "now").collect()}
    assert set(got) == {"a.py", "b/c.md", "g h+%20i.txt"}  # Spark reads no empty files
    for name, r in got.items():
        digest = hashlib.sha256(files[name]).hexdigest()
        source = "src_" + hashlib.sha256(json.dumps({"source_type": "local_file", "uri": f"file://{name}"}, separators=(",", ":")).encode()).hexdigest()[:24]
        snap = "snap_" + hashlib.sha256(json.dumps({"content_hash": digest, "source_id": source}, separators=(",", ":")).encode()).hexdigest()[:24]
        assert (r.content_hash, r.size_bytes, r.source_id, r.snapshot_id, r.content_text) == (digest, len(files[name]), source, snap, files[name].decode())
    again = spark.createDataFrame([("a.py", bytearray(b"x = 1\n")), ("n.py", None), ("empty.py", bytearray())], "relative_path string, content binary")
    rows = snapshots(again, "later").collect()
    assert [(r.relative_path, r.size_bytes) for r in rows] == [("a.py", 6), ("empty.py", 0)] and rows[0].snapshot_id == got["a.py"].snapshot_id
