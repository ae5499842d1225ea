"""Golden values, brute force and readers."""

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from tracewell.jobs.text_jobs import claim_transitions
from tracewell.operators import governance, incidents, integrity, policy, textgate
from tracewell.sources import receipts
from tracewell.streaming import streams

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_merkle_golden_values(spark):
    rows = [("two", 0, sha("a")), ("two", 1, sha("b")), ("three", 0, sha("a")), ("three", 1, sha("b")), ("three", 2, sha("c")), ("one", 0, sha("a"))]
    got = {r.t: (r.root, r.leaves) for r in integrity.merkle_roots(spark.createDataFrame(rows, "t string, i int, h string"), "t", "i", "h").collect()}
    assert got["two"][0] == "e5a01fee14e0ed5c48714f22180f25ad8365b53f9779f79dc4a3d7e93963f94a"
    assert got["three"] == ("d31a37ef6ac14a2db1470c4316beb5592e6afd4465022339adafda76a18ffabe", 3)
    assert got["one"] == (sha("a"), 1)


def test_merkle_brute_force(spark):
    rows = [(f"t{n}", i, sha(f"{n}-{i}")) for n in (1, 2, 5, 8, 17, 100) for i in range(n)]
    random.seed(1)
    got = {r.t: r.root for r in integrity.merkle_roots(spark.createDataFrame(random.sample(rows, len(rows)), "t string, i int, h string"), "t", "i", "h").collect()}
    for n in (1, 2, 5, 8, 17, 100):
        level = [bytes.fromhex(sha(f"{n}-{i}")) for i in range(n)]
        while len(level) > 1:
            level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
        assert got[f"t{n}"] == level[0].hex()


def test_canonical_json(spark):
    assert integrity.canonical({"b": 1, "a": 2}) == '{"a":2,"b":1}'
    assert sha('{"a":2,"b":1}') == "d3626ac30a87e6f7a6428233b3c68299976865fa5508e4267c5415c76af7a772"
    for value, text in ((1.0, "1"), (0.1, "0.1"), (-2.5, "-2.5"), (1e20, "100000000000000000000"), (100.0, "100"), (True, "true"), (None, "null"), ([1, "é\n"], '[1,"é\\n"]'), (0.0, "0"), (123.456, "123.456"), (0.00012, "0.00012")):
        assert integrity.canonical(value) == text
    rows = spark.createDataFrame([('{"b": 1, "a": {"z": [1.50], "y": "x"}}',), ("broken",), (None,)], "raw string")
    assert [r[0] for r in rows.select(integrity.canonical_json("raw")).collect()] == ['{"a":{"y":"x","z":[1.5]},"b":1}', None, None]


def test_lines_are_those_of_python(spark):
    texts = ["a\nb", "a\r\nb\n", "\n\na", "x y\u0085z\x0bq\x0cr\x1ds", "one", "a\n\n", "\r\r\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, ""), (98, None)], "doc_id long, text string")
    got = {}
    for r in textgate.line_chunks(docs, 2).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.start_line, r.end_line, r.text, r.sha256))
    for i, t in enumerate(texts):
        lines = t.splitlines()
        assert got[i] == [(k + 1, min(k + 2, len(lines)), "\n".join(lines[k : k + 2]), sha("\n".join(lines[k : k + 2]))) for k in range(0, len(lines), 2)], t
    assert 99 not in got and 98 not in got


def test_claim_transitions_golden_and_brute_force(spark):
    pairs = spark.createDataFrame([(1, "experimental prototype may help", "production-ready framework guarantees"), (2, "unsafe", "safe"), (3, "It MAY be  local_only", "all\n\nwill-ing, ALWAYS")], "id int, a string, b string")
    got = {(r.id, r.line, r.transition) for r in textgate.claim_transitions(pairs, "id", "a", "b").collect()}
    assert {(1, 1, "prototype_to_production"), (1, 1, "possible_to_guaranteed")} <= got and not any(i == 2 for i, _, _ in got)

    def holds(text, terms):
        t = " ".join(text.lower().replace("_", " ").split())
        return any(x in t if " " in x or "-" in x else re.search(rf"(?<![a-z0-9]){re.escape(x)}(?![a-z0-9])", t) for x in terms)

    for r in pairs.collect():
        want = {(r.id, n, name) for n, line in enumerate(r.b.splitlines(), 1) if line.strip() for name, before, after, _ in textgate.TRANSITIONS if holds(r.a, before) and holds(line, after)}
        assert {x for x in got if x[0] == r.id} == want
    assert claim_transitions(spark, "/root/testdata/sf0.001").count() > 0


def test_replay_against_a_loop(spark):
    random.seed(3)
    rows = [(f"p{random.randrange(4)}", i, "mcp_tool_call", random.choice(["read", "write", "exec", "list"]), random.choice(["ok", "denied", None])) for i in range(600)]
    rules = {"default": "deny", "allow": ["r*", "write", "exec"], "deny": ["ex?c"], "max_calls": {"read": 20, "write": 9}, "max_tool_calls": 25}
    got = {(r.pack_id, r.line_no): (r.candidate_verdict, r.candidate_reason, r.change) for r in policy.replay(spark.createDataFrame(rows, "pack_id string, line_no long, type string, tool_name string, outcome string"), rules).collect()}
    counts, total = {}, {}
    for pack, line, _, tool, outcome in rows:
        reason = None
        used, whole = counts.get((pack, tool), 0), total.get(pack, 0)
        if tool == "exec":
            reason = "deny_list"
        elif tool == "list":
            reason = "not_in_allow"
        elif used >= rules["max_calls"].get(tool, 10**9):
            reason = "tool_budget_exceeded"
        elif whole >= 25:
            reason = "session_budget_exceeded"
        else:
            counts[pack, tool], total[pack] = used + 1, whole + 1
        was = (outcome or "forwarded") == "denied"
        change = "newly_denied" if reason and not was else "newly_allowed" if not reason and was else None
        assert got[pack, line] == ("deny" if reason else "allow", reason, change)


def test_admissible(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    artifacts = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True), ("e", True), ("x", True), ("y", True)], "artifact_id string, active boolean")
    inputs = spark.createDataFrame([("b", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "x")], "artifact_id string, input_id string")
    got = {r.artifact_id: r.admissible for r in governance.admissible(artifacts, inputs).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False, "e": False, "x": False, "y": False}


def test_readers(spark, tmp_path):
    pack = tmp_path / "packs" / "p1"
    pack.mkdir(parents=True)
    (pack / "receipts.jsonl").write_text('{"receipt_id":"r1","type":"model_call","timestamp":"2024-01-01T00:00:00Z","model":"gpt-4"}\n\n{"receipt_id":"r2","receipt_type":"x","_stored_at":"junk"}\n')
    got = receipts.read_pack_receipts(spark, f"{tmp_path}/packs/*/*.jsonl").orderBy("line_no").collect()
    assert [(r.pack_id, r.line_no, r.receipt_id, r.type, r.model_id) for r in got] == [("p1", 0, "r1", "model_call", "gpt-4"), ("p1", 2, "r2", "x", "unknown")]
    assert got[0].ts is not None and got[1].ts is None and json.loads(got[0].raw)["model"] == "gpt-4"
    files = receipts.read_pack_files(spark, f"{tmp_path}/packs").collect()
    assert [(f.pack_id, f.path, f.sha256) for f in files] == [("p1", "receipts.jsonl", hashlib.sha256((pack / "receipts.jsonl").read_bytes()).hexdigest())]
    for day, line in (("2024-01-01", '{"receipt_id":"old","type":"t"}'), ("2024-01-05", '{"receipt_id":"new","type":"t"}\nnot json')):
        (tmp_path / "store" / day).mkdir(parents=True)
        (tmp_path / "store" / day / "trace_1.jsonl").write_text(line + "\n")
    good, bad = receipts.read_history(spark, f"{tmp_path}/store/*/*.jsonl", "2024-01-03")
    assert [r.receipt_id for r in good.collect()] == ["new"] and [r.raw for r in bad.collect()] == ["not json"]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.parquet(f"{tmp_path}/in/e")
    stream = receipts.from_events(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in/e"))
    out = streams.tool_budgets(stream, {"tool_1": 2})
    query = out.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    most = got.where("allowed and tool_name = 'tool_1'").groupBy("session").count().agg(F.max("count")).first()[0]
    assert most <= 2 and got.count() == receipts.from_events(events).where("type = 'mcp_tool_call'").count()
    (tmp_path / "lines").mkdir()
    spark.createDataFrame([('{"receipt_id":"r","type":"t"}', "2024-01-01"), ("bad", "2024-01-01")], "raw string, date string").write.parquet(f"{tmp_path}/lines/l")
    lines = spark.readStream.schema("raw string, date string").parquet(f"{tmp_path}/lines/l")
    streams.write_traces(lines, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/ck2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").first().receipt_id == "r" and spark.read.parquet(f"{tmp_path}/bad").first().raw == "bad"


def test_changed_spans_are_those_of_difflib(spark):
    import difflib

    from tracewell.operators import sessions

    rows = [(1, "a\nb\nc", "a\nx\nc\nd"), (2, "same", "same"), (3, None, "new"), (4, "", None), (5, "a\nb\nb\nc", "b\nc\nb")]
    got = {}
    for r in sessions.changed_spans(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b").collect():
        got.setdefault(r.id, []).append(tuple(r)[1:])
    for i, a, b in rows:
        want = [(x, y, z, w) for t, x, y, z, w in difflib.SequenceMatcher(a=(a or "").splitlines(), b=(b or "").splitlines(), autojunk=False).get_opcodes() if t != "equal"]
        assert got.get(i, []) == want


def test_chains_walk_to_the_root_and_end_in_loops(spark):
    parents = [("a", f"r{i}", f"r{i - 1}" if i else None) for i in range(14)] + [("b", "x", "y"), ("b", "y", "z"), ("b", "z", "y"), ("b", "lost", "none")]
    rows = spark.createDataFrame(parents, "pack_id string, receipt_id string, parent_receipt_id string")
    got = sorted((r.receipt_id, r.step, r.ancestor) for r in incidents.chains(rows, rows.where("receipt_id in ('r13', 'x', 'lost')")).collect())
    assert got == sorted([("r13", k, f"r{13 - k}") for k in range(14)] + [("x", 0, "x"), ("x", 1, "y"), ("x", 2, "z"), ("lost", 0, "lost")])
