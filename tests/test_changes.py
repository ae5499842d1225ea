"""Renames beside the greedy walk over all pairs; lifecycles over several batches; a store that takes a plan twice."""

import difflib
import os
import random

from pyspark.sql import functions as F

from tracewell.operators import derived, renames
from tracewell.streaming import streams


def plain_pairs(changes):
    suffix = lambda p: os.path.splitext(os.path.basename(p))[1].lower()
    out = set()
    for s in {c[0] for c in changes}:
        gone = [(b, t or "") for c, b, a, t in changes if c == s and a is None and b is not None and suffix(b) in renames.TEXT_SUFFIXES]
        come = [(a, t or "") for c, b, a, t in changes if c == s and b is None and a is not None and suffix(a) in renames.TEXT_SUFFIXES]
        found = [(-difflib.SequenceMatcher(a=x, b=y, autojunk=False).ratio(), b, a) for b, x in gone for a, y in come if suffix(b) == suffix(a)]
        used = set()
        for sim, b, a in sorted(f for f in found if -f[0] >= renames.LEAST):
            if ("b", b) not in used and ("a", a) not in used:
                used |= {("b", b), ("a", a)}
                out.add((s, b, a, round(-sim, 9)))
    return out


def test_renames_against_greedy_walk(spark):
    draw = random.Random(6)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    text = lambda: " ".join(draw.choice(words) for _ in range(draw.choice([0, 3, 8, 30])))
    pool, changes = [text() for _ in range(12)], []
    for s in range(6):
        for i in range(draw.randint(2, 12)):
            changes.append((s, f"old/{i}{draw.choice(['.md', '.MD', '.py', '.bin', ''])}", None, draw.choice([None, text(), *pool])))
            changes.append((s, None, f"new/{i}{draw.choice(['.md', '.py', '.PY', '.bin'])}", draw.choice([None, text(), *pool])))
        changes.append((s, "both.md", "both.md", "x"))
    changes += [(9, f"c/{i}.md", None, "copy of one text") for i in range(30)] + [(9, None, f"d/{i}.md", "copy of one text") for i in range(20)] + [(9, ".md", None, "y"), (9, None, "x/.md", "y")]
    df = spark.createDataFrame(changes, "change_set long, before_path string, after_path string, text string").repartition(5)
    got = {(r[0], r[1], r[2], round(r[3], 9)) for r in renames.pair_renames(df).collect()}
    assert got == plain_pairs(changes)


def test_open_lifecycles_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = lambda rows: spark.createDataFrame(rows, "key string, type string, step string, at string").select("key", "type", "step", F.to_timestamp("at").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: streams.open_lifecycles(spark.readStream.schema("key string, type string, step string, ts timestamp").parquet(source), 3600.0, late="0 seconds")
    batch([("a", "opened", "open", "2024-01-01 00:00:00"), ("b", "opened", "open", "2024-01-01 00:10:00"), ("c", "closed", "close", "2024-01-01 00:00:00"), ("d", "note", None, "2024-01-01 00:00:00")])
    streams.run_available(stream(), out)
    assert spark.read.schema("key string").parquet(out).count() == 0
    batch([("a", "note", None, "2024-01-01 00:30:00"), ("b", "closed", "close", "2024-01-01 00:40:00"), ("c", "opened", "open", "2024-01-01 00:20:00"), ("e", "opened", "open", "2024-01-01 05:00:00")])
    streams.run_available(stream(), out)
    got = [(r["key"], r["receipts"], r["last_type"], str(r["opened_at"]), str(r["last_at"])) for r in spark.read.parquet(out).collect()]
    assert got == [("a", 2, "note", "2024-01-01 00:00:00", "2024-01-01 00:30:00")]
    batch([("z", "note", None, "2024-01-02 00:00:00")])
    streams.run_available(stream(), out)
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["a", "e"]


def test_sink_written_twice_holds_every_line_once(spark, tmp_path):
    lines = spark.createDataFrame([('{"receipt_id":"a"}', "2024-01-01"), ("{", "2024-01-01")], "raw string, date string")
    source = str(tmp_path / "lines")
    lines.write.parquet(source)
    for checkpoint in ("one", "two"):  # a lost checkpoint runs the same batch again
        stream = spark.readStream.schema("raw string, date string").parquet(source)
        streams.write_traces(stream, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/{checkpoint}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").count() == 1 and spark.read.parquet(f"{tmp_path}/bad").count() == 1


def test_a_plan_is_applied_once(spark, tmp_path):
    path = str(tmp_path / "store")
    schemas = {name: f"{key} string" for name, (key, _) in derived.STORE.items()} | {"sources": "source_id string, uri string, first_seen_at string, last_seen_at string", "artifacts": "artifact_id string, snapshot_id string, status string, receipt_id string, level string", "tombstones": "artifact_id string, reason string"}
    source = lambda *rows: spark.createDataFrame(rows, schemas["sources"] + ", n long")
    artifact = lambda *rows: spark.createDataFrame(rows, schemas["artifacts"] + ", n long")
    marks = lambda *rows: spark.createDataFrame(rows, "artifact_id string, status string, n long")
    apply = lambda name, plan, m: derived.apply_plan(spark, path, schemas, name, plan, m)
    first = {"sources": source(("s1", "u", "t1", "t1", 0), ("s1", "v", "t2", "t2", 1)), "artifacts": artifact(("a1", "x", "active", "r1", "DV2", 2), ("a2", "x", "active", "r2", "DV2", 3))}
    second = {"sources": source(("s1", "w", "t9", "t9", 0)), "artifacts": artifact(("a1", "y", "active", "r3", "DV1", 5)), "tombstones": spark.createDataFrame([("a2", "gone", 6), ("a2", "again", 7)], "artifact_id string, reason string, n long")}
    told = lambda name: sorted(map(tuple, derived.read_store(spark, path, schemas)[name].collect()))
    for _ in range(2):
        apply("p1", first, marks())
        assert told("sources") == [("s1", "u", "t1", "t2")]
    for again in range(2):
        assert apply("p2", second, marks(("a1", "stale", 4), ("a2", "stale", 5), ("a2", "tombstoned", 6), ("zz", "stale", 7))) == (again == 0)
        assert told("sources") == [("s1", "u", "t1", "t9")]
        assert told("artifacts") == [("a1", "x", "active", "r3", "DV1"), ("a2", "x", "tombstoned", "r2", "DV2")]
        assert told("tombstones") == [("a2", "again")]
