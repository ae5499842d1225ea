"""Chains, rings and graphs beside plain walks; a chain of a thousand in few rounds."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import ancestry, decisions, governance, incidents


def walk(parent, start, depth=None):
    seen, out, at = {start}, [], parent.get(start)
    while at is not None and at not in seen and (depth is None or len(out) < depth):
        out.append(at)
        seen.add(at)
        at = parent.get(at)
    return out


@pytest.mark.parametrize("depth", [None, 3])
def test_ancestors_against_walks(spark, depth):
    draw = random.Random(4)
    parent = {i: draw.choice([None, draw.randrange(60), i - 1]) for i in range(60)}
    parent |= {100 + i: 100 + (i + 1) % 7 for i in range(7)} | {200: 200, 201: 200, 202: 201, 300: 103, 301: 300, 400: 999}
    parent = {k: v for k, v in parent.items() if v is not None}
    rows = spark.createDataFrame(list(parent.items()), "node long, parent long")
    starts = [*parent, 999, 5000]
    got = {(r["node"], r["step"], r["ancestor"]) for r in ancestry.ancestors(rows, spark.createDataFrame([(s,) for s in starts], "node long"), depth).collect()}
    assert got == {(s, i, a) for s in starts for i, a in enumerate(walk(parent, s, depth), 1)}


def test_a_chain_of_a_thousand(spark):
    rows = spark.range(1, 1000).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    got = ancestry.ancestors(rows, spark.createDataFrame([(999,)], "node long")).collect()
    assert sorted((r["step"], r["ancestor"]) for r in got) == [(i, 999 - i) for i in range(1, 1000)]


def plain_grounded(nodes, edges):
    done = set()
    while True:
        new = {n for n, ok in nodes.items() if ok and n not in done and all(o in done for m, o in edges if m == n)}
        if not new:
            return done
        done |= new


def test_grounded_against_loop(spark):
    draw = random.Random(8)
    for _ in range(3):
        nodes = {i: draw.random() < 0.95 for i in range(80)}
        edges = {(i, draw.randrange(max(1, i - 3), i + 1) if draw.random() < 0.05 else draw.randrange(i)) for i in range(1, 80) for _ in range(draw.choice([0, 1, 1, 2]))}
        got = {r[0] for r in ancestry.grounded(spark.createDataFrame(list(nodes.items()), "node long, open boolean"), spark.createDataFrame(list(edges), "node long, on long")).collect()}
        assert got == plain_grounded(nodes, edges)


def test_chains_of_seventy_and_more_are_no_cycle(spark):
    n = 150
    steps = spark.range(n).select(F.lit("e").alias("episode_id"), F.col("id").alias("step_id"), F.lit("EMIT_OUTPUT").alias("opcode"))
    depends = spark.range(1, n).select(F.lit("e").alias("episode_id"), F.col("id").alias("step_id"), (F.col("id") - 1).alias("on"))
    assert decisions.step_graphs(steps, depends).count() == 0
    ring = depends.union(spark.createDataFrame([("e", 0, 5)], "episode_id string, step_id long, on long"))
    assert [tuple(r) for r in decisions.step_graphs(steps, ring).collect()] == [("e", "cycle")]
    artifacts = spark.range(n).select(F.col("id").alias("artifact_id"), F.lit(True).alias("active"))
    inputs = spark.range(1, n).select(F.col("id").alias("artifact_id"), (F.col("id") - 1).alias("input_id"))
    assert governance.admissible(artifacts, inputs).where("admissible").count() == n
    closed = artifacts.withColumn("active", F.col("artifact_id") != 70)
    assert governance.admissible(closed, inputs).where("admissible").count() == 70
    lost = inputs.union(spark.createDataFrame([(3, 5000)], "artifact_id long, input_id long"))
    assert governance.admissible(artifacts, lost).where("admissible").count() == 3


def test_causal_chains_walk_to_the_root(spark):
    n = 200
    rows = spark.range(n).select(F.lit("p").alias("pack_id"), F.concat(F.lit("r"), "id").alias("receipt_id"), F.when(F.col("id") > 0, F.concat(F.lit("r"), F.col("id") - 1)).otherwise("lost").alias("parent_receipt_id"))
    starts = rows.where(f"receipt_id = 'r{n - 1}'").select("pack_id", "receipt_id")
    got = sorted((r["step"], r["ancestor"]) for r in incidents.chains(rows, starts).collect())
    assert got == [(i, f"r{n - 1 - i}") for i in range(n)]
    assert sorted(r["step"] for r in incidents.chains(rows, starts, depth=5).collect()) == list(range(6))


def test_reasons_of_decisions(spark):
    receipts = spark.createDataFrame(
        [("a", "b", "s", ["o1", "o9"]), ("b", "c", None, []), ("c", "gone", None, None), ("s", None, None, None), ("x", "y", "lost", None), ("y", "x", None, None), ("z", "z", "", None)],
        "receipt_id string, parent_receipt_id string, supersedes string, obligations_created array<string>",
    )
    owed = spark.createDataFrame([("o1", "a", None), ("o2", "k", "a"), ("o3", "b", None)], "obligation_id string, source_receipt_id string, superseded_receipt_id string")
    asked = spark.createDataFrame([("a",), ("x",), ("z",), ("nowhere",), (None,)], "receipt_id string")
    want = {
        None: {("a", "target", 0, "a", True), ("a", "supersedes", 1, "s", True), ("a", "obligation", 1, "o1", True), ("a", "obligation", 1, "o9", False), ("a", "obligation", 1, "o2", True), ("a", "parent", 1, "b", True), ("a", "parent", 2, "c", True), ("a", "parent", 3, "gone", False)}
        | {("x", "target", 0, "x", True), ("x", "supersedes", 1, "lost", False), ("x", "parent", 1, "y", True), ("x", "cycle", 2, "x", False), ("z", "target", 0, "z", True), ("z", "cycle", 1, "z", False), ("nowhere", "target", 0, "nowhere", False)}
    }
    want[1] = {r for r in want[None] if r[2] < 2}
    for depth, rows in want.items():
        assert {tuple(r) for r in ancestry.explain(receipts, owed, asked, depth).collect()} == rows
