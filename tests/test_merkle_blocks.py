"""Proofs of trees over several blocks, with odd ends at any level, beside a loop; leaves are shuffled twice, proofs never."""

import hashlib

from pyspark.sql import functions as F

from tracewell.operators import integrity


def plain(leaves):
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        level += level[-1:] if len(level) % 2 else []
        for k, i in enumerate(at):
            proofs[k].append(level[i ^ 1])
            at[k] = i // 2
        level = [hashlib.sha256(bytes.fromhex(a + b)).hexdigest() for a, b in zip(level[::2], level[1::2], strict=True)]
    return proofs, level[0]


def test_proofs_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(integrity, "BITS", 2)
    sizes = [*range(1, 23), 32, 33, 63, 65, 70]
    rows = [(f"g{n}", i, hashlib.sha256(f"{n}:{i}".encode()).hexdigest()) for n in sizes for i in range(n)]
    leaves = spark.createDataFrame(rows, "g string, seq long, leaf string").repartition(5)
    found = integrity.rooted_proofs(leaves, "g", "seq", "leaf").collect()
    got = {(r["g"], r["place"]): (r["leaf"], r["proof"], r["root"]) for r in found}
    assert len(found) == len(got) == len(rows)
    for n in sizes:
        mine = [x for g, _, x in rows if g == f"g{n}"]
        proofs, root = plain(mine)
        assert [got[f"g{n}", i] for i in range(n)] == [(x, p, root) for x, p in zip(mine, proofs, strict=True)], n


def test_proofs_of_the_fixed_width(spark):
    rows = [("a", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(700)] + [("b", i, hashlib.sha256(str(-i).encode()).hexdigest()) for i in range(256)]
    leaves = spark.createDataFrame(rows, "g string, seq long, leaf string")
    found = integrity.rooted_proofs(leaves, "g", "seq", "leaf")
    roots = {r["g"]: r["root"] for r in integrity.merkle_roots(leaves, "g", "seq", "leaf").collect()}
    assert found.where(~integrity.merkle_included(F.col("leaf"), F.col("proof"), F.col("root"), F.col("place"))).count() == 0
    got = found.orderBy("g", "place").collect()
    for g in "ab":
        proofs, root = plain([x for k, _, x in rows if k == g])
        assert root == roots[g] and [(r["proof"], r["root"]) for r in got if r["g"] == g] == [(p, root) for p in proofs]
    # the shuffle of a block's join takes the block's nodes, not the proofs
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2, plan
