import zlib
from collections import defaultdict

import numpy as np

from tracewell.llm import sharding

DDL = "doc_id long, text string, h string, shard string, salt long"


def check(rows, got, shards):
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1] or "")
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.tokens) == (len(raw) + 8, zlib.crc32(raw), len(raw.split()))


def test_balance_groups_and_slots(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["word"] * int(n)) + f" {i}", "a", "b", 1) for i, n in enumerate(rng.integers(1, 300, 4000))]
    rows += [(10_000 + i, f"copy {i // 3}" * 20, None, None, None) for i in range(300)] + [(20_000 + i, "hot text " * 40, None, None, None) for i in range(2500)]
    got = sharding.shard(spark.createDataFrame(rows, DDL), shards=6).collect()
    check(rows, got, 6)
    for k, most in (("size", 0.01), ("tokens", 0.02), ("count", 0.05)):
        total = defaultdict(int)
        for r in got:
            total[r.shard] += 1 if k == "count" else r[k]
        assert max(total.values()) - min(total.values()) <= most * sum(total.values()) / 6 + 400, (k, total)
    where = defaultdict(set)
    for r in got:
        if 10_000 <= r.doc_id < 20_000:
            where[(r.doc_id - 10_000) // 3].add(r.shard)
    assert all(len(v) == 1 for v in where.values())


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, "é ñ x", None, None, None), (3, "é ñ x", None, None, None), (None, "x", None, None, None), (4, "long " * 30_000, None, None, None)]
    rows[2] = rows[3] = (3, "é ñ x", None, None, None)
    check(rows, sharding.shard(spark.createDataFrame(rows, DDL)).collect(), 24)
    assert sharding.shard(spark.createDataFrame([], DDL)).count() == 0


def test_many_groups_of_a_part_of_a_shard(spark):
    rng = np.random.default_rng(8)
    shards, capacity = 6, 400_000
    rows, used = [], 0
    while used < 0.9 * shards * capacity:  # groups of 0.05 to 0.3 shard, some of them three copies
        size, n = int(rng.uniform(0.05, 0.3) * capacity), 3 if len(rows) % 2 else 1
        text = f"{len(rows):06d} " * (size // 7 // n)
        rows += [(len(rows) + i, text, None, None, None) for i in range(n)]
        used += n * len(text)
    rows += [(10_000 + i, f"{i:06d} " * 20, None, None, None) for i in range(int((shards * capacity - used) / 150))]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sharding.shard(spark.createDataFrame(rows, DDL), shards=shards).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    check(rows, got, shards)
    total = [sum(r["size"] for r in got if r.shard == s) for s in range(shards)]
    spread = (max(total) - min(total)) * shards / sum(total)
    assert spread <= 0.05, (round(spread, 3), total)
