"""Hot ids: what is drawn for learning stays bounded, and shards stay even, whatever ids repeat."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import language, sharding, toxicity


@pytest.mark.parametrize("hot", [7, None])
def test_language_sample(spark, hot):
    one = spark.range(20_000).select(F.lit(hot).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 9000).alias("text"), F.lit("en").alias("lang"))
    rest = spark.range(30_000, 33_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("other "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    got = language.sample(one.union(rest), F.lit(True), "lang", "doc_id", "text", 200)
    assert set(got) == {"en", "de"} and all(100 <= len(v) <= 400 for v in got.values())
    assert len(set(got["en"])) == len(got["en"])
    few = language.sample(rest, F.lit(True), "lang", "doc_id", "text", 200, most_bytes=110)
    assert all(sum(map(len, v)) <= 110 and v for v in few.values())


def test_toxicity_sample(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, base: seen.update(texts=texts, labels=labels, base=base))
    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).union(spark.range(2, 500).select("id", F.concat(F.lit("u"), "id")))
    labels = spark.range(0, 500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    toxicity.train(docs, labels, F.lit(True), size=400)
    assert len(seen["texts"]) == len(set(seen["texts"])) <= 500 and sum(t.startswith("t") for t in seen["texts"]) == 1


@pytest.mark.parametrize("hot", [7, None])
def test_hot_id_is_split(spark, hot):
    one = spark.range(6000).select(F.lit(hot).cast("long").alias("doc_id"), F.lit("the same words " * 20).alias("text"))
    rest = spark.range(10_000, 10_200).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), "id").alias("text"))
    total, slots = defaultdict(int), defaultdict(list)
    for r in sharding.shard(one.union(rest), shards=8).collect():
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(total) == 8 and max(total.values()) - min(total.values()) <= 0.02 * sum(total.values()) / 8
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
