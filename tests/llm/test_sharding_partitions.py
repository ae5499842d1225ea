import pytest
from pyspark.sql import functions as F

from tracewell.llm.queries import op5_shard

DIR = "/root/testdata/sf0.01"


@pytest.fixture
def uncoalesced(spark):
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "false")
    yield lambda n: spark.conf.set(keys[1], n)
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("partitions", [1, 16, 64, 200])
def test_balance_with_many_or_empty_partitions(spark, uncoalesced, partitions):
    uncoalesced(partitions)
    got = op5_shard(spark, DIR).groupBy("shard").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.max("slot").alias("last")).collect()
    assert len(got) == 24 and all(r.last == r.rows - 1 for r in got)
    sizes = [r["size"] for r in got]
    assert (max(sizes) - min(sizes)) * 24 <= 0.02 * sum(sizes), (min(sizes), max(sizes))
    tokens = [r.tokens for r in got]
    assert (max(tokens) - min(tokens)) * 24 <= 0.03 * sum(tokens), (min(tokens), max(tokens))


@pytest.mark.parametrize("partitions", [64, 200])
def test_few_rows_in_many_partitions(spark, uncoalesced, partitions):
    uncoalesced(partitions)
    rows = op5_shard(spark, "/root/testdata/sf0.001").collect()
    assert len({r.shard for r in rows}) == 24
