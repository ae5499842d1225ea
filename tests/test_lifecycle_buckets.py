"""Open lifecycles of very many keys: a group of state holds a bucket of keys, each with its own timer."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from tracewell.streaming import streams

HOUR = 3_600_000_000


def test_keys_share_groups_of_state_but_no_timer(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    told = lambda h: datetime.fromtimestamp(h * 3600, UTC)
    batches = [
        [(f"k{i}", "o", "open", told(10 + i % 5)) for i in range(3000)] + [(None, "o", "open", told(10)), ("never", "n", None, told(9))],
        # the watermark is at 14: some of these keys' timers are due, and their buckets hold others that are due as well
        [(f"k{i}", "c", "close", told(15)) for i in range(0, 3000, 7)] + [(f"k{i}", "n", None, told(15)) for i in range(0, 3000, 5)] + [("x", "n", None, told(17))],
        [("x", None, None, told(18)), (None, "again", "open", told(18))],
    ]
    ddl = "key string, type string, step string, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
    stream = streams.open_lifecycles(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source), 7200.0, late="0 seconds", buckets=3)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert all(s["numRowsTotal"] <= 3 for p in query.recentProgress for s in p["stateOperators"])
    rows = spark.read.parquet(out).withColumn("us", F.unix_micros("opened_at")).collect()
    got = {r["key"]: (r["us"], r["receipts"], r["last_type"]) for r in rows}
    want = {f"k{i}": ((10 + i % 5) * HOUR, 1 + (i % 5 == 0), "n" if i % 5 == 0 else "o") for i in range(3000) if i % 7}
    assert got == want | {None: (10 * HOUR, 1, "o")} and len(rows) == len(got)
