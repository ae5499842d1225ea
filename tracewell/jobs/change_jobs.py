"""Registered queries: renames in change sets, lifecycles that stay open, tool budgets and the trace sink as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import shared_folder
from ..operators import renames
from ..sources.receipts import from_events
from ..streaming import streams
from .text_jobs import _landed
from .views import sql, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def rename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as change sets: each turn's text is deleted, and most come again elsewhere, some of them changed."""
    t = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    end = F.element_at(F.array(*map(F.lit, (".md", ".txt", ".md", ".bin"))), (F.col("turn") % 4 + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    gone = t.select(F.col("conv_id").alias("change_set"), F.concat(F.lit("a/"), "turn", end).alias("before_path"), F.lit(None).cast("string").alias("after_path"), text.alias("text"))
    new = F.when(F.col("turn") % 3 == 0, text).otherwise(F.concat(F.substr(text, F.lit(1) + F.char_length(text) / 5), F.lit(" and more")))
    come = t.where("(conv_id + turn) % 7 <> 2").select(F.col("conv_id").alias("change_set"), F.lit(None).cast("string"), F.concat(F.lit("b/"), "turn", end), new)
    return renames.pair_renames(gone.union(come))


def open_lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    k, n = F.regexp_extract("props", "([0-9]+)", 1).cast("long"), F.col("event_id") % 7
    rows = e.select(F.concat("user_id", F.lit("-"), k % 20).alias("key"), F.col("event_type").alias("type"), F.when(n == 0, "open").when(n == 3, "close").alias("step"), "ts")
    found = _landed(spark, streams.open_lifecycles(rows, 3 * 86_400.0))
    return found.select("key", F.unix_micros("opened_at").alias("opened_us"), "receipts", "last_type", F.unix_micros("last_at").alias("last_us"))


def tool_budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, streams.tool_budgets(_tool_calls(spark, sf_dir), {"tool_1": 2, "tool_2": 0}, default=4))


def _tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(_events(spark, sf_dir))


def trace_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, every 31st of them cut short, through the sink: rows by date, good or not."""
    e = _events(spark, sf_dir)
    raw = F.to_json(F.struct(F.concat(F.lit("r_"), "event_id").alias("receipt_id"), F.col("event_type").alias("type")))
    lines = e.select(F.when(F.col("event_id") % 31 == 0, F.substring(raw, 1, 20)).otherwise(raw).alias("raw"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    path = f"{shared_folder(spark)}/tracewell-{uuid.uuid4().hex}"
    streams.write_traces(lines, f"{path}/good", f"{path}/bad", f"{path}/checkpoint").awaitTermination()
    good = spark.read.parquet(f"{path}/good").select(F.col("date").cast("string").alias("date"), F.lit(True).alias("ok"), "receipt_id")
    bad = spark.read.parquet(f"{path}/bad").select(F.col("date").cast("string"), F.lit(False), F.lit(None).cast("string"))
    return good.union(bad).groupBy("date", "ok").agg(F.count("*").alias("n"), F.count_distinct("receipt_id").alias("ids"))


QUERIES = {f.__name__: f for f in (rename_pairs, open_lifecycle_stream, tool_budget_stream, trace_sink)}
ORACLES = {
    "open_lifecycle_stream": """
WITH e AS (
  SELECT user_id || '-' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20) AS key, event_type AS type, event_id % 7 AS n, epoch_us(ts) AS told FROM events
), o AS (SELECT key, min(told) FILTER (WHERE n = 0) AS opened, bool_or(n = 3) AS closed FROM e GROUP BY key
)
SELECT key, opened AS opened_us, count(*) AS receipts, arg_max(type, told) AS last_type, max(told) AS last_us FROM e JOIN o USING (key)
WHERE opened IS NOT NULL AND NOT closed AND told >= opened AND opened + 3 * 86400000000 < (SELECT max(told) FROM e) - 600000000 GROUP BY key, opened
""",
    "tool_budget_stream": sql("""SELECT trace_id AS session, tool_name, seq, row_number() OVER (PARTITION BY trace_id, tool_name ORDER BY seq) <= CASE tool_name WHEN 'tool_1' THEN 2 WHEN 'tool_2' THEN 0 ELSE 4 END AS allowed FROM receipts WHERE type = 'mcp_tool_call'"""),
    "trace_sink": "SELECT strftime(ts, '%Y-%m-%d') AS date, event_id % 31 <> 0 AS ok, count(*) AS n, count(*) FILTER (WHERE event_id % 31 <> 0) AS ids FROM events GROUP BY 1, 2",
}
