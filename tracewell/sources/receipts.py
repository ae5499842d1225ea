"""Receipts: the wide schema, the readers, and the view of an event stream as receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Known columns of a receipt. Unknown keys live on in ``raw`` only.
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("receipt_id", "type", "receipt_type", "timestamp", "_stored_at", "schema_version", "run_id", "_trace_id", "parent_receipt_id", "episode_id", "model_id", "model", "provider", "finish_reason", "error", "callsite_id", "callsite_file", "callsite_line", "tool_name", "outcome", "policy_verdict", "policy_reason", "session_id", "verdict", "action", "reason", "posture", "evaluated_at", "policy_hash", "governance_hash", "signature", "payload_hash")]
    + [T.StructField(c, T.LongType()) for c in ("seq", "_store_seq", "input_tokens", "output_tokens", "total_tokens")]
    + [T.StructField("latency_ms", T.DoubleType()), T.StructField("duration_ms", T.DoubleType()), T.StructField("allowed", T.BooleanType())]
)


def parse_time(column: Column) -> Column:
    """ISO-8601 text to a timestamp, null on junk; a text without a zone counts as UTC (session zone)."""
    return F.when(column.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(column))


def normalize(receipts: DataFrame) -> DataFrame:
    """One name for each alias: type, timestamp, model and trace."""
    has = set(receipts.columns)
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in has])
    out = receipts.withColumn("type", first("type", "receipt_type")).withColumn("timestamp", first("timestamp", "_stored_at"))
    out = out.withColumn("model_id", F.coalesce(first("model_id", "model"), F.lit("unknown"))).withColumn("trace_id", first("_trace_id", "run_id"))
    return out.withColumn("ts", parse_time(F.col("timestamp")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    return text.select("source_file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "raw")).where("trim(raw) <> ''")


def read_pack_receipts(spark: SparkSession, path: str) -> DataFrame:
    """JSONL receipts of packs with line order; the pack is the file's folder. Blank lines are skipped."""
    lines = _lines(spark, path).withColumn("pack_id", F.regexp_extract("source_file", r"([^/]+)/[^/]+$", 1))
    return normalize(lines.withColumn("r", F.from_json("raw", SCHEMA)).select("pack_id", "source_file", "line_no", "raw", "r.*"))


def read_history(spark: SparkSession, path: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(receipts of date folders from ``cutoff`` on, unreadable lines of those folders)."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_file")).where("trim(raw) <> ''")
    rows = lines.withColumn("date", F.to_date(F.regexp_extract("source_file", r"(\d{4}-\d{2}-\d{2})/[^/]+$", 1))).where(F.col("date") >= F.lit(cutoff).cast("date"))
    rows = rows.withColumn("ok", F.expr("try_parse_json(raw)").isNotNull())
    good = normalize(rows.where("ok").withColumn("r", F.from_json("raw", SCHEMA)).select("source_file", "date", "raw", "r.*"))
    return good, rows.where("not ok").select("source_file", "date", "raw")


def in_window(receipts: DataFrame, end: str, days: int = 7) -> DataFrame:
    """Receipts from ``days`` before ``end`` up to it, both ends included."""
    stop = F.lit(end).cast("timestamp")
    return receipts.where(F.col("ts").between(stop - F.make_dt_interval(F.lit(days)), stop))


def read_pack_files(spark: SparkSession, path: str) -> DataFrame:
    """(pack_id, path, length, sha256) of packs' files; contents are dropped once hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("pack_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "length", F.sha2("content", 256).alias("sha256"))


#: Models of the event view: a known name, one with a suffix, names that others begin, and an unknown one.
VIEW_MODELS = ["gpt-4o", "gpt-4o-mini", "gpt-4", "claude-sonnet-4-20250514", "gemini-1.5-pro", "in-house"]


def from_events(events: DataFrame) -> DataFrame:
    """The event stream as receipts: each event is one model call, tool call or verdict."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    base = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"))
    model = F.element_at(F.array(*map(F.lit, VIEW_MODELS)), (F.col("k") % 6 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "click", "mcp_tool_call").when(F.col("event_type") == "signup", "guardian_verdict").otherwise("model_call")
    call, tool = F.col("type") == "model_call", F.col("type") == "mcp_tool_call"
    outcome = F.when(F.col("k") % 10 < 2, "denied").when(F.col("k") % 10 == 2, "timeout").when(F.col("k") % 10 == 3, "failed").otherwise("ok")
    return (
        base.withColumn("type", kind)
        .withColumn("receipt_id", F.concat(F.lit("r_"), F.col("event_id") - F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)))
        .withColumn("trace_id", F.concat(F.lit("t_"), "user_id"))
        .withColumn("pack_id", F.concat(F.lit("p_"), F.col("user_id") % 20))
        .withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .withColumn("seq", F.col("event_id"))
        .withColumn("line_no", F.col("event_id"))
        .withColumn("model_id", F.when(call, model))
        .withColumn("provider", F.when(call, F.element_at(F.array(*map(F.lit, ("openai", "anthropic", "google"))), (F.col("k") % 3 + 1).cast("int"))))
        .withColumn("input_tokens", F.when(call, F.col("k") * 10))
        .withColumn("output_tokens", F.when(call, F.col("k") * 3))
        .withColumn("total_tokens", F.when(call & (F.col("k") % 4 == 0), F.lit(0).cast("long")).when(call, F.col("k") * 13))
        .withColumn("latency_ms", F.when(call & (F.col("k") % 11 != 0), F.floor(F.col("value") * 10).cast("double")))
        .withColumn("error", F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("k") % 3)))
        .withColumn("finish_reason", F.when(call & (F.col("k") % 5 > 0), F.when(F.col("k") % 2 == 0, "stop").otherwise("length")))
        .withColumn("callsite_id", F.when(call & (F.col("k") % 7 < 5), F.concat(F.lit("c_"), F.col("k") % 7)))
        .withColumn("callsite_file", F.when(F.col("callsite_id").isNotNull(), F.concat(F.lit("app"), F.col("k") % 7, F.lit(".py"))))
        .withColumn("tool_name", F.when(tool, F.concat(F.lit("tool_"), F.col("k") % 7)))
        .withColumn("outcome", F.when(tool, outcome))
        .withColumn("allowed", F.when(tool, F.col("k") % 10 != 0))
        .withColumn("policy_verdict", F.when(tool & (F.col("k") % 10 == 1), "deny").when(tool, "allow"))
        .withColumn("verdict", F.when(F.col("type") == "guardian_verdict", F.when(F.col("k") % 3 == 0, "deny").otherwise("allow")))
        .withColumn("action", F.when(F.col("type") == "guardian_verdict", F.concat(F.lit("act_"), F.col("k") % 4)))
    )
