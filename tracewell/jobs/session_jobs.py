"""Registered queries: session logs from conversations, posture snapshots from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions
from .views import RECEIPTS, receipts, table

#: Lines of a log by number; ROLE stands for the turn's role.
LINES = ['{"type":"session"}', '{"type":" model_change ","x":1}', '{"type":"custom","customType":"a"}', '{"type":"custom"}', '{"type":"message","message":{"role":"ROLE","content":[{"type":"toolCall","name":"web_fetch"},{"type":"text"},{"type":"toolCall","name":"exec"}]}}', '{"type":"message","message":{"role":"assistant","content":"x"}}', '{"tool":"browser","sensitive_action_attempted":false}', '{"tool":"exec"}', "broken", "  ", '{"type":"else"}', "[1]", '{"tool":"browser","sensitive_action_attempted":true}']


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    line = F.element_at(F.array(*map(F.lit, LINES)), ((F.col("conv_id") * 7 + F.col("turn") * 3) % len(LINES) + 1).cast("int"))
    return c.groupBy("conv_id", "turn").agg(F.min("role").alias("role")).select((F.col("conv_id") % 40).alias("log"), (F.col("conv_id") * 100 + F.col("turn")).alias("line_no"), F.replace(line, F.lit("ROLE"), F.coalesce("role", F.lit(""))).alias("raw"))


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recognize(_logs(spark, sf_dir)).select("log", "line_no", "entry_type", "role", F.array_join("tools", ",").alias("tools"), "skip")


def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logs(spark, sf_dir)
    return sessions.report(rows, sessions.recognize(rows))


def web_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.web_receipts(sessions.recognize(_logs(spark, sf_dir)))


def posture_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("CLEAN", "DEBT_OUTSTANDING", "DEBT_OVERDUE", "ODD")))
    r = receipts(spark, sf_dir).where("user_id <> 3").withColumn("pack_id", F.col("trace_id"))
    snap = F.col("type") == "guardian_verdict"
    r = r.withColumn("posture", F.when(snap, F.element_at(names, (F.col("k") % 4 + 1).cast("int")))).withColumn("type", F.when(snap, "governance_posture_snapshot").otherwise(F.col("type")))
    return sessions.posture_eligible(r.withColumn("evaluated_at", F.substring("timestamp", 1, 7)), "DEBT_OUTSTANDING")


def changed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves with some lines dropped, doubled or replaced by rule."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before"))
    lines = F.split("before", "\n")
    edit = F.flatten(F.transform(lines, lambda x, i: F.when((i + F.col("doc_id")) % 7 == 3, F.array().cast("array<string>")).when((i + F.col("doc_id")) % 11 == 5, F.array(x, x)).when((i + F.col("doc_id")) % 13 == 2, F.array(F.lit("new"))).otherwise(F.array(x))))
    return sessions.changed_spans(d.withColumn("after", F.array_join(edit, "\n")), "doc_id", "before", "after")


QUERIES = {f.__name__: f for f in (session_rows, session_report, web_receipts, posture_eligible, changed_spans)}

_ROWS = f"""WITH c AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL), l AS (SELECT conv_id % 40 AS log, conv_id * 100 + turn AS line_no, role, (conv_id * 7 + turn * 3) % {len(LINES)} AS n FROM c)
, r AS (SELECT log, line_no, n, CASE WHEN n IN (3, 5, 11, 12) THEN 'invalid_entry' WHEN n = 4 AND coalesce(role, '') = '' THEN 'invalid_entry' WHEN n = 7 THEN 'unsupported_tool' WHEN n = 8 THEN 'json_error' WHEN n = 10 THEN 'unsupported_entry_type' END AS skip, role FROM l WHERE n <> 9)
, k AS (SELECT log, line_no, CASE WHEN skip IS NULL THEN CASE n WHEN 0 THEN 'session' WHEN 1 THEN 'model_change' WHEN 2 THEN 'custom' WHEN 6 THEN 'legacy_tool' ELSE 'message' END END AS entry_type, CASE WHEN skip IS NULL AND n = 4 THEN role END AS role,
  CASE WHEN n = 6 THEN 'browser' WHEN n = 4 AND role = 'assistant' THEN 'web_fetch,exec' ELSE '' END AS tools, skip FROM r)
"""

ORACLES = {
    "session_rows": _ROWS + "SELECT * FROM k",
    "session_report": _ROWS + """, a AS (SELECT log, count(*) AS lines, count_if(n = 9)::BIGINT AS blank FROM l GROUP BY log)
, b AS (SELECT log, count_if(skip IS NULL)::BIGINT AS imported, count_if(skip IS NOT NULL)::BIGINT AS skipped, sum(CASE tools WHEN '' THEN 0 WHEN 'browser' THEN 1 ELSE 2 END)::BIGINT AS tool_calls, array_to_string(list(line_no || ':' || skip ORDER BY line_no) FILTER (skip IS NOT NULL)[1:5], ',') AS first_skipped FROM k GROUP BY log)
SELECT log, lines, blank, coalesce(imported, 0) AS imported, coalesce(skipped, 0) AS skipped, coalesce(tool_calls, 0) AS tool_calls, first_skipped, CASE WHEN skipped > 0 THEN 'partial' ELSE 'clean' END AS state FROM a LEFT JOIN b USING (log)""",
    "web_receipts": _ROWS + "SELECT log, line_no, CASE tools WHEN 'browser' THEN 'browser' ELSE 'web_fetch' END AS tool, 'web_tool' AS type FROM k WHERE tools <> ''",
    "posture_eligible": "WITH RECURSIVE " + RECEIPTS.strip() + """, s AS (SELECT trace_id, ['CLEAN', 'DEBT_OUTSTANDING', 'DEBT_OVERDUE', 'ODD'][k % 4 + 1] AS p, row_number() OVER (PARTITION BY trace_id ORDER BY substr(timestamp, 1, 7) DESC, line_no DESC) AS rn FROM receipts WHERE type = 'guardian_verdict')
SELECT t.trace_id AS pack_id, p AS posture, coalesce(p IN ('CLEAN', 'DEBT_OUTSTANDING'), FALSE) AS passed FROM (SELECT DISTINCT trace_id FROM receipts WHERE user_id <> 3) t LEFT JOIN s ON s.trace_id = t.trace_id AND rn = 1""",
}
