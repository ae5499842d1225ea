"""Registered queries: reviewer packets. Orders are packets, their items questions and coverage rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packets
from .report_jobs import pick
from .views import table

NOW = "1996-01-01 00:00:00"
STATUSES = ("EVIDENCED", "PARTIAL", "FAILED", "HUMAN_ATTESTED", "OUT_OF_SCOPE", "LATER")
RULES = ("ALL_EVIDENCE_REQUIRED", "PARTIAL_IF_RATIO_LT_1", "HUMAN_ATTESTED", "OUT_OF_SCOPE", "OTHER")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("packet_id"), F.col("l_linenumber").alias("question_id"), F.concat(F.lit("q"), "l_linenumber").alias("prompt"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("flag"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).groupBy("packet_id", "question_id", "prompt").agg(F.min("p").alias("p"), F.min("s").alias("s"))
    return rows.select("packet_id", "question_id", "prompt", pick(RULES, F.col("s")).alias("status_rule"), (F.col("p") % 11 != 0).alias("in_scope"), (F.col("p") % 10).alias("numerator"), (F.col("p") % 7).alias("denominator"))


def question_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _items(spark, sf_dir).where("p % 5 <> 0").select("packet_id", "question_id", (F.col("s") % 3).alias("position"), F.concat(F.lit("FIELD#"), F.col("p")).alias("ref"), (F.nullif(F.col("flag"), F.lit("A")) == "N").alias("holds"))
    found = packets.question_status(_questions(spark, sf_dir), evidence)
    return found.select("packet_id", "question_id", "status", "refs", "error")


def packet_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    codes = F.when(c % 19 == 0, F.array(F.lit("W_OLD"), F.lit("E_SIG_BAD"))).when(c % 7 == 0, F.array(F.lit("E_OTHER")))
    p = table(spark, sf_dir, "orders").select(
        k.alias("packet_id"), F.when(k % 23 == 0, "FAIL").when(k % 2 == 0, "PASS").alias("receipt_integrity"), codes.alias("error_codes"), F.when(k % 5 != 0, k % 5 != 1).alias("claim_passed"), F.when(c % 2 == 0, "FAIL").alias("claim_check"),
        F.when(k % 4 == 1, "VERIFIED").when(k % 4 == 2, "VERIFIED_WITH_GAPS").alias("baseline_state"), day.cast("timestamp").alias("generated_at"), F.when(k % 31 != 0, F.date_sub(day, (k % 60).cast("int"))).cast("timestamp").alias("evidence_time"), F.when(c % 3 == 0, "P30D").when(c % 3 == 1, "P1M").alias("stale_after"), F.date_add(day, 900).cast("timestamp").alias("expires_at"),
    )
    return packets.settlement(packets.freshness(p, NOW), question_status(spark, sf_dir)).select("packet_id", "integrity_state", "claim_state", "freshness_state", "regression_state", "settlement_state")


def decision_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth question has no entry among the questions."""
    coverage = _items(spark, sf_dir).select("packet_id", "prompt", pick(STATUSES, F.col("p")).alias("status"))
    return packets.decision_points(coverage, _questions(spark, sf_dir).where("question_id % 4 <> 0"))


def decision_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.census(decision_points(spark, sf_dir))


def decision_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.decision_gaps(decision_points(spark, sf_dir)).select("packet_id", "prompt", "source_status", "severity", "probable_cause", "remediation_hint")


def gap_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.gap_gate(decision_points(spark, sf_dir), 1, 1, 2)


def authorization_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.authorization_paths(decision_points(spark, sf_dir))


QUERIES = {f.__name__: f for f in (question_status, packet_settlement, decision_points, decision_census, decision_gaps, gap_gate, authorization_paths)}

_ITEMS = """
WITH i AS (SELECT l_orderkey AS packet_id, l_linenumber AS question_id, 'q' || l_linenumber AS prompt, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag FROM lineitem
), q AS (
  SELECT packet_id, question_id, prompt, min(p) % 11 <> 0 AS in_scope, min(p) % 10 AS num, min(p) % 7 AS den,
         ['ALL_EVIDENCE_REQUIRED', 'PARTIAL_IF_RATIO_LT_1', 'HUMAN_ATTESTED', 'OUT_OF_SCOPE', 'OTHER'][CAST(min(s) % 5 + 1 AS INT)] AS rule
  FROM i GROUP BY packet_id, question_id, prompt
)"""

_STATUS = _ITEMS + """, e AS (
  SELECT packet_id, question_id, bool_and(flag = 'N') AS holds, string_agg('FIELD#' || p, '; ' ORDER BY s % 3, 'FIELD#' || p) AS refs FROM i WHERE p % 5 <> 0 GROUP BY packet_id, question_id
), j AS (SELECT q.*, e.holds, e.refs AS r, NOT in_scope OR rule = 'OUT_OF_SCOPE' AS outside FROM q LEFT JOIN e ON q.packet_id = e.packet_id AND q.question_id = e.question_id
), status AS (
  SELECT packet_id, question_id,
         CASE WHEN outside THEN 'OUT_OF_SCOPE' WHEN rule = 'HUMAN_ATTESTED' THEN rule WHEN rule = 'ALL_EVIDENCE_REQUIRED' AND holds THEN 'EVIDENCED' WHEN rule = 'ALL_EVIDENCE_REQUIRED' AND NOT holds THEN 'FAILED'
              WHEN rule = 'PARTIAL_IF_RATIO_LT_1' AND den > 0 AND num >= den THEN 'EVIDENCED' WHEN rule = 'PARTIAL_IF_RATIO_LT_1' AND den > 0 THEN 'PARTIAL' END AS status,
         CASE WHEN NOT outside AND rule = 'ALL_EVIDENCE_REQUIRED' THEN r END AS refs,
         CASE WHEN outside THEN NULL WHEN rule = 'OTHER' THEN 'unsupported_status_rule' WHEN rule = 'PARTIAL_IF_RATIO_LT_1' AND den = 0 THEN 'invalid_ratio_denominator'
              WHEN rule = 'ALL_EVIDENCE_REQUIRED' AND holds IS NULL THEN 'mapping_missing_evidence' END AS error
  FROM j
)"""

_POINTS = _ITEMS + """, c AS (SELECT packet_id, prompt, ['EVIDENCED', 'PARTIAL', 'FAILED', 'HUMAN_ATTESTED', 'OUT_OF_SCOPE', 'LATER'][CAST(p % 6 + 1 AS INT)] AS source_status FROM i
), known(source_status, a, b, c, h, seen, state) AS (VALUES
  ('EVIDENCED', 'coverage_evidence', 'machine_evidence', 'machine_evidence', FALSE, 'emitted', 'emitted'),
  ('PARTIAL', 'coverage_evidence', 'coverage_measurement', 'coverage_measurement', FALSE, 'partial', 'uncertain'),
  ('FAILED', 'coverage_evidence', 'required_proof', 'missing_authorization', FALSE, NULL, 'missing'),
  ('HUMAN_ATTESTED', 'human_attestation', 'human_attestation', 'human_attestation', TRUE, 'human_attested', 'human_attested'),
  ('OUT_OF_SCOPE', 'unknown', 'none', 'scope_exclusion', FALSE, NULL, 'out_of_scope'),
  ('LATER', 'unknown', 'unknown', 'unknown', NULL, 'uncertain', 'uncertain')
), ruled(rule, a, b, c, h) AS (VALUES
  ('ALL_EVIDENCE_REQUIRED', 'proof_pack_verification', 'machine_evidence', 'machine_evidence', FALSE),
  ('PARTIAL_IF_RATIO_LT_1', 'coverage_measurement', 'coverage_measurement', 'coverage_measurement', FALSE),
  ('HUMAN_ATTESTED', 'human_attestation', 'human_attestation', 'human_attestation', TRUE),
  ('OUT_OF_SCOPE', 'out_of_scope', 'none', 'scope_exclusion', FALSE)
), points AS (
  SELECT c.packet_id, c.prompt, c.source_status, q.question_id, coalesce(r.a, k.a) AS expected_receipt_type, coalesce(r.b, k.b) AS expected_emission, coalesce(r.c, k.c) AS authorization_source,
         coalesce(r.h, k.h) AS human_crossing, k.seen AS observed_emission, k.state AS status
  FROM c JOIN known k ON c.source_status = k.source_status LEFT JOIN (SELECT * FROM q WHERE question_id % 4 <> 0) q ON c.packet_id = q.packet_id AND c.prompt = q.prompt LEFT JOIN ruled r ON q.rule = r.rule
), n AS (SELECT packet_id, count(*) FILTER (status <> 'out_of_scope') AS e, count(*) FILTER (status = 'missing') AS m, count(*) FILTER (status = 'uncertain') AS u FROM points GROUP BY packet_id
)
"""

ORACLES = {
    "question_status": _STATUS + " SELECT * FROM status",
    "packet_settlement": _STATUS + """, rows AS (
  SELECT packet_id, count(*) FILTER (status <> 'OUT_OF_SCOPE') AS n, count(*) FILTER (status IN ('PARTIAL', 'HUMAN_ATTESTED')) > 0 AS partial, count(*) FILTER (status = 'FAILED') > 0 AS failed FROM status GROUP BY packet_id
), p AS (
  SELECT o_orderkey AS packet_id, CASE WHEN o_orderkey % 23 = 0 OR o_custkey % 19 = 0 THEN 'FAIL' ELSE 'PASS' END AS integrity_state,
         CASE WHEN o_orderkey % 5 > 1 OR (o_orderkey % 5 = 0 AND o_custkey % 2 <> 0) THEN 'PASS' ELSE 'FAIL' END AS claim_state,
         CASE WHEN o_orderkey % 31 = 0 OR o_custkey % 3 = 1 OR (o_custkey % 3 = 0 AND o_orderkey % 60 > 30) OR DATE '1996-01-01' > CAST(o_orderdate AS DATE) + 900 THEN 'STALE' ELSE 'FRESH' END AS freshness_state,
         o_orderkey % 4 = 1 AND (coalesce(partial, FALSE) OR coalesce(failed, FALSE)) AS worse, coalesce(n, 0) AS n, coalesce(partial, FALSE) AS partial, coalesce(failed, FALSE) AS failed
  FROM orders LEFT JOIN rows ON o_orderkey = packet_id
)
SELECT packet_id, integrity_state, claim_state, freshness_state, CASE WHEN worse THEN 'REGRESSED' ELSE 'NONE' END AS regression_state,
       CASE WHEN integrity_state = 'FAIL' THEN 'TAMPERED' WHEN n = 0 THEN 'OUT_OF_SCOPE' WHEN worse THEN 'EVIDENCE_REGRESSION' WHEN claim_state = 'FAIL' THEN 'INCOMPLETE_EVIDENCE' WHEN partial THEN 'VERIFIED_WITH_GAPS'
            WHEN failed THEN 'INCOMPLETE_EVIDENCE' WHEN freshness_state = 'STALE' THEN 'VERIFIED_WITH_GAPS' ELSE 'VERIFIED' END AS settlement_state
FROM p
""",
    "decision_points": _POINTS + "SELECT * FROM points",
    "decision_census": _POINTS + """
SELECT n.packet_id, e AS expected_count, o AS observed_count, m AS missing_count, CASE WHEN e = 0 THEN 0.0::DOUBLE ELSE o::DOUBLE / e END AS coverage_ratio,
       CASE WHEN e = 0 THEN 'uncensusable' WHEN m > 0 THEN 'incomplete' WHEN u > 0 THEN 'degraded' ELSE 'complete' END AS coverage_state,
       CASE WHEN m > 1 THEN 'high' WHEN m = 1 THEN 'medium' WHEN u > 0 THEN 'low' ELSE 'none' END AS omission_severity
FROM n JOIN (SELECT packet_id, count(*) FILTER (status IN ('emitted', 'human_attested', 'uncertain')) AS o FROM points GROUP BY packet_id) x ON n.packet_id = x.packet_id
""",
    "decision_gaps": _POINTS + """
SELECT packet_id, prompt, source_status, CASE status WHEN 'missing' THEN 'high' ELSE 'medium' END AS severity,
       CASE source_status WHEN 'FAILED' THEN 'Declared evidence was not satisfied in the packet.' WHEN 'PARTIAL' THEN 'Coverage was partial in the packet surface.' ELSE 'Observed evidence is incomplete or degraded.' END AS probable_cause,
       CASE status WHEN 'missing' THEN 'Collect or surface the expected ' || expected_emission || '.' ELSE 'Complete or tighten the ' || expected_emission || ' path, then rerun the census.' END AS remediation_hint
FROM points WHERE status IN ('missing', 'uncertain')
""",
    "gap_gate": _POINTS + "SELECT packet_id, m AS missing_count, u AS uncertain_count, m + u AS gap_count, CASE WHEN m > 1 OR m + u > 2 THEN 'fail' WHEN u > 1 THEN 'warn' ELSE 'pass' END AS gate FROM n",
    "authorization_paths": _POINTS + "SELECT packet_id, authorization_source, count(*) FILTER (status <> 'out_of_scope') AS points, count(*) FILTER (human_crossing) AS human_crossings FROM points GROUP BY ALL HAVING count(*) FILTER (status <> 'out_of_scope' OR human_crossing) > 0",
}
