"""Registered queries: answers (orders) against evidence (their items)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers
from .views import table

STATUS = ["ANSWERED", "PARTIAL", "INSUFFICIENT_EVIDENCE", "OUT_OF_SCOPE"]
KINDS = ["TECH_CONTROL", "METRIC", "PROCESS", "INCIDENT", "COMMITMENT"]


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda e, names: F.element_at(F.array(*map(F.lit, names)), (e % len(names) + 1).cast("int"))
    return o.select(k.alias("answer_id"), pick(c, STATUS).alias("status"), (k % 3 != 0).alias("factual"), pick(k, KINDS).alias("claim_type"), F.when(c % 5 < 2, True).when(c % 5 == 2, False).alias("answer_bool"), F.when(k % 7 == 0, 2).otherwise(0).alias("missing_requests"))


def answer_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    refs = items.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("ref_no"), (F.col("l_partkey") % 6 != 0).alias("resolved"), (F.col("l_partkey") % 4 == 1).alias("numeric"), (F.col("l_suppkey") % 3 == 0).alias("affirmative"), F.date_diff(F.lit("2002-01-01").cast("date"), F.col("l_shipdate").cast("date")).alias("age_days"))
    return answers.findings(_answers(spark, sf_dir), refs, 900, ["TECH_CONTROL"]).groupBy("answer_id", "level", "code").agg(F.count("*").alias("n"))


def answer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.status_counts(_answers(spark, sf_dir), ["claim_type"])


def lock_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pack_id"), F.sha2("text", 256).alias("digest"))
    locked = d.where("pack_id % 13 <> 4").withColumn("digest", F.when(F.col("pack_id") % 11 == 0, "x").otherwise(F.col("digest")))
    return answers.digests_match(d.where("pack_id % 17 <> 3"), locked)


ASKS = ["Do you have a count of calls?", "What is the latency?", "Is there a breach plan", "SOC 2 report", "Do you guarantee uptime?", "GDPR terms", "Review procedure", "Who holds the keys?", "  Are token limits set?"]


def compiled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as questions to organisations, whose packs are customers and receipts their orders."""
    t, o = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "orders")
    ask = F.element_at(F.array(*map(F.lit, ASKS)), ((F.col("conv_id") + F.col("turn")) % len(ASKS) + 1).cast("int"))
    q = t.where("conv_id is not null and turn is not null").select((F.col("conv_id") % 97).alias("org"), F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.when(F.col("turn") % 4 == 3, F.col("text")).otherwise(F.concat_ws(" ", ask, F.substring("text", 1, 3))).alias("question_text"))
    c = F.col("c_custkey")
    packs = table(spark, sf_dir, "customer").where("c_custkey % 97 <> 13").select((c % 97).alias("org"), F.concat(F.lit("p"), c).alias("pack_id"), F.when(c % 3 > 0, c % 5).alias("attested"))
    receipts = o.where("o_custkey % 4 > 0").select((F.col("o_custkey") % 97).alias("org"), F.concat(F.lit("p"), "o_custkey").alias("pack_id"), F.col("o_orderkey").alias("line_no"), F.concat(F.lit("r"), "o_orderkey").alias("receipt_id"))
    found = answers.compile_answers(q, packs, receipts)
    return found.select("org", "question_id", "status", "answer_mode", "claim_type", "answer_bool", "answer_value", "details", "confidence", "evidence_ref.*", "review_owner_hint", F.array_join("risk_flags", ",").alias("risk_flags"), F.size("missing_evidence_requests").alias("missing"))


QUERIES = {f.__name__: f for f in (answer_findings, answer_coverage, lock_digests, compiled_answers)}

_A = f"WITH a AS (SELECT o_orderkey AS k, {STATUS!r}[o_custkey % 4 + 1] AS s, o_orderkey % 3 <> 0 AS factual, {KINDS!r}[o_orderkey % 5 + 1] AS kind, o_custkey % 5 < 2 AS yes, o_orderkey % 7 = 0 AS missing FROM orders)"

ORACLES = {
    "compiled_answers": f"""
WITH q AS (
  SELECT conv_id % 97 AS org, conv_id || ':' || turn AS question_id, coalesce(CASE WHEN turn % 4 = 3 THEN text ELSE {ASKS!r}[(conv_id + turn) % 9 + 1] || coalesce(' ' || substr(text, 1, 3), '') END, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), k AS (
  SELECT *, CASE WHEN regexp_matches(lower(text), 'soc 2|iso|certif|attest') THEN 'CERTIFICATION' WHEN regexp_matches(lower(text), 'incident|breach|outage|security event') THEN 'INCIDENT' WHEN regexp_matches(lower(text), 'metric|count|number|latency|token|cost') THEN 'METRIC'
    WHEN regexp_matches(lower(text), 'commit|roadmap|guarantee|promise') THEN 'COMMITMENT' WHEN regexp_matches(lower(text), 'gdpr|dpa|legal|contract|privacy law') THEN 'LEGAL' WHEN regexp_matches(lower(text), 'process|policy|procedure|review') THEN 'PROCESS' ELSE 'TECH_CONTROL' END AS claim_type FROM q
), p AS (
  SELECT c_custkey % 97 AS org, min('p' || c_custkey) AS pack_id FROM customer WHERE c_custkey % 97 <> 13 GROUP BY ALL
), r AS (
  SELECT 'p' || o_custkey AS pack_id, count(*) AS held, min(o_orderkey) AS first FROM orders WHERE o_custkey % 4 > 0 GROUP BY ALL
), f AS (
  SELECT org, p.pack_id, CASE WHEN CAST(p.pack_id[2:] AS BIGINT) % 3 > 0 THEN CAST(p.pack_id[2:] AS BIGINT) % 5 ELSE coalesce(held, 0) END AS n, first FROM p LEFT JOIN r USING (pack_id)
), s AS (
  SELECT k.*, pack_id, n, first, CASE WHEN claim_type = 'METRIC' AND pack_id IS NOT NULL THEN 'm' WHEN claim_type IN ('PROCESS', 'TECH_CONTROL', 'INCIDENT') AND first IS NOT NULL THEN 'a' WHEN claim_type IN ('LEGAL', 'COMMITMENT', 'CERTIFICATION') THEN claim_type ELSE '-' END AS said FROM k LEFT JOIN f USING (org)
)
SELECT org, question_id, CASE said WHEN 'm' THEN 'ANSWERED' WHEN 'a' THEN 'PARTIAL' WHEN 'LEGAL' THEN 'PARTIAL' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, CASE claim_type WHEN 'LEGAL' THEN 'POLICY_ONLY' ELSE 'EVIDENCE_PLUS_EXPLANATION' END AS answer_mode, claim_type,
  CASE WHEN said = 'm' AND regexp_matches(lower(trim(text)), '^(do|does|is|are|can|will|have|has) ') THEN n > 0 END AS answer_bool, CASE said WHEN 'm' THEN n END AS answer_value,
  CASE said WHEN 'm' THEN 'Observed ' || n || ' receipts in the evidence pack attestation.' WHEN 'a' THEN 'Receipts show operational activity, but direct control attestation is not explicit.' WHEN 'LEGAL' THEN 'Legal/compliance response requires human legal review before final submission.' WHEN 'COMMITMENT' THEN 'Policy profile disallows commitment claims without explicit allowlist.'
    WHEN 'CERTIFICATION' THEN 'No direct certification artifact found in provided evidence packs.' ELSE 'Insufficient direct evidence in provided proof packs.' END AS details,
  CAST(CASE said WHEN 'm' THEN 0.95 WHEN 'a' THEN 0.6 WHEN 'LEGAL' THEN 0.45 WHEN 'COMMITMENT' THEN 0.1 WHEN 'CERTIFICATION' THEN 0.15 ELSE 0.2 END AS DOUBLE) AS confidence,
  CASE WHEN said IN ('m', 'a') THEN pack_id END AS pack_id, CASE said WHEN 'm' THEN '__manifest__' WHEN 'a' THEN 'r' || first END AS receipt_id, CASE said WHEN 'm' THEN 'REPORT_SECTION' WHEN 'a' THEN 'RECEIPT' END AS evidence_kind, CASE said WHEN 'm' THEN 'attestation.n_receipts' WHEN 'a' THEN 'type' END AS pointer,
  CASE claim_type WHEN 'LEGAL' THEN 'LEGAL' WHEN 'INCIDENT' THEN 'SECURITY' WHEN 'TECH_CONTROL' THEN 'SECURITY' WHEN 'COMMITMENT' THEN 'ENG' ELSE 'NONE' END AS review_owner_hint,
  CASE claim_type WHEN 'LEGAL' THEN 'LEGAL_REVIEW' WHEN 'INCIDENT' THEN 'SECURITY_REVIEW' WHEN 'TECH_CONTROL' THEN 'SECURITY_REVIEW' WHEN 'COMMITMENT' THEN 'LEGAL_REVIEW,SECURITY_REVIEW' ELSE 'NONE' END AS risk_flags, CASE said WHEN 'm' THEN 0 WHEN 'a' THEN 2 ELSE 1 END AS missing FROM s
""",
    "answer_findings": _A + """, r AS (SELECT l_orderkey AS k, l_partkey % 6 <> 0 AS ok, l_partkey % 4 = 1 AS num, l_suppkey % 3 = 0 AS aff, date_diff('day', l_shipdate::DATE, DATE '2002-01-01') AS age FROM lineitem)
, g AS (SELECT k, count(*) AS refs, bool_or(ok AND num) AS num, bool_or(ok AND aff) AS aff FROM r GROUP BY k), j AS (SELECT a.*, coalesce(refs, 0) AS refs, coalesce(num, FALSE) AS num, coalesce(aff, FALSE) AS aff FROM a LEFT JOIN g USING (k))
, f AS (SELECT k, 'error' AS level, 'VQ001_MISSING_CITATION' AS code FROM j WHERE factual AND s IN ('ANSWERED', 'PARTIAL') AND refs = 0
  UNION ALL SELECT k, 'error', 'VQ008_ANSWER_STATUS_INVALID_FOR_CONTENT' FROM j WHERE s = 'ANSWERED' AND missing UNION ALL SELECT k, 'error', 'VQ008_ANSWER_STATUS_INVALID_FOR_CONTENT' FROM j WHERE s = 'INSUFFICIENT_EVIDENCE' AND yes
  UNION ALL SELECT k, 'error', 'VQ010_CLAIM_TYPE_POLICY_VIOLATION' FROM j WHERE kind = 'COMMITMENT' UNION ALL SELECT k, 'error', 'VQ004_NUMERIC_CLAIM_NO_NUMERIC_SOURCE' FROM j WHERE kind = 'METRIC' AND NOT num UNION ALL SELECT k, 'error', 'VQ009_YES_WITHOUT_SUPPORT' FROM j WHERE yes AND NOT aff
  UNION ALL SELECT k, 'error', 'VQ002_EVIDENCE_REF_NOT_FOUND' FROM r JOIN a USING (k) WHERE NOT ok UNION ALL SELECT k, 'warning', 'VQ006_STALE_EVIDENCE' FROM r JOIN a USING (k) WHERE ok AND kind IN ('PROCESS', 'INCIDENT') AND age > 900)
SELECT k AS answer_id, level, code, count(*) AS n FROM f GROUP BY ALL""",
    "answer_coverage": _A + " SELECT kind AS claim_type, s AS status, count(*) AS answers FROM a GROUP BY ALL",
    "lock_digests": "SELECT doc_id AS pack_id, CASE WHEN doc_id % 13 = 4 THEN 'not locked' WHEN doc_id % 17 = 3 THEN 'gone' ELSE 'changed' END AS problem FROM documents WHERE (doc_id % 13 = 4 AND doc_id % 17 <> 3) OR (doc_id % 13 <> 4 AND (doc_id % 17 = 3 OR doc_id % 11 = 0))",
}
