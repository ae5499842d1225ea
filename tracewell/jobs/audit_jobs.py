"""Registered queries: integrity, incidents, diffs and claims over receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import claims, diffing, incidents, integrity
from .views import receipts, sql, table

CLAIMS = [
    {"claim_id": "calls", "check": "receipt_type_present", "receipt_type": "model_call", "falsifier": "executed_passed"},
    {"claim_id": "no_verdicts", "check": "no_receipt_type", "receipt_type": "guardian_verdict", "severity": "warning"},
    {"claim_id": "enough", "check": "receipt_count_ge", "min_count": 500, "falsifier": "named"},
    {"claim_id": "allowed", "check": "field_value_matches", "receipt_type": "mcp_tool_call", "field": "policy_verdict", "expected": "allow", "falsifier": "absent"},
]


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with some fields spoilt, by rule."""
    r = receipts(spark, sf_dir)
    r = r.withColumn("timestamp", F.when(F.col("k") == 7, "soon").when(F.col("k") == 8, "").otherwise(F.col("timestamp")))
    return r.withColumn("receipt_id", F.when(F.col("k") != 9, F.col("receipt_id"))).withColumn("type", F.when(F.col("k") == 10, "").otherwise(F.col("type")))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with their parent: the one before in the trace."""
    r = receipts(spark, sf_dir)
    return r.withColumn("parent_receipt_id", F.lag("receipt_id").over(Window.partitionBy("trace_id").orderBy("seq")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs p_0 and p_1, p_2 and p_3, ..."""
    users = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("n")).distinct()
    return users.where("n % 2 = 0").select((F.col("n") / 2).cast("long").alias("pair_id"), F.concat(F.lit("p_"), "n").alias("pack_a"), F.concat(F.lit("p_"), F.col("n") + 1).alias("pack_b"))


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def receipt_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.receipt_errors(_damaged(spark, sf_dir), ["pack_id", "line_no"])


def error_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.families(integrity.receipt_errors(_damaged(spark, sf_dir), ["pack_id"], strict=True), ["pack_id"])


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_ids(receipts(spark, sf_dir))


def timestamps_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.monotonic(receipts(spark, sf_dir).withColumn("line_no", F.col("k") * 1_000_000 + F.col("event_id")), ties=["event_id"])


def trace_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.trace_findings(_damaged(spark, sf_dir).withColumn("seq", F.col("k") * 1_000_000 + F.col("event_id")), ties=["event_id"])


def sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.when((F.col("user_id") % 3 == 0) & (F.col("k") == 5), None).when(F.col("user_id") % 3 == 1, F.col("event_id") - F.when(F.col("k") == 6, 500).otherwise(0)).otherwise(F.col("event_id"))
    return integrity.sequence_check(receipts(spark, sf_dir).withColumn("_store_seq", seq), "trace_id", "_store_seq", "event_id")


def sequence_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.number_rows(receipts(spark, sf_dir).select("trace_id", "event_id"), "trace_id", "event_id")


def foreign_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.foreign_rows(receipts(spark, sf_dir), "pack_id", ["model_call", "mcp_tool_call"])


def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = receipts(spark, sf_dir).select("trace_id", "seq", F.sha2("receipt_id", 256).alias("leaf"))
    return integrity.merkle_roots(leaves, "trace_id", "seq", "leaf")


def head_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct("type", "receipt_id", "seq"))
    return integrity.head_hashes(receipts(spark, sf_dir).withColumn("raw", raw))


def classified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.classify(receipts(spark, sf_dir)).select("pack_id", "seq", "severity", "summary")


def incident_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.summary(incidents.classify(receipts(spark, sf_dir)), ["pack_id"])


def causal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incidents.classify(_linked(spark, sf_dir))
    return incidents.chains(rows, rows.where("severity = 'critical' and type = 'guardian_verdict'").select("trace_id", "receipt_id"), "trace_id", depth=4)


def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incidents.classify(receipts(spark, sf_dir).where("type <> 'model_call' or pack_id <> 'p_0' or model_id <> 'gpt-4'"))
    return incidents.first_divergence(rows, _pairs(spark, sf_dir).select(F.col("pack_a").alias("baseline"), F.col("pack_b").alias("current")))


def diff_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(diffing.models(receipts(spark, sf_dir), _pairs(spark, sf_dir)), "cost_a", "cost_b")


def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(diffing.totals(receipts(spark, sf_dir), _pairs(spark, sf_dir)), "cost_usd_a", "cost_usd_b")


def diff_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(diffing.gates(diffing.totals(receipts(spark, sf_dir), _pairs(spark, sf_dir)), 5.0, 10.0, 140), "actual")


def diff_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.claims(claims.check(receipts(spark, sf_dir), CLAIMS), _pairs(spark, sf_dir))


def diff_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    pairs = users.where("u % 2 = 0").select(F.col("u").alias("pair_id"), F.concat(F.lit("t_"), "u").alias("trace_a"), F.concat(F.lit("t_"), F.col("u") + 1).alias("trace_b"))
    ids = receipts(spark, sf_dir).withColumn("receipt_id", F.concat("type", F.lit("_"), "k"))
    return diffing.traces(ids, pairs)


def claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.check(receipts(spark, sf_dir), CLAIMS)


def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.evidence(receipts(spark, sf_dir), "guardian_verdict")


def claim_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.rollup(claims.check(receipts(spark, sf_dir), CLAIMS))


def proof_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.debt(claims.check(receipts(spark, sf_dir), CLAIMS))


def proof_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.posture(claims.check(receipts(spark, sf_dir), CLAIMS))


QUERIES = {f.__name__: f for f in (receipt_errors, error_families, duplicate_ids, timestamps_monotonic, trace_findings, sequence_check, sequence_backfill, foreign_rows, merkle_roots, head_hashes, classified_events, incident_summary, causal_chains, first_divergence, diff_models, diff_totals, diff_gates, diff_claims, diff_traces, claim_checks, claim_evidence, claim_rollup, proof_debt, proof_posture)}

_DAMAGED = """, dam AS (
  SELECT * REPLACE (CASE WHEN k = 7 THEN 'soon' WHEN k = 8 THEN '' ELSE timestamp END AS timestamp, CASE WHEN k <> 9 THEN receipt_id END AS receipt_id, CASE WHEN k = 10 THEN '' ELSE type END AS type) FROM receipts
), err AS (
  SELECT pack_id, line_no, 'E_SCHEMA_UNKNOWN' AS code, 'receipt_id' AS field FROM dam WHERE receipt_id IS NULL OR receipt_id = ''
  UNION ALL SELECT pack_id, line_no, 'E_SCHEMA_UNKNOWN', 'type' FROM dam WHERE type = ''
  UNION ALL SELECT pack_id, line_no, 'E_SCHEMA_UNKNOWN', 'timestamp' FROM dam WHERE timestamp = ''
  UNION ALL SELECT pack_id, line_no, 'E_TIMESTAMP_INVALID', 'timestamp' FROM dam WHERE timestamp IN ('', 'soon'))
"""

_CRITICAL = """, cls AS (
  SELECT *, CASE WHEN (type = 'model_call' AND error IS NOT NULL) OR (type = 'guardian_verdict' AND verdict = 'deny') OR (type = 'mcp_tool_call' AND (policy_verdict = 'deny' OR outcome = 'denied')) THEN 'critical' ELSE 'normal' END AS severity,
    CASE type WHEN 'model_call' THEN CASE WHEN error IS NOT NULL THEN 'Model call FAILED: ' || model_id || ' -- ' || error ELSE 'Model call: ' || model_id || ' (' || input_tokens || '+' || output_tokens || ' tokens)' END
      WHEN 'guardian_verdict' THEN CASE WHEN verdict = 'deny' THEN 'Guardian: DENY ' ELSE 'Guardian: ALLOW ' END || action
      ELSE CASE WHEN policy_verdict = 'deny' OR outcome = 'denied' THEN 'Tool DENIED: ' ELSE 'Tool call: ' END || tool_name END AS summary FROM receipts)
"""

_PAIRS = """, pairs AS (SELECT n // 2 AS pair_id, 'p_' || n AS pack_a, 'p_' || (n + 1) AS pack_b FROM (SELECT DISTINCT user_id % 20 AS n FROM events) WHERE n % 2 = 0)
"""

_TOTALS = (
    _PAIRS
    + """, tot AS (SELECT r.pack_id, coalesce(c.model_calls, 0) AS model_calls, coalesce(total_tokens, 0) AS total_tokens, coalesce(cost_usd, 0) AS cost_usd, coalesce(errors, 0) AS errors FROM (SELECT DISTINCT pack_id FROM receipts) r LEFT JOIN (
  SELECT pack_id, count(*) AS model_calls, sum(all_tokens)::BIGINT AS total_tokens, sum(cost_usd) AS cost_usd, count_if(failed)::BIGINT AS errors FROM calls GROUP BY pack_id) c USING (pack_id)
), rk AS (SELECT pack_id, CAST(latency_ms AS BIGINT) AS ms, row_number() OVER (PARTITION BY pack_id ORDER BY latency_ms) - 1 AS rn, count(*) OVER (PARTITION BY pack_id) AS n FROM calls WHERE latency_ms IS NOT NULL
), lat AS (SELECT pack_id, max(CASE WHEN rn = least(CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT), n - 1) THEN ms END) AS p50, max(CASE WHEN rn = least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1) THEN ms END) AS p95 FROM rk GROUP BY pack_id
), full_t AS (SELECT * FROM tot LEFT JOIN lat USING (pack_id)
), a AS (SELECT pair_id, model_calls AS model_calls_a, total_tokens AS total_tokens_a, cost_usd AS cost_usd_a, errors AS errors_a, p50 AS p50_a, p95 AS p95_a FROM full_t JOIN pairs ON pack_a = pack_id
), b AS (SELECT pair_id, model_calls AS model_calls_b, total_tokens AS total_tokens_b, cost_usd AS cost_usd_b, errors AS errors_b, p50 AS p50_b, p95 AS p95_b FROM full_t JOIN pairs ON pack_b = pack_id
), cmp AS (SELECT * FROM a FULL JOIN b USING (pair_id))
"""
)

_CLAIMS = """, agg AS (
  SELECT pack_id, count(*) AS n, count_if(type = 'model_call')::BIGINT AS calls, count_if(type = 'guardian_verdict')::BIGINT AS verdicts, count_if(type = 'mcp_tool_call')::BIGINT AS tools,
    count_if(type = 'mcp_tool_call' AND policy_verdict <> 'allow')::BIGINT AS bad,
    arg_min(receipt_id, line_no) FILTER (type = 'model_call') AS e0, arg_min(receipt_id, line_no) FILTER (type = 'guardian_verdict') AS e1, arg_min(receipt_id, line_no) FILTER (type = 'mcp_tool_call' AND policy_verdict <> 'allow') AS e3 FROM receipts GROUP BY pack_id
), res AS (
  SELECT pack_id, 'calls' AS claim_id, 'critical' AS severity, 'executed_passed' AS falsifier, calls > 0 AS passed, calls AS actual, e0 AS first_evidence FROM agg
  UNION ALL SELECT pack_id, 'no_verdicts', 'warning', 'not_required', verdicts = 0, verdicts, e1 FROM agg
  UNION ALL SELECT pack_id, 'enough', 'critical', 'named', n >= 500, n, NULL FROM agg
  UNION ALL SELECT pack_id, 'allowed', 'critical', 'absent', tools > 0 AND bad = 0, bad, e3 FROM agg
), roll AS (
  SELECT pack_id, count(*) AS claims, count_if(passed)::BIGINT AS passed, count_if(NOT passed)::BIGINT AS failed, count_if(severity = 'critical' AND falsifier IN ('absent', 'named', 'executed_failed'))::BIGINT AS capped, count_if(NOT passed AND severity = 'critical') = 0 AS overall FROM res GROUP BY pack_id
), debt AS (
  SELECT pack_id, claim_id, 'missing_evidence' AS source, 'severe' AS weight FROM res WHERE severity = 'critical' AND NOT passed
  UNION ALL SELECT pack_id, claim_id, 'missing_falsifier', 'moderate' FROM res WHERE falsifier = 'absent' OR (severity = 'critical' AND falsifier IN ('named', 'executed_failed')))
"""

ORACLES = {
    "receipt_errors": sql(_DAMAGED + "SELECT * FROM err"),
    "error_families": sql(_DAMAGED + """SELECT pack_id, family, count(*) AS errors FROM (
  SELECT pack_id, CASE code WHEN 'E_TIMESTAMP_INVALID' THEN 'stale_evidence' ELSE 'schema_mismatch' END AS family FROM err
  UNION ALL SELECT pack_id, unnest(['schema_mismatch', 'policy_conflict', 'witness_gap']) FROM dam) GROUP BY ALL"""),
    "duplicate_ids": sql("\nSELECT * FROM (SELECT pack_id, line_no, receipt_id, row_number() OVER (PARTITION BY pack_id, receipt_id ORDER BY line_no) AS nth FROM receipts) WHERE nth > 1"),
    "timestamps_monotonic": sql("\nSELECT pack_id, line_no, receipt_id FROM (SELECT pack_id, k * 1000000 + event_id AS line_no, receipt_id, timestamp, lag(timestamp) OVER (PARTITION BY pack_id ORDER BY k * 1000000 + event_id) AS before FROM receipts) WHERE timestamp < before"),
    "trace_findings": sql(_DAMAGED + """, o AS (SELECT trace_id, k * 1000000 + event_id AS seq, type, receipt_id, timestamp, CASE WHEN timestamp NOT IN ('', 'soon') THEN ts END AS at_ FROM dam
), p AS (SELECT *, last_value(at_ IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY trace_id, receipt_id ORDER BY seq) AS nth FROM o)
SELECT trace_id, seq, 'error' AS level, 'missing type' AS finding FROM p WHERE type = ''
UNION ALL SELECT trace_id, seq, 'error', 'duplicate receipt_id' FROM p WHERE receipt_id IS NOT NULL AND nth > 1
UNION ALL SELECT trace_id, seq, 'warning', 'missing receipt_id' FROM p WHERE receipt_id IS NULL
UNION ALL SELECT trace_id, seq, 'error', 'time goes back' FROM p WHERE at_ < before
UNION ALL SELECT trace_id, seq, 'warning', 'invalid time' FROM p WHERE timestamp = 'soon'"""),
    "sequence_check": sql("""
, q AS (SELECT trace_id, event_id, CASE WHEN user_id % 3 = 0 AND k = 5 THEN NULL WHEN user_id % 3 = 1 THEN event_id - CASE WHEN k = 6 THEN 500 ELSE 0 END ELSE event_id END AS s FROM receipts)
, l AS (SELECT *, lag(s) OVER (PARTITION BY trace_id ORDER BY event_id) AS before FROM q)
, one AS (SELECT trace_id, count(*) AS rows, count_if(s IS NULL)::BIGINT AS missing, count_if(s < 0)::BIGINT AS negative, count_if(s <= before)::BIGINT AS falling FROM l GROUP BY trace_id)
, two AS (SELECT trace_id, sum(c - 1)::BIGINT AS duplicates FROM (SELECT trace_id, s, count(*) AS c FROM q WHERE s IS NOT NULL GROUP BY ALL) GROUP BY trace_id)
SELECT trace_id, rows, missing, negative, falling, coalesce(duplicates, 0) AS duplicates, CASE WHEN missing = rows THEN 'legacy' WHEN missing > 0 THEN 'mixed' WHEN negative > 0 OR falling > 0 OR duplicates > 0 THEN 'corrupt' ELSE 'sequenced' END AS state FROM one LEFT JOIN two USING (trace_id)"""),
    "sequence_backfill": sql("\nSELECT trace_id, event_id, row_number() OVER (ORDER BY trace_id, event_id) - 1 AS store_seq FROM receipts"),
    "foreign_rows": sql("""
, f AS (SELECT pack_id, line_no, type, trace_id, first_value(trace_id) OVER (PARTITION BY pack_id ORDER BY line_no) AS run FROM receipts)
SELECT pack_id, line_no, CASE WHEN type NOT IN ('model_call', 'mcp_tool_call') THEN 'type not allowed' ELSE 'other run' END AS problem FROM f WHERE type NOT IN ('model_call', 'mcp_tool_call') OR trace_id <> run"""),
    "head_hashes": sql("\nSELECT pack_id, sha256('{\"receipt_id\":\"' || arg_max(receipt_id, line_no) || '\",\"seq\":' || max(line_no) || ',\"type\":\"' || arg_max(type, line_no) || '\"}') AS head_hash FROM receipts GROUP BY pack_id"),
    "classified_events": sql(_CRITICAL + "SELECT pack_id, seq, severity, summary FROM cls"),
    "incident_summary": sql(_CRITICAL + "SELECT pack_id, count(*) AS events, count_if(severity = 'critical')::BIGINT AS critical, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM cls GROUP BY pack_id"),
    "causal_chains": sql(_CRITICAL + """, lk AS (SELECT trace_id, receipt_id, type, severity, lag(receipt_id) OVER (PARTITION BY trace_id ORDER BY seq) AS parent FROM cls
), e AS (SELECT trace_id, receipt_id, max(parent) AS parent FROM lk GROUP BY ALL
), walk(trace_id, receipt_id, step, ancestor, seen) AS (
  SELECT DISTINCT trace_id, receipt_id, 0, receipt_id, [receipt_id] FROM lk WHERE severity = 'critical' AND type = 'guardian_verdict'
  UNION ALL SELECT w.trace_id, w.receipt_id, w.step + 1, e.parent, list_append(w.seen, e.parent) FROM walk w JOIN e ON e.trace_id = w.trace_id AND e.receipt_id = w.ancestor
  WHERE w.step < 4 AND e.parent <> '' AND NOT list_contains(w.seen, e.parent))
SELECT trace_id, receipt_id, step, ancestor FROM walk"""),
    "first_divergence": sql(_PAIRS + _CRITICAL + """, c2 AS (SELECT * FROM cls WHERE type <> 'model_call' OR pack_id <> 'p_0' OR model_id <> 'gpt-4'
), fresh AS (SELECT pack_a, pack_b, min(c.seq) AS seq, arg_min(c.model_id, c.seq) AS what FROM pairs JOIN c2 c ON c.pack_id = pack_b AND c.type = 'model_call' WHERE NOT EXISTS (SELECT 1 FROM c2 o WHERE o.pack_id = pack_a AND o.type = 'model_call' AND o.model_id = c.model_id) GROUP BY ALL
), bad AS (SELECT pack_a, pack_b, min(c.seq) AS seq, arg_min(c.summary, c.seq) AS what FROM pairs JOIN c2 c ON c.pack_id = pack_b AND c.severity = 'critical' GROUP BY ALL)
SELECT p.pack_a AS baseline, p.pack_b AS current, CASE WHEN f.seq IS NOT NULL THEN 'new_model' ELSE 'critical_event' END AS kind, coalesce(f.seq, b.seq) AS seq, coalesce(f.what, b.what) AS what
FROM pairs p LEFT JOIN fresh f USING (pack_a, pack_b) LEFT JOIN bad b USING (pack_a, pack_b) WHERE f.seq IS NOT NULL OR b.seq IS NOT NULL"""),
    "diff_models": sql(_PAIRS + """, m AS (SELECT pack_id, model_id, count(*) AS calls, sum(cost_usd) AS cost FROM calls GROUP BY ALL
), a AS (SELECT pair_id, model_id, calls, cost FROM m JOIN pairs ON pack_a = pack_id), b AS (SELECT pair_id, model_id, calls, cost FROM m JOIN pairs ON pack_b = pack_id)
SELECT pair_id, model_id, coalesce(a.calls, 0) AS calls_a, round(coalesce(a.cost, 0), 6) AS cost_a, coalesce(b.calls, 0) AS calls_b, round(coalesce(b.cost, 0), 6) AS cost_b, CASE WHEN a.calls IS NULL THEN 'added' WHEN b.calls IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b USING (pair_id, model_id)"""),
    "diff_totals": sql(_TOTALS + "SELECT * REPLACE (round(cost_usd_a, 6) AS cost_usd_a, round(cost_usd_b, 6) AS cost_usd_b) FROM cmp"),
    "diff_gates": sql(_TOTALS + """, g AS (
  SELECT pair_id, 'cost_pct' AS gate, CASE WHEN cost_usd_a = 0 THEN CASE WHEN cost_usd_b > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE (cost_usd_b - cost_usd_a) / cost_usd_a * 100 END AS v, 5.0::DOUBLE AS most FROM cmp
  UNION ALL SELECT pair_id, 'p95_pct', CASE WHEN p95_a = 0 THEN CASE WHEN p95_b > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE (p95_b - p95_a) / p95_a::DOUBLE * 100 END, 10 FROM cmp
  UNION ALL SELECT pair_id, 'errors', errors_b, 140 FROM cmp)
SELECT pair_id, gate, round(CASE WHEN isfinite(v) THEN v END, 6) AS actual, coalesce(v <= most, TRUE) AS passed, v IS NULL AS skipped FROM g"""),
    "diff_claims": sql(_PAIRS + _CLAIMS + """, a AS (SELECT pair_id, claim_id, passed AS passed_a FROM res JOIN pairs ON pack_a = pack_id), b AS (SELECT pair_id, claim_id, passed AS passed_b FROM res JOIN pairs ON pack_b = pack_id)
SELECT pair_id, claim_id, passed_a, passed_b, CASE WHEN passed_a IS NULL THEN 'new' WHEN passed_b IS NULL THEN 'removed' WHEN passed_a AND NOT passed_b THEN 'regressed' WHEN NOT passed_a AND passed_b THEN 'improved' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (pair_id, claim_id)"""),
    "diff_traces": sql("""
, ids AS (SELECT DISTINCT user_id, type || '_' || k AS rid FROM receipts), p AS (SELECT DISTINCT user_id AS pair_id FROM events WHERE user_id % 2 = 0)
, a AS (SELECT pair_id, rid FROM ids JOIN p ON user_id = pair_id), b AS (SELECT pair_id, rid FROM ids JOIN p ON user_id = pair_id + 1)
SELECT pair_id, count_if(x AND y)::BIGINT AS common, count_if(x AND y IS NULL)::BIGINT AS only_a, count_if(y AND x IS NULL)::BIGINT AS only_b FROM (SELECT pair_id, rid, TRUE AS x FROM a) FULL JOIN (SELECT pair_id, rid, TRUE AS y FROM b) USING (pair_id, rid) GROUP BY pair_id"""),
    "claim_checks": sql(_CLAIMS + "SELECT * FROM res"),
    "claim_evidence": sql("\nSELECT pack_id, array_to_string(list(receipt_id ORDER BY line_no)[1:5], ',') AS ids FROM receipts WHERE type = 'guardian_verdict' GROUP BY pack_id"),
    "claim_rollup": sql(_CLAIMS + "SELECT * FROM roll"),
    "proof_debt": sql(_CLAIMS + "SELECT * FROM debt"),
    "proof_posture": sql(_CLAIMS + ", s AS (SELECT pack_id, count(*) AS severe_debt FROM debt WHERE weight = 'severe' GROUP BY pack_id) SELECT roll.*, coalesce(severe_debt, 0) AS severe_debt, CASE WHEN failed > 0 OR severe_debt > 0 THEN 'incomplete' WHEN capped > 0 THEN 'supported_but_capped' ELSE 'verified' END AS disposition FROM roll LEFT JOIN s USING (pack_id)"),
}
