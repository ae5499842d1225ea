"""Registered queries: compliance, trust, anchors, replay judgments, checkpoints, passports' events and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assurance
from . import decision_jobs
from .report_jobs import pick
from .views import receipts, sql, table


def compliance_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces as packs; some receipts lack ids or providers, some traces lack receipts."""
    rows = receipts(spark, sf_dir).where("user_id % 6 <> 5").withColumn("receipt_id", F.when((F.col("k") != 9) | (F.col("user_id") % 2 == 0), F.col("receipt_id"))).withColumn("provider", F.when((F.col("k") != 11) | (F.col("user_id") % 3 > 0), F.col("provider")))
    n = F.col("user_id")
    packs = table(spark, sf_dir, "events").select("user_id").distinct().select(F.concat(F.lit("t_"), n).alias("trace_id"), (n % 4 != 1).alias("integrity_pass"), F.when(n % 3 != 0, n % 3 == 1).alias("claims_present"), F.when(n % 5 == 0, "").when(n % 5 < 4, F.concat(F.lit("s"), n % 9)).alias("signer_id"))
    return assurance.compliance(packs, rows, "trace_id").drop("evidence")


def compliance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assurance.compliance_summary(compliance_controls(spark, sf_dir), "trace_id")


def decision_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks for a decision; some have none, some break the rules of decisions."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("d"), k).alias("receipt_id")
    d = o.where(k % 13 != 0).select(name, F.when(k % 3 == 0, "sig").when(k % 29 == 0, " ").alias("signature"), F.when(c % 2 == 0, "key").alias("signer_key"), F.when(c % 5 != 0, c % 5 != 1).alias("signature_ok"), F.when(k % 2 == 0, "h").alias("content_hash"))
    return assurance.classify_trust(o.select(name), d, decision_jobs.decision_rules(spark, sf_dir).where("rule like 'I-%'"))


KINDS = ("guardian_verdict", "settlement_outcome", "model_call", "decision_v1")


def anchor_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions, whose anchors are parts and suppliers; only every second of those exists."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = table(spark, sf_dir, "orders").select(k.alias("receipt_id"), pick(("BINDING", "ADVISORY", "OVERRIDING", "MUTATING", "AUDITING"), c).alias("authority_class"), F.when(k % 4 == 1, "0.1.9").when(k % 4 == 2, "0.10.0").when(k % 4 == 3, "0.2.0").alias("receipt_version"), F.when(c % 6 != 0, F.concat(F.lit("p"), c % 97)).alias("guardian_authorization_receipt_id"), F.when(c % 7 == 0, "").otherwise(F.concat(F.lit("p"), k % 89)).alias("settlement_outcome_id"))
    a = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("receipt_id"), pick(KINDS, F.floor(F.col("p_partkey") / 2)).alias("receipt_type"))
    return assurance.anchor_errors(d, a)


def replay_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their replays, which differ by rule; items are claim results."""
    i = table(spark, sf_dir, "lineitem")
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    claims = i.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(F.concat(F.lit("c"), "l_linenumber"))).alias("ids"), F.collect_list(F.struct(F.concat(F.lit("c"), "l_linenumber").alias("claim_id"), F.col("l_returnflag").alias("result"), F.col("l_linestatus").alias("severity"))).alias("res"), F.collect_list(F.struct(F.concat(F.lit("c"), "l_linenumber").alias("claim_id"), F.when((F.col("l_partkey") % 31 == 0), "X").otherwise(F.col("l_returnflag")).alias("result"), F.col("l_linestatus").alias("severity"))).alias("again"))
    rows = o.join(claims, "o_orderkey", "left")

    def side(letter: str, replay: bool) -> DataFrame:
        test = lambda n, m: (c % n == m) if replay else F.lit(False)
        root = F.when(~test(17, 3), F.concat(F.lit(letter), k))
        return rows.select(
            F.concat(F.lit(letter), k).alias("pack_id"), (k % (11 if replay else 13) != 5).alias("has_credential"), root.alias("pack_root"), F.when(test(19, 4), "other").otherwise(F.concat(F.lit(letter), k)).alias("evidence_root"),
            F.lit("p").alias("policy_id"), F.when(test(23, 5), "q").otherwise("p").alias("policy_hash"), F.lit("n").alias("namespace"), F.when(test(29, 6), F.array(F.lit("c0"))).otherwise(F.col("ids")).alias("claim_ids"),
            F.when(test(7, 1), "FAIL").otherwise("PASS").alias("integrity_result"), F.when(~test(5, 2), "PASS").alias("overall_result"), F.col("again" if replay else "res").alias("claim_results"),
        )

    pairs = o.select(k.alias("pair_id"), F.concat(F.lit("o"), k).alias("original"), F.concat(F.lit("r"), k).alias("replay"))
    found = assurance.replay_judgments(pairs, side("o", False).union(side("r", True)))
    return found.withColumn("reasons", F.array_join("reasons", ","))


SEND = "outbound.send_email"
STEPS = ("checkpoint.requested", "checkpoint.evaluated", "checkpoint.evaluated", "checkpoint.resolved", "checkpoint.evaluated", "checkpoint.decision_recorded")


def checkpoint_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as entries of their order's checkpoint."""
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("k"), "l_orderkey").alias("checkpoint_id"), pick(STEPS, n - 1).alias("type"), F.when(s % 41 == 0, "other").otherwise(SEND).alias("checkpoint_type"), F.col("l_shipdate").cast("date").cast("string").alias("timestamp"), F.concat(F.lit("e"), F.when(n == 4, s % 3 + 1).otherwise(n)).alias("evaluation_id"), F.when((n == 4) & (s % 2 == 0), F.concat(F.lit("e"), s % 4 + 1)).alias("final_evaluation_id"), F.when(n == 1, F.concat(F.lit("t"), s)).otherwise("").alias("trace_id"), (n * 1000000 + s).alias("seq"))
    return assurance.checkpoint_attempts(e, SEND)


def governance_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as passports, their orders as events."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    e = table(spark, sf_dir, "orders").select(c.alias("passport_id"), F.when(k % 3 == 0, c).when(k % 3 == 1, k % 50).alias("target_id"), F.when(k % 5 != 0, F.concat(F.lit("e"), k % 7)).alias("event_id"), pick(("challenge", "other", "supersession", "challenge", "revocation"), F.floor(k / 4)).alias("event_type"), (k % 2 == 0).alias("signed"), F.when(k % 8 != 0, k % 8 < 6).alias("valid"), k.alias("seq"))
    return assurance.governance_dimensions(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("passport_id")), e)


def config_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What items were priced at against what their order says: fields of two maps."""
    i = table(spark, sf_dir, "lineitem").where("l_quantity < 30")
    names = lambda *n: [F.lit(x) for x in n]
    pair = lambda a, b: [x for p in zip(a, b, strict=True) for x in p]
    one = F.create_map(*pair(names("model", "top_k", "seed"), [F.col("l_returnflag"), F.col("l_linenumber").cast("string"), F.when(F.col("l_suppkey") % 3 > 0, "1")]))
    two = F.create_map(*pair(names("seed", "model", "extra"), [F.when(F.col("l_suppkey") % 2 > 0, "1"), F.col("l_linestatus"), F.lit("x")]))
    rows = i.select("l_orderkey", "l_linenumber", "l_partkey", one.alias("requested_config"), two.alias("executed_config"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(assurance.diverged_fields(), ",").alias("fields"))


QUERIES = {f.__name__: f for f in (compliance_controls, compliance_totals, decision_trust, anchor_errors, replay_judgments, checkpoint_attempts, governance_dimensions, config_divergence)}

_CONTROLS = sql("""
, t AS (
  SELECT trace_id, count(*) AS n, count(*) FILTER (k = 9 AND user_id % 2 = 1) AS bad, count(*) FILTER (type = 'model_call') AS calls, count(*) FILTER (type = 'model_call' AND k = 11 AND user_id % 3 = 0) AS part
  FROM receipts WHERE user_id % 6 <> 5 GROUP BY trace_id
), p AS (SELECT DISTINCT user_id AS u, 't_' || user_id AS trace_id FROM events
), x AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(calls, 0) AS calls, coalesce(part, 0) AS part FROM p LEFT JOIN t ON p.trace_id = t.trace_id
), v AS (
  SELECT trace_id, {'receipts': n > 0, 'integrity': u % 4 <> 1, 'fields': n > 0 AND bad = 0, 'monitoring': calls > 0 AND part = 0, 'claims': u % 3 = 1, 'signer': u % 5 BETWEEN 1 AND 3} AS c FROM x
), w AS (
  SELECT trace_id, unnest([
    ('eu-ai-act', 'EU-12.1', c.receipts), ('eu-ai-act', 'EU-12.2', c.integrity), ('eu-ai-act', 'EU-12.3', c.fields), ('eu-ai-act', 'EU-12.4', c.monitoring), ('eu-ai-act', 'EU-19.1', TRUE), ('eu-ai-act', 'EU-19.2', NULL),
    ('soc2', 'SOC2-CC7.2.1', c.monitoring), ('soc2', 'SOC2-CC7.2.2', c.claims), ('soc2', 'SOC2-CC7.2.3', c.integrity), ('soc2', 'SOC2-CC7.2.4', c.receipts),
    ('iso42001', 'ISO-DOC.1', TRUE), ('iso42001', 'ISO-DOC.2', c.claims), ('iso42001', 'ISO-DOC.3', c.integrity), ('iso42001', 'ISO-DOC.4', c.receipts),
    ('nist-ai-rmf', 'NIST-GOV.1', c.signer), ('nist-ai-rmf', 'NIST-MAP.1', c.monitoring), ('nist-ai-rmf', 'NIST-MEASURE.1', c.monitoring), ('nist-ai-rmf', 'NIST-MANAGE.1', c.claims)]) AS r FROM v
), controls AS (
  SELECT trace_id, r[1] AS framework, r[2] AS control_id, CASE r[2] WHEN 'EU-19.2' THEN 'recommended' ELSE 'required' END AS severity, CASE WHEN r[3] IS NULL THEN 'UNKNOWN' WHEN r[3] THEN 'PASS' ELSE 'FAIL' END AS verdict FROM w
)
""")

ORACLES = {
    "compliance_controls": _CONTROLS + "SELECT * FROM controls",
    "compliance_totals": _CONTROLS + "SELECT trace_id, framework, count(*) AS total, count(*) FILTER (verdict = 'PASS') AS passed, count(*) FILTER (verdict = 'FAIL') AS failed, count(*) FILTER (verdict = 'UNKNOWN') AS unknown FROM controls GROUP BY trace_id, framework",
    "decision_trust": f"""
WITH broken AS (SELECT DISTINCT receipt_id FROM ({decision_jobs.ORACLES["decision_rules"]}) WHERE starts_with(rule, 'I-')
), o AS (SELECT 'd' || o_orderkey AS receipt_id, o_orderkey AS k, o_custkey AS c FROM orders
), x AS (SELECT o.*, b.receipt_id IS NOT NULL AS bad FROM o LEFT JOIN broken b ON o.receipt_id = b.receipt_id
), y AS (SELECT receipt_id, CASE WHEN k % 13 = 0 THEN 1 WHEN k % 3 <> 0 AND k % 29 = 0 THEN 2 WHEN k % 3 = 0 AND (c % 5 = 0 OR c % 2 = 1) THEN 3 WHEN bad THEN 4 WHEN k % 3 = 0 AND c % 5 <> 1 THEN 5 WHEN k % 3 = 0 THEN 6 WHEN k % 2 = 0 THEN 7 ELSE 8 END AS n FROM x)
SELECT receipt_id, ['MISSING', 'INVALID', 'UNVERIFIABLE', 'INVALID', 'VERIFIED', 'INVALID', 'UNSIGNED', 'UNSIGNED'][n] AS state,
       ['No receipt', 'Malformed proof material', 'Signature present, verification key unavailable', 'Schema or invariant validation failed', 'Signature verified successfully', 'Signature mismatch', 'Receipt is structurally sound but unsigned', 'Receipt is unsigned and has no content hash'][n] AS reason
FROM y
""",
    "anchor_errors": """
WITH a AS (SELECT 'p' || p_partkey AS id, ['guardian_verdict', 'settlement_outcome', 'model_call', 'decision_v1'][CAST((p_partkey // 2) % 4 + 1 AS INT)] AS kind FROM part WHERE p_partkey % 2 = 0
), d AS (SELECT o_orderkey AS receipt_id, o_custkey AS c, o_orderkey AS k FROM orders WHERE o_custkey % 5 IN (0, 2, 3) AND o_orderkey % 4 IN (2, 3)
), x AS (
  SELECT receipt_id, 'guardian_authorization_receipt_id' AS field, 'p' || (c % 97) AS anchor_id FROM d WHERE c % 6 <> 0
  UNION ALL SELECT receipt_id, 'settlement_outcome_id', 'p' || (k % 89) FROM d WHERE c % 7 <> 0
)
SELECT receipt_id, field, anchor_id, CASE WHEN kind IS NULL THEN 'ANCHOR_NOT_FOUND' ELSE 'ANCHOR_WRONG_KIND' END AS rule
FROM x LEFT JOIN a ON anchor_id = id
WHERE kind IS NULL OR kind = 'model_call' OR (kind = 'guardian_verdict' AND field = 'settlement_outcome_id') OR (kind = 'settlement_outcome' AND field <> 'settlement_outcome_id')
""",
    "replay_judgments": """
WITH l AS (
  SELECT l_orderkey, list_sort(list_distinct(list('c' || l_linenumber))) AS ids, list_sort(list('c' || l_linenumber || l_returnflag || l_linestatus)) AS res,
         list_sort(list('c' || l_linenumber || CASE WHEN l_partkey % 31 = 0 THEN 'X' ELSE l_returnflag END || l_linestatus)) AS again
  FROM lineitem GROUP BY l_orderkey
), x AS (SELECT o_orderkey AS k, o_custkey AS c, coalesce(ids, []) AS ids, coalesce(res <> again, FALSE) AS changed, o_orderkey % 13 <> 5 AND o_orderkey % 11 <> 5 AS both_ FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
), y AS (
  SELECT k, both_, list_filter([
    CASE WHEN both_ AND c % 29 = 6 AND ids <> ['c0'] THEN 'claim_binding_mismatch' END, CASE WHEN both_ AND changed THEN 'claim_results_mismatch' END, CASE WHEN both_ AND c % 17 <> 3 AND c % 19 = 4 THEN 'evidence_binding_mismatch' END,
    CASE WHEN both_ AND c % 7 = 1 THEN 'integrity_result_mismatch' END, CASE WHEN NOT both_ THEN 'missing_decision_credential' END, CASE WHEN both_ AND c % 17 = 3 THEN 'missing_pack_root' END,
    CASE WHEN both_ AND c % 5 = 2 THEN 'overall_result_mismatch' END, CASE WHEN both_ AND c % 23 = 5 THEN 'policy_mismatch' END], lambda r: r IS NOT NULL) AS reasons
  FROM x
), z AS (SELECT *, both_ AND NOT list_has_any(reasons, ['claim_binding_mismatch', 'claim_results_mismatch', 'integrity_result_mismatch', 'overall_result_mismatch', 'policy_mismatch']) AS same FROM y)
SELECT k AS pair_id, array_to_string(reasons, ',') AS reasons, same AS logically_equivalent,
       CASE WHEN list_has_any(reasons, ['missing_decision_credential', 'missing_pack_root', 'evidence_binding_mismatch', 'policy_mismatch', 'claim_binding_mismatch']) THEN 'unverifiable' WHEN same THEN 'reproducible' ELSE 'drifted' END AS verdict
FROM z
""",
    "checkpoint_attempts": """
WITH e AS (
  SELECT 'k' || l_orderkey AS id, l_linenumber AS n, l_suppkey AS s, l_suppkey % 41 = 0 AS odd, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, (l_linenumber - 1) % 6 AS step FROM lineitem
), v AS (SELECT id, n, s, day, 'e' || n AS ev FROM e WHERE step IN (1, 2, 4)
), last AS (SELECT id, ev AS last_ev FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY day DESC, n DESC, s DESC) = 1
), named AS (SELECT id, max(CASE WHEN s % 2 = 0 THEN 'e' || (s % 4 + 1) ELSE 'e' || (s % 3 + 1) END) AS ev FROM e WHERE step = 3 GROUP BY id
), g AS (SELECT id, count(*) FILTER (step = 0) AS q, count(*) FILTER (step IN (1, 2, 4)) AS c, count(*) FILTER (step = 3) AS r, bool_or(odd) AS odd, max(CASE WHEN n = 1 THEN 't' || s END) AS trace_id FROM e GROUP BY id
), x AS (
  SELECT g.*, named.ev AS named_ev, last_ev, CASE WHEN q <> 1 THEN 'not exactly one request' WHEN c = 0 THEN 'no evaluation' WHEN r > 1 THEN 'more than one resolution' WHEN odd THEN 'unsupported or mixed types'
    WHEN r = 1 AND NOT EXISTS (SELECT 1 FROM v WHERE v.id = g.id AND v.ev = named.ev) THEN 'unknown evaluation' END AS problem
  FROM g LEFT JOIN named ON g.id = named.id LEFT JOIN last ON g.id = last.id
)
SELECT id AS checkpoint_id, problem, CASE WHEN problem IS NULL THEN CASE WHEN r = 1 THEN named_ev ELSE last_ev END END AS evaluation_id, trace_id FROM x
""",
    "governance_dimensions": """
WITH e AS (
  SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN 'e' || (o_orderkey % 7) END AS id, ['challenge', 'other', 'supersession', 'challenge', 'revocation'][CAST((o_orderkey // 4) % 5 + 1 AS INT)] AS type,
         o_orderkey % 2 = 0 AS signed, o_orderkey % 8 BETWEEN 1 AND 5 AS valid
  FROM orders WHERE o_orderkey % 3 <> 1 OR o_orderkey % 50 = o_custkey
), f AS (SELECT *, signed AND id IS NOT NULL AS s FROM e QUALIFY id IS NULL OR row_number() OVER (PARTITION BY c, id ORDER BY k) = 1
), g AS (SELECT c, count(*) FILTER (s) AS t, count(*) FILTER (s AND valid) AS v, max(CASE type WHEN 'revocation' THEN 3 WHEN 'supersession' THEN 2 WHEN 'challenge' THEN 1 ELSE 0 END) FILTER (NOT s OR valid) AS top FROM f GROUP BY c)
SELECT c_custkey AS passport_id, ['none', 'challenged', 'superseded', 'revoked'][coalesce(top, 0) + 1] AS governance_status, CASE WHEN coalesce(t, 0) = 0 THEN 'no_events' WHEN t = v THEN 'all_valid' ELSE 'some_invalid' END AS event_integrity,
       coalesce(t, 0) AS signed_total, coalesce(v, 0) AS signed_valid
FROM customer LEFT JOIN g ON c_custkey = c
""",
    "config_divergence": """
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN l_returnflag <> l_linestatus THEN 'model' END, CASE WHEN (l_suppkey % 3 > 0) <> (l_suppkey % 2 > 0) THEN 'seed' END) AS fields FROM lineitem WHERE l_quantity < 30
""",
}
