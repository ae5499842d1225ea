"""Registered queries: decisions, obligations, freshness, episodes and signers, from orders, items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions
from .views import table

NOW = "2000-01-01 00:00:00"
VERDICTS = ["APPROVE", "REFUSE", "DEFER", "ABSTAIN", "ROLLBACK", "CONFLICT"]
DISPOSITIONS = ["execute", "block", "escalate", "defer_with_obligation", "no_action", "compensate", "escalate"]
TYPES = ["model_call", "mcp_tool_call", "guardian_verdict", "report"]


def _pick(expr, names: list[str]):
    return F.element_at(F.array(*map(F.lit, names)), (expr % len(names) + 1).cast("int"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey")).withColumn("c", F.col("o_custkey"))


def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("k"), F.col("c")
    d = _orders(spark, sf_dir).select(F.concat(F.lit("d"), k).alias("receipt_id"), _pick(k, VERDICTS).alias("verdict"), _pick(c, DISPOSITIONS).alias("disposition"), _pick(c + k, ["ADVISORY", "BINDING", "OVERRIDING"]).alias("authority_class"), F.when(k % 4 == 0, "x").alias("delegated_from"), F.when(c % 3 == 0, F.concat(F.lit("d"), k - c % 2)).alias("supersedes"), F.when(c % 4 == 1, "why").alias("abstention_reason"), (c % 2).alias("obligations_created"), (k % 5 != 1).alias("evidence_sufficient"), (c % 3).alias("evidence_gaps"), (c % 7 != 2).alias("provenance_complete"), (k % 3).alias("provenance_gaps"), (k % 4).alias("tier_achieved"), (c % 4).alias("tier_minimum"), F.when(k % 2 == 0, "s").alias("signature"), F.when(c % 2 == 0, "p").alias("signer"), _pick(c, ["high", "low"]).alias("confidence"))
    return decisions.decision_rules(d)


def obligation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("k"), F.col("c")
    o = _orders(spark, sf_dir).select(k.alias("obligation_id"), _pick(k, ["open", "discharged", "waived", "escalated", "lost"]).alias("status"), _pick(c, ["HIGH", "MEDIUM", "LOW", "none"]).alias("severity"), F.when(c % 9 != 0, "override_review").alias("obligation_type"), F.when(c % 2 == 0, "r").alias("discharge_receipt_id"), F.when(c % 3 == 0, "w").alias("waiver_reason"), F.when(c % 5 == 0, "e").otherwise("").alias("escalated_to"))
    return decisions.obligation_rules(o)


def pack_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    p = _orders(spark, sf_dir).select(k.alias("pack_id"), F.when(k % 17 != 0, F.col("o_orderdate").cast("timestamp")).alias("ended"), F.when(k % 3 == 0, "abc").when(k % 3 == 1, "def").alias("commit_sha"))
    return decisions.pack_freshness(p, NOW, 24.0 * 365, 24.0 * 30, commit="abc")


def episode_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    wanted = e.select(F.concat(F.lit("e"), "user_id").alias("episode_id"), F.concat(F.lit("o"), "event_id").alias("obligation_id"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(_pick(k, TYPES), _pick(k + F.col("user_id"), TYPES))).alias("expected"))
    seen = e.select(F.concat(F.lit("e"), "user_id").alias("episode_id"), _pick(F.col("user_id") + F.col("event_id") % 3, TYPES).alias("type"))
    return decisions.episode_completeness(wanted, seen).withColumn("completeness", F.round("completeness", 6))


def step_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes, items as steps; an item depends on an earlier one, some on a later one or none that exists."""
    items = table(spark, sf_dir, "lineitem")
    steps = items.select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("step_id"), _pick(F.col("l_partkey"), ["CALL", "EMIT_OUTPUT"]).alias("opcode"))
    depends = items.where("l_suppkey % 4 <> 1").select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("step_id"), F.when(F.col("l_suppkey") % 10 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber") - 1).cast("int").alias("on"))
    return decisions.step_graphs(steps, depends)


def signer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("k"), F.col("c")
    a = _orders(spark, sf_dir).select(k.alias("artifact_id"), F.when(k % 4 != 0, F.concat(F.lit("f"), c % 8)).alias("fingerprint"), F.concat(F.lit("s"), c % 9).alias("signer_id"), _pick(k, ["pack", "report"]).alias("artifact_class"), _pick(c, ["release", "audit"]).alias("purpose"))
    registry = spark.createDataFrame([(f"s{i}", f"f{i}", "revoked" if i == 3 else "active") for i in range(6)], "signer_id string, fingerprint string, lifecycle string")
    grants = spark.createDataFrame([("s0", "*", "*"), ("s1", "pack", "release"), ("s2", "*", "audit"), ("s4", "report", "*")], "signer_id string, artifact_class string, purpose string")
    return decisions.authorize(a, registry, grants)


QUERIES = {f.__name__: f for f in (decision_rules, obligation_rules, pack_freshness, episode_completeness, step_graphs, signer_status)}


def _choose(expr: str, names: list[str]) -> str:
    return f"{names!r}[({expr}) % {len(names)} + 1]"


ORACLES = {
    "decision_rules": f"""WITH d AS (SELECT 'd' || k AS receipt_id, {_choose("k", VERDICTS)} AS v, {_choose("c", DISPOSITIONS)} AS s, {_choose("c + k", ["ADVISORY", "BINDING", "OVERRIDING"])} AS a, k, c, CASE WHEN c % 3 = 0 THEN 'd' || (k - c % 2) END AS sup, k % 5 = 1 AS lacks FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders))
, r AS (SELECT receipt_id, unnest([
  CASE WHEN NOT list_contains(CASE v WHEN 'APPROVE' THEN ['execute'] WHEN 'REFUSE' THEN ['block', 'escalate'] WHEN 'DEFER' THEN ['defer_with_obligation', 'escalate'] WHEN 'ABSTAIN' THEN ['escalate', 'no_action'] WHEN 'ROLLBACK' THEN ['compensate', 'execute'] ELSE ['escalate'] END, s) THEN 'I-1 disposition' END,
  CASE WHEN v = 'ABSTAIN' AND c % 4 <> 1 THEN 'I-1 abstention_reason' END, CASE WHEN v = 'ROLLBACK' AND sup IS NULL THEN 'I-1 supersedes' END, CASE WHEN s = 'defer_with_obligation' AND c % 2 = 0 THEN 'I-1 obligations_created' END,
  CASE WHEN a = 'ADVISORY' AND v IN ('ROLLBACK', 'CONFLICT') THEN 'I-2 verdict' END, CASE WHEN a = 'OVERRIDING' AND k % 4 <> 0 THEN 'I-2 delegated_from' END, CASE WHEN lacks AND v = 'APPROVE' THEN 'I-3 approve' END, CASE WHEN lacks AND v = 'REFUSE' AND c % 3 = 0 THEN 'I-3 evidence_gaps' END,
  CASE WHEN v = 'APPROVE' AND k % 4 < c % 4 THEN 'I-4 tier' END, CASE WHEN sup = receipt_id THEN 'I-5 supersedes' END, CASE WHEN c % 7 <> 2 AND k % 3 > 0 THEN 'I-6 gaps' END, CASE WHEN c % 7 = 2 AND k % 3 = 0 THEN 'I-6 no gaps' END, CASE WHEN k % 2 = 0 AND c % 2 = 1 THEN 'I-7 signer' END,
  CASE WHEN c % 2 = 0 AND lacks THEN 'forbidden confidence' END, CASE WHEN v = 'APPROVE' AND s = 'block' THEN 'forbidden approve block' END, CASE WHEN v = 'REFUSE' AND s = 'execute' THEN 'forbidden refuse execute' END, CASE WHEN a = 'ADVISORY' AND v = 'ROLLBACK' THEN 'forbidden advisory rollback' END]) AS rule FROM d)
SELECT * FROM r WHERE rule IS NOT NULL""",
    "obligation_rules": f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, {_choose("o_orderkey", ["open", "discharged", "waived", "escalated", "lost"])} AS s FROM orders)
, r AS (SELECT k AS obligation_id, unnest([CASE WHEN s = 'lost' THEN 'unknown status' END, CASE WHEN c % 4 = 3 THEN 'unknown severity' END, CASE WHEN c % 9 = 0 THEN 'unknown type' END, CASE WHEN s = 'discharged' AND c % 2 = 1 THEN 'no receipt' END, CASE WHEN s = 'waived' AND c % 3 <> 0 THEN 'no reason' END, CASE WHEN s = 'escalated' AND c % 5 <> 0 THEN 'no target' END]) AS error FROM o) SELECT * FROM r WHERE error IS NOT NULL""",
    "pack_freshness": f"""WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 <> 0 THEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(o_orderdate)) / 3600000000 END AS age FROM orders)
, r AS (SELECT k AS pack_id, unnest([CASE WHEN age IS NULL THEN 'E_TIMESTAMP_INVALID' END, CASE WHEN age > 24 * 365 THEN 'E_PACK_STALE' END, CASE WHEN -age > 24 * 30 THEN 'E_TIMESTAMP_INVALID' END, CASE WHEN k % 3 = 2 THEN 'E_CI_BINDING_MISSING' END, CASE WHEN k % 3 = 1 THEN 'E_CI_BINDING_MISMATCH' END]) AS code FROM p) SELECT * FROM r WHERE code IS NOT NULL""",
    "episode_completeness": f"""WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events), w AS (SELECT 'e' || user_id AS episode_id, event_id, CASE WHEN k % 5 = 0 THEN [] ELSE [{_choose("k", TYPES)}, {_choose("k + user_id", TYPES)}] END AS x FROM e)
, s AS (SELECT 'e' || user_id AS episode_id, list(DISTINCT {_choose("user_id + event_id % 3", TYPES)}) AS t FROM e GROUP BY user_id), m AS (SELECT episode_id, len(list_filter(x, lambda y: NOT list_contains(t, y))) = 0 AS met FROM w JOIN s USING (episode_id))
SELECT episode_id, count(*) AS obligations, count_if(NOT met)::BIGINT AS missing, round((count(*) - count_if(NOT met)) / count(*), 6) AS completeness FROM m GROUP BY episode_id""",
    "step_graphs": """WITH RECURSIVE s AS (SELECT l_orderkey AS e, l_linenumber AS n, count(*) AS c, min(CASE l_partkey % 2 WHEN 0 THEN 'CALL' ELSE 'EMIT_OUTPUT' END) AS op FROM lineitem GROUP BY ALL)
, d AS (SELECT DISTINCT l_orderkey AS e, l_linenumber AS n, CASE WHEN l_suppkey % 10 = 0 THEN l_linenumber + 1 ELSE l_linenumber - 1 END AS o FROM lineitem WHERE l_suppkey % 4 <> 1), k AS (SELECT d.* FROM d JOIN s ON s.e = d.e AND s.n = d.o)
, walk(e, start, at_) AS (SELECT e, n, o FROM k UNION SELECT w.e, w.start, k.o FROM walk w JOIN k ON k.e = w.e AND k.n = w.at_)
SELECT DISTINCT e AS episode_id, 'duplicate step' AS finding FROM s WHERE c > 1 UNION SELECT e, 'unknown dependency' FROM d WHERE (e, o) NOT IN (SELECT (e, n) FROM s)
UNION SELECT e, 'no terminal output' FROM s WHERE e NOT IN (SELECT e FROM s WHERE op = 'EMIT_OUTPUT' AND (e, n) NOT IN (SELECT (e, o) FROM k)) UNION SELECT e, 'cycle' FROM walk WHERE start = at_""",
    "signer_status": f"""WITH a AS (SELECT o_orderkey AS artifact_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 8 ELSE o_custkey % 9 END AS n, {_choose("o_orderkey", ["pack", "report"])} AS cl, {_choose("o_custkey", ["release", "audit"])} AS pu FROM orders)
SELECT artifact_id, CASE WHEN n > 5 THEN 'unrecognized' WHEN n = 3 THEN 'revoked' WHEN n = 0 OR (n = 1 AND cl = 'pack' AND pu = 'release') OR (n = 2 AND pu = 'audit') OR (n = 4 AND cl = 'report') THEN 'authorized' ELSE 'recognized' END AS status FROM a""",
}
