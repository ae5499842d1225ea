"""Registered queries: reasons of decisions over orders, chains to their roots, artifacts that rest on sound ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ancestry, governance
from .views import receipts, sql, table


def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions: each follows the customer's one before, every thirteenth one that is not there and every tenth of
    a customer's first one the customer's last (a ring); some supersede, some make obligations. All are asked for."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mine = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    last = F.max("o_orderkey").over(Window.partitionBy("o_custkey"))
    before = F.coalesce(F.lag("o_orderkey").over(mine), F.when(c % 10 == 3, last))
    name = lambda n: F.concat(F.lit("d"), n)
    decisions = o.select(k, c, before.alias("before")).select(
        name(k).alias("receipt_id"),
        F.when(k % 13 == 5, name(-k)).otherwise(name("before")).alias("parent_receipt_id"),
        F.when(k % 7 == 2, name(k - 1)).alias("supersedes"),
        F.when(k % 5 == 1, F.array(F.concat(F.lit("o"), k), F.concat(F.lit("o"), k + 1))).alias("obligations_created"),
    )
    owed = o.where(k % 3 == 0).select(F.concat(F.lit("o"), k).alias("obligation_id"), F.when(k % 2 == 0, name(k)).alias("source_receipt_id"), name(k + 3).alias("superseded_receipt_id"))
    return ancestry.explain(decisions, owed, decisions.select("receipt_id"), depth=None)


def verdict_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verdict's chain of receipts in its trace, down to the trace's first: how long it is and where it ends."""
    r = receipts(spark, sf_dir).select(F.col("event_id").alias("node"), "trace_id", "seq", "type")
    linked = r.withColumn("parent", F.lag("node").over(Window.partitionBy("trace_id").orderBy("seq")))
    chain = ancestry.ancestors(linked.select("node", "parent"), linked.where("type = 'guardian_verdict'").select("node"))
    return chain.groupBy(F.col("node").alias("event_id")).agg(F.max("step").alias("steps"), F.max_by("ancestor", "step").alias("root"))


def admissible_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as artifacts: inputs are the customer's order before and one of another customer; some are not active."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    inputs = o.select(k.alias("artifact_id"), before.alias("input_id")).where("input_id is not null").union(o.where(k % 9 == 4).select(k, k - 4))
    return governance.admissible(o.select(k.alias("artifact_id"), (k % 41 != 7).alias("active")), inputs)


QUERIES = {"decision_reasons": decision_reasons, "verdict_roots": verdict_roots, "admissible_artifacts": admissible_artifacts}
ORACLES = {
    "decision_reasons": """
WITH RECURSIVE d0 AS (
  SELECT o_orderkey AS k, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), CASE WHEN o_custkey % 10 = 3 THEN max(o_orderkey) OVER (PARTITION BY o_custkey) END) AS before FROM orders
), d AS MATERIALIZED (
  SELECT k, 'd' || k AS id, CASE WHEN k % 13 = 5 THEN 'd' || (-k) ELSE 'd' || before END AS parent, CASE WHEN k % 7 = 2 THEN 'd' || (k - 1) END AS old FROM d0
), owed AS MATERIALIZED (
  SELECT 'o' || o_orderkey AS ob, CASE WHEN o_orderkey % 2 = 0 THEN 'd' || o_orderkey END AS src, 'd' || (o_orderkey + 3) AS sup FROM orders WHERE o_orderkey % 3 = 0
), up(id, step, target, seen) AS (
  SELECT id, 0, id, [id] FROM d
  UNION ALL
  SELECT up.id, step + 1, d.parent, list_append(seen, d.parent) FROM up JOIN d ON d.id = up.target WHERE d.parent IS NOT NULL AND NOT list_contains(seen, d.parent)
), links AS (
  SELECT id AS receipt_id, 'target' AS relation, 0 AS step, id AS target, TRUE AS found FROM d
  UNION ALL SELECT d.id, 'supersedes', 1, d.old, x.id IS NOT NULL FROM d LEFT JOIN d x ON x.id = d.old WHERE d.old IS NOT NULL
  UNION ALL SELECT up.id, 'parent', step, target, d.id IS NOT NULL FROM up LEFT JOIN d ON d.id = up.target WHERE step > 0
  UNION ALL SELECT up.id, 'cycle', step + 1, d.parent, FALSE FROM up JOIN d ON d.id = up.target WHERE list_contains(seen, d.parent)
  UNION ALL SELECT id, 'obligation', 1, ob, bool_or(found) FROM (
    SELECT d.id, m.ob, owed.ob IS NOT NULL AS found FROM d, LATERAL (SELECT unnest(CASE WHEN k % 5 = 1 THEN ['o' || k, 'o' || (k + 1)] ELSE [] END) AS ob) m LEFT JOIN owed ON owed.ob = m.ob
    UNION SELECT d.id, owed.ob, TRUE FROM owed JOIN d ON d.id = owed.src OR d.id = owed.sup) GROUP BY id, ob
)
SELECT * FROM links
""",
    "verdict_roots": sql("""
SELECT event_id, steps, root FROM (
  SELECT event_id, type, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS steps, first_value(event_id) OVER (PARTITION BY trace_id ORDER BY seq) AS root FROM receipts
) WHERE type = 'guardian_verdict' AND steps > 0
"""),
    "admissible_artifacts": """
WITH RECURSIVE a AS MATERIALIZED (
  SELECT o_orderkey AS k, o_orderkey % 41 <> 7 AS active, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders
), i AS MATERIALIZED (
  SELECT k, before AS input FROM a WHERE before IS NOT NULL UNION SELECT k, k - 4 FROM a WHERE k % 9 = 4
), bad(k) AS (
  SELECT k FROM a WHERE NOT active
  UNION SELECT i.k FROM i LEFT JOIN a ON a.k = i.input WHERE a.k IS NULL
  UNION SELECT i.k FROM bad JOIN i ON i.input = bad.k
)
SELECT k AS artifact_id, k NOT IN (SELECT k FROM bad) AS admissible FROM a
""",
}
