"""Registered queries: lifecycles, health and succession. Orders are registrations, their items what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health, lifecycle
from .views import table

NOW = "1999-01-01 00:00:00"


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders register commitments; their items observe, fulfil or terminate them."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("c"), "o_orderkey")
    key = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    registered = o.where(key % 17 != 0).select(name.alias("commitment_id"), (key * 10).alias("seq"), F.lit(lifecycle.REGISTERED).alias("type"), none.alias("result_id"), none.alias("terminal_reason"), none.alias("idempotency_key"), F.when(key % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due_at"), F.concat(F.lit("a"), F.col("o_custkey") % 50).alias("actor_id"), F.when(key % 9 == 0, F.concat(F.lit("c"), key - 1)).alias("supersedes_id"), none.alias("replacement_id"), F.when(key % 18 == 0, F.concat(F.lit("c"), key - 2)).alias("root_id"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("f"))
    kind = F.when(F.col("f") == "N", lifecycle.OBSERVED).when(F.col("f") == "R", F.when(F.col("s") % 2 == 0, lifecycle.FULFILLED[0]).otherwise(lifecycle.FULFILLED[1])).when(F.col("l_linenumber") > 4, lifecycle.TERMINATED).otherwise("other")
    ends = F.col("type") == lifecycle.TERMINATED
    follows = items.withColumn("type", kind).select(F.concat(F.lit("c"), "l_orderkey").alias("commitment_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "type", F.concat(F.lit("r"), F.col("p") % 2).alias("result_id"), F.when(ends, "changed").alias("terminal_reason"), F.when(ends & (F.col("s") % 11 != 0), F.concat(F.lit("k"), "s")).alias("idempotency_key"), none.alias("due_at"), none.alias("actor_id"), none.alias("supersedes_id"), F.when(ends & (F.col("p") % 2 == 0), F.concat(F.lit("c"), F.col("l_orderkey") + 1)).alias("replacement_id"), F.when(ends & (F.col("p") % 3 == 0), F.concat(F.lit("c"), F.col("l_orderkey") - 5)).alias("root_id"))
    return registered.union(follows)


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "contradiction.registered").when(F.col("o_orderpriority") == "2-HIGH", "contradiction.resolved").otherwise("other")
    group = F.floor(F.col("o_orderkey") / 3)
    return o.select(F.concat(F.lit("t"), group % 40).alias("trace_id"), F.concat(F.lit("x"), group).alias("contradiction_id"), F.col("o_orderkey").alias("seq"), kind.alias("type"), F.col("o_orderstatus").alias("severity"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))


def _typed(spark: SparkSession, sf_dir: str, kinds: dict[str, str]) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    return _events(spark, sf_dir).select(F.concat(F.lit("t_"), "user_id").alias("trace_id"), F.concat(F.lit("e"), F.col("k") % 5).alias("episode_id"), F.col("event_id").alias("seq"), kind.alias("type"))


EPISODES = {"signup": "episode.opened", "purchase": "episode.closed", "error": "episode.abandoned", "view": "model_call", "click": "mcp_tool_call"}
DECISIONS = {"purchase": "decision_v1", "view": "refusal", "click": "contradiction.resolved", "signup": "episode.opened", "error": "checkpoint.sealed"}


def commitment_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.commitment_ends(commitments(spark, sf_dir)).select("commitment_id", "seq", "type", "valid", "reasons", "anchor_seq")


def commitment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.commitment_summary(commitments(spark, sf_dir), NOW)


def supersession_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.supersession_edges(commitments(spark, sf_dir))


def open_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.open_contradictions(contradictions(spark, sf_dir))


def orphaned_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.orphaned_episodes(_typed(spark, sf_dir, EPISODES))


def obligation_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    status = F.when(F.col("event_type").isin("view", "click"), "open").when(F.col("event_type") == "purchase", "discharged").otherwise("waived")
    due = F.when(F.col("k") % 25 == 3, "later").otherwise(F.date_format(F.col("ts") + F.expr("make_dt_interval(cast(k as int))"), "yyyy-MM-dd"))
    snapshots = e.select(F.concat(F.lit("o"), F.col("event_id") % 700).alias("obligation_id"), F.concat(F.lit("u"), F.col("event_id") % 70).alias("owner"), status.alias("status"), due.alias("due_at"), F.col("ts").alias("saved_at"), F.col("event_id").alias("line_no"))
    return lifecycle.obligation_posture(snapshots, "2024-02-15 00:00:00")


def succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.succession(_typed(spark, sf_dir, DECISIONS))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("user_id", "event_id", (F.col("k") % 4 + 7).cast("double").alias("c10"), "k").select("user_id", "event_id", (F.col("c10") / 10).alias("coherence"), (F.col("k") % 7 / 20.0).alias("tension"), (F.col("k") % 9 - 7).cast("double").alias("tension_derivative"), (F.col("k") % 11 / 5.0).alias("dignity"), (F.col("k") % 13 / 36.0).alias("volatility"))


def grace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.status(_readings(spark, sf_dir)).select("user_id", "event_id", "coherence_ok", "tension_ok", "tension_decreasing", "dignity_ok", "volatility_ok", "passes")


def grace_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir).withColumn("passes", F.col("tension") <= 0.25)
    return health.hysteresis(rows, "user_id", "event_id").select("user_id", "event_id", "passes", "in_grace")


QUERIES = {f.__name__: f for f in (commitment_ends, commitment_summary, supersession_edges, open_contradictions, orphaned_episodes, obligation_posture, succession, grace_status, grace_hysteresis)}

_EVENTS = """WITH ev AS (
  SELECT 'c' || o_orderkey AS commitment_id, o_orderkey * 10 AS seq, 'commitment.registered' AS type, NULL::VARCHAR AS result_id, NULL::VARCHAR AS reason, NULL::VARCHAR AS idem,
    CASE WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS due_at, 'a' || (o_custkey % 50) AS actor_id, CASE WHEN o_orderkey % 9 = 0 THEN 'c' || (o_orderkey - 1) END AS supersedes_id, NULL::VARCHAR AS replacement_id, CASE WHEN o_orderkey % 18 = 0 THEN 'c' || (o_orderkey - 2) END AS root_id
  FROM orders WHERE o_orderkey % 17 <> 0
  UNION ALL
  SELECT 'c' || l_orderkey, l_orderkey * 10 + l_linenumber, t, 'r' || (p % 2), CASE WHEN t = 'commitment.terminated' THEN 'changed' END, CASE WHEN t = 'commitment.terminated' AND s % 11 <> 0 THEN 'k' || s END, NULL, NULL, NULL,
    CASE WHEN t = 'commitment.terminated' AND p % 2 = 0 THEN 'c' || (l_orderkey + 1) END, CASE WHEN t = 'commitment.terminated' AND p % 3 = 0 THEN 'c' || (l_orderkey - 5) END
  FROM (SELECT *, CASE WHEN f = 'N' THEN 'result.observed' WHEN f = 'R' THEN CASE WHEN s % 2 = 0 THEN 'fulfillment.commitment_kept' ELSE 'fulfillment.commitment_broken' END WHEN l_linenumber > 4 THEN 'commitment.terminated' ELSE 'other' END AS t
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS f FROM lineitem GROUP BY ALL))
), reg AS (SELECT commitment_id, min(seq) AS seq, arg_min(due_at, seq) AS due_at, arg_min(actor_id, seq) AS actor_id FROM ev WHERE type = 'commitment.registered' GROUP BY commitment_id
), anc AS (
  SELECT t.commitment_id, t.seq, t.type, t.result_id, t.reason, t.idem, t.replacement_id, t.root_id, reg.seq AS reg_seq,
    (SELECT max(o.seq) FROM ev o WHERE o.type = 'result.observed' AND o.commitment_id = t.commitment_id AND o.result_id = t.result_id AND o.seq < t.seq) AS anchor
  FROM ev t LEFT JOIN reg USING (commitment_id) WHERE t.type LIKE 'fulfillment.%' OR (t.type = 'commitment.terminated' AND t.reason <> '' AND t.idem <> '')
), ready AS (SELECT commitment_id, min(seq) AS end_seq, arg_min(type, seq) AS end_type FROM anc WHERE type = 'commitment.terminated' OR (reg_seq < seq AND anchor IS NOT NULL) GROUP BY commitment_id
), ends AS (
  SELECT anc.*, end_seq, end_type, coalesce(seq = end_seq, NULL) AS valid FROM anc LEFT JOIN ready USING (commitment_id))
"""

_EV = "WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"


def _kinds(kinds: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in kinds.items()) + " END"


ORACLES = {
    "commitment_ends": _EVENTS + """SELECT commitment_id, seq, type, valid,
  CASE WHEN type = 'commitment.terminated' THEN CASE WHEN end_seq < seq THEN 'already ended' ELSE '' END ELSE array_to_string(list_filter([
    CASE WHEN reg_seq IS NULL OR reg_seq >= seq THEN 'no registration' END, CASE WHEN anchor IS NULL THEN 'no anchor' END,
    CASE WHEN end_seq < seq AND end_type LIKE 'fulfillment.%' THEN 'after closure' END, CASE WHEN end_seq < seq AND end_type = 'commitment.terminated' THEN 'after termination' END], lambda x: x IS NOT NULL), '; ') END AS reasons,
  CASE WHEN type LIKE 'fulfillment.%' THEN anchor END AS anchor_seq FROM ends""",
    "commitment_summary": _EVENTS + f""", s AS (SELECT reg.*, e.type AS end_type, e.seq AS end_seq, CASE WHEN e.type IS NULL THEN 'OPEN' WHEN e.type = 'commitment.terminated' THEN 'TERMINATED' ELSE 'CLOSED' END AS status FROM reg LEFT JOIN ends e ON e.commitment_id = reg.commitment_id AND e.valid)
SELECT *, status = 'OPEN' AND due_at <> 'soon' AND coalesce(TRY_CAST(due_at AS TIMESTAMP) < TIMESTAMP '{NOW}', FALSE) AS overdue FROM s""",
    "supersession_edges": _EVENTS + """, d AS (
  SELECT supersedes_id AS predecessor, commitment_id AS successor, seq, type, root_id FROM ev WHERE type = 'commitment.registered' AND supersedes_id <> ''
  UNION ALL SELECT commitment_id, replacement_id, seq, type, root_id FROM ends WHERE type = 'commitment.terminated' AND valid AND replacement_id <> '')
SELECT predecessor, successor, min(seq) AS source_seq, arg_min(type, seq) AS source_type, arg_min(root_id, seq) FILTER (root_id IS NOT NULL) AS root FROM d GROUP BY ALL""",
    "open_contradictions": """WITH c AS (SELECT 't' || ((o_orderkey // 3) % 40) AS trace_id, 'x' || (o_orderkey // 3) AS contradiction_id, o_orderkey AS seq, o_orderpriority AS p, o_orderstatus AS severity FROM orders)
SELECT trace_id, contradiction_id, min(seq) AS seq, arg_min(severity, seq) AS severity FROM c WHERE p = '1-URGENT' AND (trace_id, contradiction_id) NOT IN (SELECT (trace_id, contradiction_id) FROM c WHERE p = '2-HIGH') GROUP BY trace_id, contradiction_id""",
    "orphaned_episodes": _EV + f""", t AS (SELECT 't_' || user_id AS trace_id, 'e' || (k % 5) AS episode_id, event_id AS seq, {_kinds(EPISODES)} AS type FROM e)
, o AS (SELECT *, min(CASE WHEN type = 'episode.opened' THEN seq END) OVER (PARTITION BY trace_id, episode_id) AS opened_seq FROM t)
SELECT trace_id, episode_id, min(opened_seq) AS opened_seq, count(*) AS receipts, arg_max(type, seq) AS last_type, max(seq) AS last_seq FROM o WHERE seq >= opened_seq GROUP BY ALL HAVING NOT bool_or(type IN ('episode.closed', 'episode.abandoned'))""",
    "obligation_posture": _EV + """, s AS (SELECT 'o' || (event_id % 700) AS obligation_id, 'u' || (event_id % 70) AS owner, CASE WHEN event_type IN ('view', 'click') THEN 'open' WHEN event_type = 'purchase' THEN 'discharged' ELSE 'waived' END AS status,
  CASE WHEN k % 25 = 3 THEN NULL ELSE CAST(CAST(ts + to_days(CAST(k AS INTEGER)) AS DATE) AS TIMESTAMP) END AS due, row_number() OVER (PARTITION BY event_id % 700 ORDER BY ts DESC, event_id DESC) AS rn FROM e)
, p AS (SELECT owner, count_if(status = 'open')::BIGINT AS open_count, count_if(status = 'open' AND coalesce(due < TIMESTAMP '2024-02-15 00:00:00', TRUE))::BIGINT AS overdue_count FROM s WHERE rn = 1 GROUP BY owner)
SELECT *, CASE WHEN open_count = 0 THEN 'CLEAN' WHEN overdue_count > 0 THEN 'DEBT_OVERDUE' ELSE 'DEBT_OUTSTANDING' END AS posture FROM p""",
    "succession": _EV + f""", t AS (SELECT 't_' || user_id AS trace_id, event_id AS seq, {_kinds(DECISIONS)} AS type FROM e), l AS (SELECT *, lag(type) OVER (PARTITION BY trace_id ORDER BY seq) AS predecessor FROM t)
SELECT trace_id, seq, predecessor, coalesce(predecessor IN ('refusal', 'contradiction.resolved'), FALSE) AS allowed FROM l WHERE type = 'decision_v1'""",
    "grace_status": _EV + """, r AS (SELECT user_id, event_id, (k % 4 + 7) / 10 >= 0.75 AS coherence_ok, (k % 7) / 20 <= 0.25 AS tension_ok, k % 9 - 7 <= 0 AS tension_decreasing, (k % 11) / 5 >= 0.15 AS dignity_ok, (k % 13) / 36 <= 0.35 AS volatility_ok FROM e)
SELECT *, coherence_ok AND tension_ok AND tension_decreasing AND dignity_ok AND volatility_ok AS passes FROM r""",
    "grace_hysteresis": _EV + """, r AS (SELECT user_id, event_id, (k % 7) / 20 <= 0.25 AS passes FROM e)
, w AS (SELECT *, count(*) OVER o AS n, sum(passes::INT) OVER o AS good FROM r WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
, t AS (SELECT *, CASE WHEN n < 3 THEN NULL WHEN good >= 3 THEN TRUE WHEN n - good >= 3 THEN FALSE END AS turn FROM w)
SELECT user_id, event_id, passes, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS in_grace FROM t""",
}
