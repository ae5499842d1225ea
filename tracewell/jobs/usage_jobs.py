"""Registered queries: usage, drift and policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pricing import price
from ..operators import drift, policy, usage
from .views import CLASSED, receipts, sql

END = "2024-01-20 12:00:00"
POLICY = {"default": "deny", "allow": ["tool_[0-4]", "tool_5*"], "deny": ["tool_4"], "max_calls": {"tool_1": 5, "tool_3": 9}, "max_tool_calls": 40}


def _money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(usage.summary(receipts(spark, sf_dir), ["pack_id"]), "cost_usd", "error_rate")


def usage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(usage.breakdown(receipts(spark, sf_dir), ["pack_id"]), "cost_usd")


def finish_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.finish_reasons(receipts(spark, sf_dir), ["pack_id"])


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(usage.latencies(receipts(spark, sf_dir), ["model_id"]), "mean")


def model_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = usage.calls(receipts(spark, sf_dir)).select("model_id").distinct()
    a, b = price(F.col("model_id"))
    return models.select("model_id", a.alias("price_in"), b.alias("price_out"))


def pack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.pack_summary(receipts(spark, sf_dir), ["pack_id"])


def drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.windows(receipts(spark, sf_dir), hours=6)
    return _money(found, "cost_usd").select("window_no", F.unix_seconds("window_start").alias("start_s"), "n_calls", "cost_usd", "errors", "p50", F.array_join("models", ",").alias("models"), "dominant")


def drift_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.flags(drift.windows(receipts(spark, sf_dir), hours=6))
    return found.select("window_no", "flag", "severity")


def drift_flags_by_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.flags(drift.windows(receipts(spark, sf_dir), hours=24, by=["pack_id"]), ["pack_id"]).select("pack_id", "window_no", "flag", "severity")


def window_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.signals(policy.two_windows(receipts(spark, sf_dir), END, 7), ["pack_id", "window"])
    return _money(found, "deny_rate", "failure_rate", "timeout_rate")


def policy_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(policy.recommendations(receipts(spark, sf_dir), END, 7, ["pack_id"]), "metric")


def top_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.top_tools(receipts(spark, sf_dir), ["pack_id"], 5)


def policy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.replay(receipts(spark, sf_dir), POLICY).select("pack_id", "line_no", "tool_name", "outcome", "candidate_verdict", "candidate_reason", "change")


def policy_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.gate(policy.impact(policy.replay(receipts(spark, sf_dir), POLICY), ["pack_id"]), 60, 0.6)
    return _money(found, "risk_delta")


def policy_changed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.changed_tools(policy.replay(receipts(spark, sf_dir), POLICY), 10)


QUERIES = {f.__name__: f for f in (usage_summary, usage_breakdown, finish_reasons, latency_stats, model_prices, pack_summary, drift_windows, drift_flags, drift_flags_by_pack, window_signals, policy_recommendations, top_tools, policy_replay, policy_impact, policy_changed_tools)}

_TOTALS = "count(*) AS calls, sum(in_tokens)::BIGINT AS input_tokens, sum(out_tokens)::BIGINT AS output_tokens, sum(all_tokens)::BIGINT AS total_tokens, round(sum(cost_usd), 6) AS cost_usd, count_if(failed)::BIGINT AS errors"


def _windows(hours: int, by: str) -> str:
    """SQL of the drift windows `w`, with `by` as a leading key or none."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
, placed AS (
  SELECT *, CAST(floor((epoch_us(ts) - epoch_us(date_trunc('hour', min(ts) OVER ({part})))) / ({hours} * 3600 * 1000000.0)) AS BIGINT) AS window_no,
         epoch_us(date_trunc('hour', min(ts) OVER ({part}))) // 1000000 AS origin FROM calls
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {key} window_no ORDER BY latency_ms) - 1 AS rn, count(*) OVER (PARTITION BY {key} window_no) AS n FROM placed WHERE latency_ms IS NOT NULL
), p AS (SELECT {key} window_no, min(latency_ms) AS p50 FROM ranked WHERE rn = least(CAST(floor(n * 0.5) AS BIGINT), n - 1) GROUP BY ALL
), pm AS (SELECT {key} window_no, model_id, count(*) AS c, min(ts) AS seen, min(receipt_id) AS rid FROM placed GROUP BY ALL
), m AS (SELECT {key} window_no, list_sort(list(model_id)) AS models, first(model_id ORDER BY c DESC, seen) AS dominant FROM pm GROUP BY {key} window_no
), t AS (SELECT {key} window_no, any_value(origin) + window_no * {hours} * 3600 AS start_s, count(*) AS n_calls, sum(cost_usd) AS cost_usd, count_if(failed)::BIGINT AS errors FROM placed GROUP BY {key} window_no
), w AS (SELECT t.*, p.p50, m.models, m.dominant FROM t JOIN m USING ({key} window_no) LEFT JOIN p USING ({key} window_no))
"""


def _flags(by: str) -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
, l AS (SELECT *, lag(n_calls) OVER o AS an, lag(cost_usd / n_calls) OVER o AS acpc, lag(errors / n_calls) OVER o AS arate, lag(p50) OVER o AS ap50, lag(models) OVER o AS amodels, lag(dominant) OVER o AS adom FROM w WINDOW o AS ({part} ORDER BY window_no)
), both AS_PLACE (SELECT *, cost_usd / n_calls AS cpc, errors / n_calls AS rate FROM l WHERE an >= 3 AND n_calls >= 3
), f AS (
  SELECT {key} window_no, 'model_swap' AS flag, CASE WHEN len(list_filter(amodels, lambda x: NOT list_contains(models, x))) > 0 AND len(list_filter(models, lambda x: NOT list_contains(amodels, x))) > 0 THEN 'alert' ELSE 'warning' END AS severity FROM pairs WHERE adom <> dominant
  UNION ALL SELECT {key} window_no, 'cost_spike', CASE WHEN (cpc - acpc) / acpc >= 1 THEN 'alert' ELSE 'warning' END FROM pairs WHERE acpc > 0 AND (cpc - acpc) / acpc >= 0.5
  UNION ALL SELECT {key} window_no, 'latency_drift', CASE WHEN (p50 - ap50) / ap50 >= 1 THEN 'alert' ELSE 'warning' END FROM pairs WHERE ap50 > 0 AND (p50 - ap50) / ap50 >= 0.5
  UNION ALL SELECT {key} window_no, 'error_spike', CASE WHEN rate - arate >= 0.15 THEN 'alert' ELSE 'warning' END FROM pairs WHERE rate - arate >= 0.05)
SELECT * FROM f
""".replace("both AS_PLACE", "pairs AS")


_TWO = CLASSED + f""", marked AS (
  SELECT *, 'current' AS win FROM classed WHERE ts BETWEEN TIMESTAMP '{END}' - INTERVAL 7 DAY AND TIMESTAMP '{END}'
  UNION ALL SELECT *, 'previous' FROM classed WHERE ts BETWEEN TIMESTAMP '{END}' - INTERVAL 14 DAY AND TIMESTAMP '{END}' - INTERVAL 7 DAY
), sig AS (
  SELECT pack_id, win, count(*) AS total, count_if(class = 'denied')::BIGINT AS denied_count, count_if(class = 'timeout')::BIGINT AS timeout_count, count_if(class = 'failed')::BIGINT AS failed_count,
         count_if(class = 'success')::BIGINT AS success_count, min(timestamp) AS window_start, max(timestamp) AS window_end FROM marked GROUP BY ALL)
"""

_REPLAY = """, tool AS (
  SELECT *, CASE WHEN tool_name = 'tool_4' THEN 'deny_list' WHEN NOT regexp_full_match(tool_name, 'tool_[0-4]|tool_5.*') THEN 'not_in_allow' END AS listed,
         CASE tool_name WHEN 'tool_1' THEN 5 WHEN 'tool_3' THEN 9 END AS lim FROM receipts WHERE type = 'mcp_tool_call'
), a AS (SELECT *, row_number() OVER (PARTITION BY pack_id, tool_name, listed IS NULL ORDER BY line_no) AS nth FROM tool
), b AS (SELECT *, listed IS NULL AND (lim IS NULL OR nth <= lim) AS in_tool FROM a
), c AS (SELECT *, in_tool AND row_number() OVER (PARTITION BY pack_id, in_tool ORDER BY line_no) <= 40 AS allow FROM b
), d AS (SELECT *, coalesce(sum(allow::INT) OVER (PARTITION BY pack_id, tool_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c
), rep AS (
  SELECT pack_id, line_no, tool_name, outcome, CASE WHEN allow THEN 'allow' ELSE 'deny' END AS candidate_verdict,
         CASE WHEN allow THEN NULL WHEN listed IS NOT NULL THEN listed WHEN used >= lim THEN 'tool_budget_exceeded' ELSE 'session_budget_exceeded' END AS candidate_reason,
         CASE WHEN NOT allow AND outcome <> 'denied' THEN 'newly_denied' WHEN allow AND outcome = 'denied' THEN 'newly_allowed' END AS change FROM d)
"""

ORACLES = {
    "usage_summary": sql("""
, c AS (SELECT pack_id, count(*) AS model_calls, sum(in_tokens)::BIGINT AS input_tokens, sum(out_tokens)::BIGINT AS output_tokens, sum(all_tokens)::BIGINT AS total_tokens, sum(cost_usd) AS cost_usd, count_if(failed)::BIGINT AS errors, min(timestamp) AS time_start, max(timestamp) AS time_end FROM calls GROUP BY pack_id)
, r AS (SELECT pack_id, count(*) AS receipts FROM receipts GROUP BY pack_id)
SELECT r.pack_id, receipts, coalesce(model_calls, 0) AS model_calls, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens, coalesce(total_tokens, 0) AS total_tokens,
       round(coalesce(cost_usd, 0), 6) AS cost_usd, coalesce(errors, 0) AS errors, time_start, time_end, round(CASE WHEN model_calls > 0 THEN errors / model_calls ELSE 0 END, 6) AS error_rate
FROM r LEFT JOIN c USING (pack_id)"""),
    "usage_breakdown": sql(f"""
, d AS (SELECT *, 'model' AS dimension, model_id AS val FROM calls UNION ALL SELECT *, 'provider', coalesce(provider, 'unknown') FROM calls UNION ALL SELECT *, 'callsite', callsite_id FROM calls WHERE callsite_id <> '')
SELECT pack_id, dimension, val AS value, {_TOTALS} FROM d GROUP BY pack_id, dimension, val"""),
    "finish_reasons": sql("\nSELECT pack_id, coalesce(nullif(finish_reason, ''), 'unknown') AS finish_reason, count(*) AS calls FROM calls GROUP BY ALL"),
    "latency_stats": sql("""
, x AS (SELECT model_id, CAST(latency_ms AS BIGINT) AS ms, row_number() OVER (PARTITION BY model_id ORDER BY latency_ms) - 1 AS rn, count(*) OVER (PARTITION BY model_id) AS n FROM calls WHERE latency_ms IS NOT NULL)
SELECT model_id, max(n) AS n, max(CASE WHEN rn = least(CAST(floor(n * 0.5) AS BIGINT), n - 1) THEN ms END) AS p50, max(CASE WHEN rn = least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1) THEN ms END) AS p95,
       max(CASE WHEN rn = least(CAST(floor(n * CAST(0.99 AS DOUBLE)) AS BIGINT), n - 1) THEN ms END) AS p99, round(sum(ms) / count(*), 6) AS mean, min(ms) AS least, max(ms) AS greatest FROM x GROUP BY model_id"""),
    "model_prices": sql("\nSELECT DISTINCT model_id, CASE model_id WHEN 'gpt-4o' THEN 2.5::DOUBLE WHEN 'gpt-4o-mini' THEN 0.15 WHEN 'gpt-4' THEN 30 WHEN 'claude-sonnet-4-20250514' THEN 3 WHEN 'gemini-1.5-pro' THEN 1.25 ELSE 10 END AS price_in, CASE model_id WHEN 'gpt-4o' THEN 10::DOUBLE WHEN 'gpt-4o-mini' THEN 0.6 WHEN 'gpt-4' THEN 60 WHEN 'claude-sonnet-4-20250514' THEN 15 WHEN 'gemini-1.5-pro' THEN 10 ELSE 30 END AS price_out FROM calls"),
    "pack_summary": sql("""
, t AS (SELECT pack_id, type, count(*) AS n FROM receipts GROUP BY ALL)
, r AS (SELECT pack_id, sum(n)::BIGINT AS receipts, array_to_string(list_sort(list(type || '=' || n)), ',') AS types FROM t GROUP BY pack_id)
, m AS (SELECT pack_id, array_to_string(list_sort(list(DISTINCT model_id)), ',') AS models, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, sum(all_tokens)::BIGINT AS total_tokens FROM calls GROUP BY pack_id)
SELECT pack_id, receipts, types, models, providers, total_tokens FROM r LEFT JOIN m USING (pack_id)"""),
    "drift_windows": sql(_windows(6, "") + "SELECT window_no, start_s, n_calls, round(cost_usd, 6) AS cost_usd, errors, p50, array_to_string(models, ',') AS models, dominant FROM w"),
    "drift_flags": sql(_windows(6, "") + _flags("")),
    "drift_flags_by_pack": sql(_windows(24, "pack_id") + _flags("pack_id")),
    "window_signals": sql(_TWO + "SELECT pack_id, win AS \"window\", total, denied_count, timeout_count, failed_count, success_count, window_start, window_end, round(denied_count / total, 6) AS deny_rate, round(failed_count / total, 6) AS failure_rate, round(timeout_count / total, 6) AS timeout_rate FROM sig"),
    "policy_recommendations": sql(_TWO + """, j AS (
  SELECT c.pack_id, c.total, c.denied_count / c.total AS deny, c.failed_count / c.total AS fail, c.timeout_count / c.total AS late, c.denied_count / c.total - p.denied_count / p.total AS more_deny, c.failed_count / c.total - p.failed_count / p.total AS more_fail
  FROM sig c LEFT JOIN sig p ON c.pack_id = p.pack_id AND p.win = 'previous' WHERE c.win = 'current'
), f AS (
  SELECT pack_id, CASE WHEN deny >= 0.3 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN deny >= 0.3 THEN 'high_deny_rate' ELSE 'elevated_deny_rate' END AS signal, deny AS metric, CASE WHEN deny >= 0.3 THEN 0.3 ELSE 0.1 END::DOUBLE AS threshold FROM j WHERE deny >= 0.1
  UNION ALL SELECT pack_id, CASE WHEN fail >= 0.2 THEN 'critical' ELSE 'warning' END, CASE WHEN fail >= 0.2 THEN 'high_failure_rate' ELSE 'elevated_failure_rate' END, fail, CASE WHEN fail >= 0.2 THEN 0.2 ELSE 0.05 END FROM j WHERE fail >= 0.05
  UNION ALL SELECT pack_id, 'warning', 'elevated_timeout_rate', late, 0.1 FROM j WHERE late >= 0.1
  UNION ALL SELECT pack_id, 'warning', 'deny_rate_trending_up', more_deny, 0.05 FROM j WHERE more_deny >= 0.05
  UNION ALL SELECT pack_id, 'warning', 'failure_rate_trending_up', more_fail, 0.05 FROM j WHERE more_fail >= 0.05)
SELECT pack_id, severity, signal, round(metric, 6) AS metric, threshold FROM f
UNION ALL SELECT pack_id, 'info', 'healthy', total, 0 FROM j WHERE pack_id NOT IN (SELECT pack_id FROM f)"""),
    "top_tools": sql(CLASSED + """, x AS (SELECT pack_id, CASE WHEN class = 'denied' THEN 'denied' ELSE 'failing' END AS kind, coalesce(tool_name, 'unknown') AS tool, count(*) AS calls, min(seq) AS seen FROM classed WHERE class <> 'success' GROUP BY ALL)
, y AS (SELECT *, row_number() OVER (PARTITION BY pack_id, kind ORDER BY calls DESC, seen) AS rank FROM x)
SELECT pack_id, kind, tool, calls, rank FROM y WHERE rank <= 5"""),
    "policy_replay": sql(_REPLAY + "SELECT * FROM rep"),
    "policy_impact": sql(_REPLAY + """, i AS (SELECT pack_id, count(*) AS tool_calls, count_if(change = 'newly_denied')::BIGINT AS newly_denied, count_if(change = 'newly_allowed')::BIGINT AS newly_allowed FROM rep GROUP BY pack_id)
SELECT *, tool_calls - newly_denied + newly_allowed AS would_allow, round(newly_denied / tool_calls, 6) AS risk_delta, CASE WHEN newly_denied > 60 OR newly_denied / tool_calls > 0.6 THEN 'fail' ELSE 'pass' END AS gate FROM i"""),
    "policy_changed_tools": sql(_REPLAY + "SELECT tool_name, count(*) AS changes, first(candidate_reason ORDER BY pack_id, line_no) AS first_reason FROM rep WHERE change IS NOT NULL GROUP BY tool_name ORDER BY changes DESC, tool_name LIMIT 10"),
}
