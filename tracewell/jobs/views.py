"""The event stream as receipts, for Spark and as SQL, with the same values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.pricing import DEFAULT, PRICES
from ..sources.receipts import VIEW_MODELS, from_events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def _choose(expr: str, names: list[str]) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _price(k: int) -> str:
    exact = " ".join(f"WHEN model_id = '{r[0]}' THEN {r[k]}" for r in PRICES)
    prefix = " ".join(f"WHEN starts_with(model_id, '{r[0]}') THEN {r[k]}" for r in PRICES)
    return f"CASE {exact} {prefix} ELSE {DEFAULT[k - 1]} END"


#: SQL: common table expressions `receipts` and `calls`; a query continues after them.
RECEIPTS = f"""
base AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CASE event_type WHEN 'click' THEN 'mcp_tool_call' WHEN 'signup' THEN 'guardian_verdict' ELSE 'model_call' END AS type
  FROM events
), receipts AS (
  SELECT *, 'r_' || (event_id - CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS receipt_id, 't_' || user_id AS trace_id, 'p_' || (user_id % 20) AS pack_id,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, event_id AS seq, event_id AS line_no,
         CASE WHEN type = 'model_call' THEN {_choose("k % 6", VIEW_MODELS)} END AS model_id,
         CASE WHEN type = 'model_call' THEN {_choose("k % 3", ["openai", "anthropic", "google"])} END AS provider,
         CASE WHEN type = 'model_call' THEN k * 10 END AS input_tokens,
         CASE WHEN type = 'model_call' THEN k * 3 END AS output_tokens,
         CASE WHEN type = 'model_call' AND k % 4 = 0 THEN 0 WHEN type = 'model_call' THEN k * 13 END AS total_tokens,
         CASE WHEN type = 'model_call' AND k % 11 <> 0 THEN CAST(floor(value * 10) AS DOUBLE) END AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'e' || (k % 3) END AS error,
         CASE WHEN type = 'model_call' AND k % 5 > 0 THEN CASE WHEN k % 2 = 0 THEN 'stop' ELSE 'length' END END AS finish_reason,
         CASE WHEN type = 'model_call' AND k % 7 < 5 THEN 'c_' || (k % 7) END AS callsite_id,
         CASE WHEN type = 'model_call' AND k % 7 < 5 THEN 'app' || (k % 7) || '.py' END AS callsite_file,
         CASE WHEN type = 'mcp_tool_call' THEN 'tool_' || (k % 7) END AS tool_name,
         CASE WHEN type = 'mcp_tool_call' THEN CASE WHEN k % 10 < 2 THEN 'denied' WHEN k % 10 = 2 THEN 'timeout' WHEN k % 10 = 3 THEN 'failed' ELSE 'ok' END END AS outcome,
         CASE WHEN type = 'mcp_tool_call' THEN k % 10 <> 0 END AS allowed,
         CASE WHEN type = 'mcp_tool_call' THEN CASE WHEN k % 10 = 1 THEN 'deny' ELSE 'allow' END END AS policy_verdict,
         CASE WHEN type = 'guardian_verdict' THEN CASE WHEN k % 3 = 0 THEN 'deny' ELSE 'allow' END END AS verdict,
         CASE WHEN type = 'guardian_verdict' THEN 'act_' || (k % 4) END AS action
  FROM base
), calls AS (
  SELECT *, input_tokens AS in_tokens, output_tokens AS out_tokens, coalesce(nullif(total_tokens, 0), input_tokens + output_tokens) AS all_tokens,
         input_tokens / 1000000.0::DOUBLE * ({_price(1)})::DOUBLE + output_tokens / 1000000.0::DOUBLE * ({_price(2)})::DOUBLE AS cost_usd,
         error IS NOT NULL AS failed
  FROM receipts WHERE type = 'model_call'
)
"""


def sql(body: str) -> str:
    """A query over `receipts` and `calls`; it may begin with further expressions."""
    return "WITH RECURSIVE " + RECEIPTS.strip() + body


#: SQL: outcome classes of all receipts.
CLASSED = """, classed AS (
  SELECT *, CASE WHEN NOT coalesce(allowed, TRUE) OR coalesce(policy_verdict = 'deny', FALSE) THEN 'denied' WHEN outcome = 'timeout' THEN 'timeout'
    WHEN outcome IS NOT NULL AND outcome NOT IN ('ok', 'forwarded', 'success', '') THEN 'failed' ELSE 'success' END AS class FROM receipts)
"""
