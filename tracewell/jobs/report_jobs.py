"""Registered queries: reports of packs, and what the claim gate lets pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incidents, reports, textgate
from .text_jobs import claim_transitions
from .views import receipts, sql, table

OLD = ("an experimental draft", "it may work locally", "a suggestion", "risk  reduced here", "observed")
NEW = ("Production-ready and reliable", "it will always work", "you should", "SAFE, because", "it led\tto all")
LATER = ("Roadmap: it is SAFE\nexploring all", "a future_goal\r\nhypothesis", "it must", "Draft policy", "goal: proven")
POSTURES = ("CLEAN", "DEBT_OUTSTANDING", "DEBT_OVERDUE", "UNKNOWN", "SUSPENDED")


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with lines that markers bound."""
    c = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    new = F.concat(text, F.lit("\n"), pick(LATER, F.col("turn")), F.lit("\n"), pick(NEW, F.col("conv_id")))
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), F.concat(pick(OLD, F.col("turn")), F.lit(" "), text).alias("before"), new.alias("after"))


def gated_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textgate.claim_transitions(_turns(spark, sf_dir), "turn_id", "before", "after")


def non_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textgate.non_claims(_turns(spark, sf_dir), "turn_id", "before", "after")


def transition_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textgate.transition_ids(claim_transitions(spark, sf_dir), "turn_id")


def overall_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are channels of their order: what was returned, is open, came late, or costs much."""
    item = table(spark, sf_dir, "lineitem")
    worst = lambda test, bad: F.when(F.bool_or(test), bad).otherwise("PASS")
    channels = item.groupBy(F.col("l_orderkey").alias("pack")).agg(
        worst((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 47), "TAMPERED").alias("integrity_verdict"),
        worst((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), "UNTRUSTED").alias("trust_verdict"),
        worst(F.col("l_discount") > 0.09, "DIVERGE").alias("replay_verdict"),
        worst(F.col("l_extendedprice") > 60000, "HONEST_FAIL").alias("claim_verdict"),
    )
    return reports.overall_verdicts(channels).select("pack", "overall_verdict", "channel", "detail")


def residual_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are results of claims about a part; suppliers' rows annotate some of them."""
    item = table(spark, sf_dir, "lineitem")
    cap = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("tier_"), F.col("l_linenumber")))
    results = item.select("l_orderkey", "l_linenumber", F.concat(F.lit("c"), F.col("l_suppkey")).alias("claim_id"), F.nullif(F.col("l_returnflag"), F.lit("A")).alias("flag"), cap.alias("tier_cap"), F.when(F.col("l_quantity") < 25, "warning").when(F.col("l_quantity") > 45, "critical").alias("severity"), F.when(F.col("l_linenumber") != 3, F.col("l_shipdate").cast("date").cast("string")).alias("expected"), F.col("l_linenumber").cast("string").alias("actual"))
    notes = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.concat(F.lit("c"), F.col("s_suppkey")).alias("claim_id"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("accepted by owner")).alias("why_tolerated"), F.col("s_name").alias("owner"), F.lit(None).cast("string").alias("expiry_condition"), F.when(F.col("s_suppkey") % 5 == 0, "ask").alias("next_cheapest_evidence"))
    found = reports.residual_risks(results.withColumn("passed", F.col("flag") != "R"), notes)
    return found.select("l_orderkey", "l_linenumber", "claim_id", "risk_statement", "why_tolerated", "owner", "expiry_condition", "next_cheapest_evidence", "blocking_on_merge")


def posture_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces whose snapshots are a third of their receipts, against what their later receipts say."""
    r = receipts(spark, sf_dir).withColumn("posture", pick(POSTURES, F.col("k")))
    seen = r.where("k % 3 = 0 and user_id % 7 <> 0").select("trace_id", "seq", "posture", F.col("timestamp").alias("evaluated_at"), F.lit("governance_posture_snapshot").alias("type"))
    now = r.where("k % 3 = 1").groupBy("trace_id").agg(F.max_by(F.struct("posture", F.col("timestamp").alias("evaluated_at")), "seq").alias("x")).select("trace_id", "x.*")
    return reports.posture_divergence(now, reports.last_snapshots(seen, "trace_id"), "trace_id")


def incident_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.timelines(incidents.classify(receipts(spark, sf_dir)), "trace_id")
    return found.select("trace_id", "position", "seq", "severity")


QUERIES = {f.__name__: f for f in (gated_transitions, non_claims, transition_ids, overall_verdicts, residual_risks, posture_divergence, incident_timelines)}


def _text(value: str) -> str:
    """A value as SQL text."""
    return "concat(" + ", ".join(f"chr({ord(c)})" if ord(c) < 32 else "''''" if c == "'" else f"'{c}'" for c in value) + ")"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _holds(column: str, terms: tuple[str, ...]) -> str:
    word = "|".join(t for t in terms if " " not in t and "-" not in t)
    tests = [f"contains({column}, '{t}')" for t in terms if " " in t or "-" in t]
    return "(" + " OR ".join(tests + ([f"regexp_matches({column}, '(^|[^a-z0-9])({word})([^a-z0-9]|$)')"] if word else [])) + ")"


def _plain(column: str) -> str:
    return rf"trim(regexp_replace(replace(lower({column}), '_', ' '), '\s+', ' ', 'g'))"


def _claims(new: str) -> str:
    """Turns, their lines, the lines' markers and transitions."""
    marker = " ".join(f"WHEN contains(line, '{m}') THEN '{m}'" for m in textgate.ALLOW_MARKERS)
    hits = ", ".join(f"CASE WHEN {_holds('old', b)} AND {_holds('line', a)} THEN {{'transition': '{name}', 'severity': '{severity}'}} END" for name, b, a, severity in textgate.TRANSITIONS)
    return rf"""
WITH turns AS (
  SELECT concat_ws(':', conv_id, turn) AS turn_id, {_list(OLD)}[CAST(turn % {len(OLD)} + 1 AS INT)] || ' ' || coalesce(text, '') AS before, {new} AS after FROM conversations
), cut AS (SELECT turn_id, {_plain('before')} AS old, string_split_regex(after, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS parts FROM turns
), many AS (SELECT turn_id, old, unnest(parts) AS raw, CAST(generate_subscripts(parts, 1) AS INT) AS n FROM cut
), said AS (SELECT *, CASE {marker} END AS marker FROM (SELECT turn_id, old, n, {_plain('raw')} AS line FROM many) WHERE line <> ''
), found AS (SELECT turn_id, n AS line, unnest(list_filter([{hits}], lambda x: x IS NOT NULL)) AS x FROM said WHERE marker IS NULL)
"""


_NEW = f"coalesce(text, '') || chr(10) || {_list(NEW)}[CAST(conv_id % {len(NEW)} + 1 AS INT)]"
_LATER = f"coalesce(text, '') || chr(10) || {_list(LATER)}[CAST(turn % {len(LATER)} + 1 AS INT)] || chr(10) || {_list(NEW)}[CAST(conv_id % {len(NEW)} + 1 AS INT)]"
_POSTURE = f"{_list(POSTURES)}[CAST(k % {len(POSTURES)} + 1 AS INT)]"

ORACLES = {
    "claim_transitions": _claims(_NEW) + "SELECT turn_id, line, x.transition AS transition, x.severity AS severity FROM found",
    "gated_transitions": _claims(_LATER) + "SELECT turn_id, line, x.transition AS transition, x.severity AS severity FROM found",
    "non_claims": _claims(_LATER) + "SELECT DISTINCT turn_id, n AS line, 'bounded_or_aspirational_marker:' || marker AS reason FROM said WHERE marker IS NOT NULL",
    "transition_ids": _claims(_NEW) + "SELECT turn_id, line, x.transition AS transition, x.severity AS severity, printf('cgt_%03d', row_number() OVER (PARTITION BY turn_id ORDER BY line, x.transition)) AS transition_id FROM found",
    "overall_verdicts": """
WITH c AS (
  SELECT l_orderkey AS pack, bool_or(l_returnflag = 'R' AND l_quantity > 47) AS i, bool_or(l_linestatus = 'O' AND l_quantity > 45) AS t, bool_or(l_discount > 0.09) AS r, bool_or(l_extendedprice > 60000) AS c
  FROM lineitem GROUP BY l_orderkey
)
SELECT pack, CASE WHEN i THEN 'TAMPERED' WHEN t THEN 'UNTRUSTED' WHEN r THEN 'REPLAY_DIVERGED' WHEN c THEN 'HONEST_FAIL' ELSE 'PASS' END AS overall_verdict,
       CASE WHEN i THEN 'integrity' WHEN t THEN 'trust' WHEN r THEN 'replay' WHEN c THEN 'claim' END AS channel,
       CASE WHEN i THEN 'integrity_verdict=TAMPERED' WHEN t THEN 'trust_verdict=UNTRUSTED' WHEN r THEN 'replay_verdict=DIVERGE' WHEN c THEN 'claim_verdict=HONEST_FAIL' ELSE 'all_required_channels_passed' END AS detail
FROM c
""",
    "residual_risks": """
WITH r AS (
  SELECT l_orderkey, l_linenumber, 'c' || l_suppkey AS claim_id, coalesce(nullif(l_returnflag, 'A') <> 'R', FALSE) AS passed,
         CASE WHEN l_linestatus = 'F' THEN 'tier_' || l_linenumber END AS tier_cap,
         CASE WHEN l_quantity < 25 THEN 'warning' ELSE 'critical' END AS severity,
         CASE WHEN l_linenumber <> 3 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) ELSE '?' END AS expected
  FROM lineitem
), k AS (SELECT *, passed AND tier_cap IS NOT NULL AS capped FROM r WHERE (passed AND tier_cap IS NOT NULL) OR (NOT passed AND severity = 'warning')
), n AS (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT l_orderkey, l_linenumber, claim_id,
       CASE WHEN capped THEN 'Claim passed but capped: ' || tier_cap ELSE 'Warning claim failed: expected ' || expected || ', actual ' || l_linenumber END AS risk_statement,
       CASE WHEN s_suppkey % 2 = 0 THEN 'accepted by owner' WHEN capped THEN 'no rationale provided' ELSE 'warning severity ' || chr(8212) || ' not blocking' END AS why_tolerated,
       coalesce(s_name, '') AS owner, '' AS expiry_condition,
       CASE WHEN s_suppkey % 5 = 0 THEN 'ask' WHEN capped THEN 'name a falsifier for this claim' ELSE '' END AS next_cheapest_evidence, FALSE AS blocking_on_merge
FROM k LEFT JOIN n ON claim_id = 'c' || s_suppkey
""",
    "posture_divergence": sql(f""", r AS (SELECT *, {_POSTURE} AS posture FROM receipts
), p AS (SELECT trace_id, arg_max(posture, seq) AS production, arg_max(timestamp, seq) AS seen_at FROM r WHERE k % 3 = 0 AND user_id % 7 <> 0 GROUP BY trace_id
), c AS (SELECT trace_id, arg_max(posture, seq) AS current FROM r WHERE k % 3 = 1 GROUP BY trace_id)
SELECT c.trace_id, coalesce(production, 'UNAVAILABLE') AS production_posture, current AS current_posture,
       CASE WHEN production IS NULL THEN current <> 'CLEAN' WHEN current = 'UNKNOWN' THEN TRUE ELSE production <> current END AS diverged,
       CASE WHEN production IS NULL THEN 'PRODUCTION_UNAVAILABLE' WHEN current = 'UNKNOWN' THEN 'STORE_UNAVAILABLE' WHEN production = current THEN 'NONE'
            WHEN current = 'CLEAN' AND starts_with(production, 'DEBT_') THEN 'DEBT_RESOLVED' WHEN production = 'CLEAN' AND starts_with(current, 'DEBT_') THEN 'DEBT_ACCRUED'
            WHEN production = 'DEBT_OUTSTANDING' AND current = 'DEBT_OVERDUE' THEN 'DEBT_WORSENED' WHEN production = 'DEBT_OVERDUE' AND current = 'DEBT_OUTSTANDING' THEN 'DEBT_IMPROVED'
            ELSE 'STATE_CHANGED' END AS divergence_type, coalesce(seen_at, 'N/A') AS production_evaluated_at
FROM c LEFT JOIN p ON c.trace_id = p.trace_id
"""),
    "incident_timelines": sql("""
SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY coalesce(timestamp, ''), seq) AS INT) AS position, seq,
       CASE WHEN (type = 'model_call' AND coalesce(error, '') <> '') OR (type = 'guardian_verdict' AND verdict = 'deny') OR (type = 'mcp_tool_call' AND (policy_verdict = 'deny' OR outcome = 'denied')) THEN 'critical' ELSE 'normal' END AS severity
FROM receipts
"""),
}
