"""Outcomes of calls in windows, recommendations, and replay of access policies."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Outcomes that count as success; thresholds of the recommendations.
GOOD = ("ok", "forwarded", "success", "")
DENY_CRITICAL, DENY_WARNING, FAIL_CRITICAL, FAIL_WARNING, TIMEOUT_WARNING, DENY_TREND = 0.30, 0.10, 0.20, 0.05, 0.10, 0.05


def outcome_class() -> Column:
    """denied, timeout, failed or success. An ``allowed`` that is absent (null here) allows."""
    denied = ~F.coalesce(F.col("allowed"), F.lit(True)) | F.coalesce(F.col("policy_verdict") == "deny", F.lit(False))
    return F.when(denied, "denied").when(F.col("outcome") == "timeout", "timeout").when(F.col("outcome").isNotNull() & ~F.col("outcome").isin(*GOOD), "failed").otherwise("success")


def signals(receipts: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of outcomes of each group."""
    rows = receipts.withColumn("class", outcome_class())
    counts = [F.count_if(F.col("class") == c).alias(f"{c}_count") for c in ("denied", "timeout", "failed", "success")]
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), *counts, F.min("timestamp").alias("window_start"), F.max("timestamp").alias("window_end"))
    for c, name in (("denied", "deny_rate"), ("failed", "failure_rate"), ("timeout", "timeout_rate")):
        out = out.withColumn(name, F.col(f"{c}_count") / F.col("total"))
    return out


def two_windows(receipts: DataFrame, end: str, days: int) -> DataFrame:
    """Receipts marked ``current`` or ``previous``: two closed windows; a row on their border is in both."""
    stop = F.lit(end).cast("timestamp")
    step = F.make_dt_interval(F.lit(days))
    marks = F.array(F.when(F.col("ts").between(stop - step, stop), "current"), F.when(F.col("ts").between(stop - step - step, stop - step), "previous"))
    return receipts.withColumn("window", F.explode(F.array_compact(marks)))


def recommendations(receipts: DataFrame, end: str, days: int = 7, by: list[str] = ()) -> DataFrame:
    """(by, severity, signal, metric, threshold) from the current window and its trend."""
    by = list(by)
    found = signals(two_windows(receipts, end, days), [*by, "window"])
    rates = ["total", "deny_rate", "failure_rate", "timeout_rate"]
    now = found.where("window = 'current'").select(*by, *rates)
    before = found.where("window = 'previous'").select(*by, *[F.col(c).alias(f"old_{c}") for c in rates])
    both = now.join(before, by, "left") if by else now.join(before, F.lit(True), "left")
    case = lambda when, severity, signal, metric, threshold: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(signal).alias("signal"), metric.cast("double").alias("metric"), F.lit(float(threshold)).alias("threshold")))
    deny, fail, late = F.col("deny_rate"), F.col("failure_rate"), F.col("timeout_rate")
    more_deny, more_fail = deny - F.col("old_deny_rate"), fail - F.col("old_failure_rate")
    rules = F.array_compact(
        F.array(
            F.coalesce(case(deny >= DENY_CRITICAL, "critical", "high_deny_rate", deny, DENY_CRITICAL), case(deny >= DENY_WARNING, "warning", "elevated_deny_rate", deny, DENY_WARNING)),
            F.coalesce(case(fail >= FAIL_CRITICAL, "critical", "high_failure_rate", fail, FAIL_CRITICAL), case(fail >= FAIL_WARNING, "warning", "elevated_failure_rate", fail, FAIL_WARNING)),
            case(late >= TIMEOUT_WARNING, "warning", "elevated_timeout_rate", late, TIMEOUT_WARNING),
            case(more_deny >= DENY_TREND, "warning", "deny_rate_trending_up", more_deny, DENY_TREND),
            case(more_fail >= FAIL_WARNING, "warning", "failure_rate_trending_up", more_fail, FAIL_WARNING),
        )
    )
    healthy = F.array(case(F.lit(True), "info", "healthy", F.col("total"), 0))
    return both.select(*by, F.explode(F.when(F.size(rules) > 0, rules).otherwise(healthy)).alias("r")).select(*by, "r.*")


def top_tools(receipts: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """(by, kind, tool, calls, rank): the n tools with most denials and most failures; of equal ones the one seen first."""
    rows = receipts.withColumn("class", outcome_class()).where("class <> 'success'").withColumn("kind", F.when(F.col("class") == "denied", "denied").otherwise("failing"))
    counted = rows.groupBy(*by, "kind", F.coalesce("tool_name", F.lit("unknown")).alias("tool")).agg(F.count("*").alias("calls"), F.min("seq").alias("seen"))
    order = Window.partitionBy(*by, "kind").orderBy(F.desc("calls"), "seen")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("seen")


def matches_any(name: Column, patterns: list[str]) -> Column:
    """Does a shell pattern of the list match the whole name?"""
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike("^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z") + "$")
    return out


def replay(receipts: DataFrame, policy: dict, by: str = "pack_id", order: str = "line_no") -> DataFrame:
    """Tool calls with the verdict and reason that ``policy`` gives them, in the order of their pack.

    policy: default (allow or deny), allow, deny (pattern lists), max_calls (tool -> n) and
    max_tool_calls (n or None). A tool keeps its first max_calls listed calls, and the session
    the first max_tool_calls of those; denied calls use up nothing. One session is one window
    partition, as the verdicts of a session depend on each other.
    """
    tool = F.coalesce("tool_name", F.lit(""))
    denied = matches_any(tool, policy.get("deny", []))
    unlisted = F.lit(False) if policy.get("default", "allow") == "allow" else ~matches_any(tool, policy.get("allow", []))
    rows = receipts.where("type = 'mcp_tool_call'").withColumn("listed", F.when(denied, "deny_list").when(unlisted, "not_in_allow"))
    limit = F.lit(None).cast("int")
    for name, n in policy.get("max_calls", {}).items():
        limit = F.when(tool == name, n).otherwise(limit)
    rows = rows.withColumn("limit", limit)
    per_tool = Window.partitionBy(by, "tool_name", F.col("listed").isNull()).orderBy(order)
    rows = rows.withColumn("nth", F.row_number().over(per_tool)).withColumn("in_tool", F.col("listed").isNull() & (F.col("limit").isNull() | (F.col("nth") <= F.col("limit"))))
    per_pack = Window.partitionBy(by, "in_tool").orderBy(order)
    most = policy.get("max_tool_calls")
    rows = rows.withColumn("kth", F.row_number().over(per_pack)).withColumn("allow", F.col("in_tool") & (F.lit(most is None) | (F.col("kth") <= (most or 0))))
    before = Window.partitionBy(by, "tool_name").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("allow").cast("long")).over(before), F.lit(0))
    reason = F.when(F.col("allow"), None).when(F.col("listed").isNotNull(), F.col("listed")).when(used >= F.col("limit"), "tool_budget_exceeded").otherwise("session_budget_exceeded")
    out = rows.withColumn("candidate_verdict", F.when(F.col("allow"), "allow").otherwise("deny")).withColumn("candidate_reason", reason)
    was = F.coalesce(F.col("outcome"), F.lit("forwarded")) == "denied"
    change = F.when(~F.col("allow") & ~was, "newly_denied").when(F.col("allow") & was, "newly_allowed")
    return out.withColumn("change", change).drop("listed", "limit", "nth", "in_tool", "kth", "allow")


def impact(replayed: DataFrame, by: list[str]) -> DataFrame:
    """Totals of a replay; would_allow also counts the calls that are denied both times."""
    rows = replayed.groupBy(*by).agg(F.count("*").alias("tool_calls"), F.count_if(F.col("change") == "newly_denied").alias("newly_denied"), F.count_if(F.col("change") == "newly_allowed").alias("newly_allowed"))
    return rows.withColumn("would_allow", F.col("tool_calls") - F.col("newly_denied") + F.col("newly_allowed")).withColumn("risk_delta", F.col("newly_denied") / F.col("tool_calls"))


def gate(impacts: DataFrame, newly_denied: int, risk: float) -> DataFrame:
    """pass or fail of each row of ``impact``."""
    return impacts.withColumn("gate", F.when((F.col("newly_denied") > newly_denied) | (F.col("risk_delta") > risk), "fail").otherwise("pass"))


def changed_tools(replayed: DataFrame, n: int = 10) -> DataFrame:
    """The n tools with most changed verdicts, with the reason of their first change."""
    rows = replayed.where("change is not null").groupBy("tool_name").agg(F.count("*").alias("changes"), F.min_by("candidate_reason", F.struct("pack_id", "line_no")).alias("first_reason"))
    return rows.orderBy(F.desc("changes"), "tool_name").limit(n)
