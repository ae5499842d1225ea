"""What reports say of packs: overall verdicts, residual risks, posture divergence, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overall_verdicts(channels: DataFrame) -> DataFrame:
    """The rows with overall_verdict, channel (the one that decides, if any) and detail; the channels are
    integrity_verdict, trust_verdict, replay_verdict and claim_verdict, the first that fails decides."""
    rules = [("integrity", "TAMPERED", "TAMPERED"), ("trust", "UNTRUSTED", "UNTRUSTED"), ("replay", "DIVERGE", "REPLAY_DIVERGED"), ("claim", "HONEST_FAIL", "HONEST_FAIL")]

    def first(value, otherwise: Column) -> Column:
        out = otherwise
        for name, bad, verdict in reversed(rules):
            out = F.when(F.col(f"{name}_verdict") == bad, F.lit(value(name, bad, verdict))).otherwise(out)
        return out

    return channels.withColumns({
        "overall_verdict": first(lambda name, bad, verdict: verdict, F.lit("PASS")),
        "channel": first(lambda name, bad, verdict: name, F.lit(None).cast("string")),
        "detail": first(lambda name, bad, verdict: f"{name}_verdict={bad}", F.lit("all_required_channels_passed")),
    })


def residual_risks(results: DataFrame, annotations: DataFrame) -> DataFrame:
    """Claims that passed but are capped (tier_cap), or failed with warning severity, with what their
    annotation (by claim_id) says of them: a row each. Absent severities count as critical, absent
    results as failed. ``annotations`` has one row a claim."""
    passed, severity = F.coalesce("passed", F.lit(False)), F.coalesce("severity", F.lit("critical"))
    capped = passed & F.coalesce(F.col("tier_cap") != "", F.lit(False))
    warned = ~passed & (severity == "warning")
    shown = lambda c: F.coalesce(F.col(c), F.lit("?"))
    statement = F.when(capped, F.concat(F.lit("Claim passed but capped: "), "tier_cap")).otherwise(F.concat(F.lit("Warning claim failed: expected "), shown("expected"), F.lit(", actual "), shown("actual")))
    why = F.when(capped, "no rationale provided").otherwise("warning severity \u2014 not blocking")
    nxt = F.when(capped, "name a falsifier for this claim").otherwise("")
    rows = results.where(capped | warned).withColumns({"risk_statement": statement, "own_why": why, "own_next": nxt})
    notes = annotations.select("claim_id", "why_tolerated", "owner", "expiry_condition", "next_cheapest_evidence")
    joined = rows.join(notes, "claim_id", "left").withColumns({"why_tolerated": F.coalesce("why_tolerated", "own_why"), "owner": F.coalesce("owner", F.lit("")), "expiry_condition": F.coalesce("expiry_condition", F.lit("")), "next_cheapest_evidence": F.coalesce("next_cheapest_evidence", "own_next")})
    return joined.withColumn("blocking_on_merge", F.lit(False)).drop("own_why", "own_next")


def last_snapshots(receipts: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """(key, posture, evaluated_at) of the last posture snapshot of each key."""
    last = F.max_by(F.struct("posture", "evaluated_at"), order)
    return receipts.where("type = 'governance_posture_snapshot'").groupBy(key).agg(last.alias("x")).select(key, "x.*")


def posture_divergence(current: DataFrame, production: DataFrame, key: str) -> DataFrame:
    """For each row of ``current`` (key, posture, evaluated_at) how its posture differs from the one at
    production (same columns, one row a key): postures, diverged, divergence_type, production_evaluated_at."""
    was = production.select(key, F.col("posture").alias("production"), F.col("evaluated_at").alias("production_at"))
    p, c = F.col("production"), F.col("posture")
    debt = lambda x: x.isin("DEBT_OUTSTANDING", "DEBT_OVERDUE")
    kind = (
        F.when(p.isNull(), "PRODUCTION_UNAVAILABLE").when(c == "UNKNOWN", "STORE_UNAVAILABLE").when(p == c, "NONE")
        .when((c == "CLEAN") & debt(p), "DEBT_RESOLVED").when((p == "CLEAN") & debt(c), "DEBT_ACCRUED")
        .when((p == "DEBT_OUTSTANDING") & (c == "DEBT_OVERDUE"), "DEBT_WORSENED").when((p == "DEBT_OVERDUE") & (c == "DEBT_OUTSTANDING"), "DEBT_IMPROVED")
        .otherwise("STATE_CHANGED")
    )
    diverged = F.when(p.isNull(), c != "CLEAN").when(c == "UNKNOWN", True).otherwise(p != c)
    return current.join(was, key, "left").select(key, F.coalesce(p, F.lit("UNAVAILABLE")).alias("production_posture"), c.alias("current_posture"), diverged.alias("diverged"), kind.alias("divergence_type"), F.coalesce(F.col("production_at"), F.lit("N/A")).alias("production_evaluated_at"))


def timelines(events: DataFrame, key: str, time: str = "timestamp", tie: str = "seq") -> DataFrame:
    """The rows with their position in the key's timeline from 1; rows without a time come first."""
    return events.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce(time, F.lit("")), tie)))
