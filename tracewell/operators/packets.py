"""Reviewer packets: status of questions, settlement, freshness, the census of decision points and its gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. Of a status: the receipt, emission and authorization expected, whether a human decides, the emission
# seen, and the state of the decision point. Of a status rule: the same first four, which then go before the status's.
STATUSES = {
    "EVIDENCED": ("coverage_evidence", "machine_evidence", "machine_evidence", False, "emitted", "emitted"),
    "PARTIAL": ("coverage_evidence", "coverage_measurement", "coverage_measurement", False, "partial", "uncertain"),
    "FAILED": ("coverage_evidence", "required_proof", "missing_authorization", False, None, "missing"),
    "HUMAN_ATTESTED": ("human_attestation", "human_attestation", "human_attestation", True, "human_attested", "human_attested"),
    "OUT_OF_SCOPE": ("unknown", "none", "scope_exclusion", False, None, "out_of_scope"),
}
OTHER = ("unknown", "unknown", "unknown", None, "uncertain", "uncertain")
RULES = {
    "ALL_EVIDENCE_REQUIRED": ("proof_pack_verification", "machine_evidence", "machine_evidence", False),
    "PARTIAL_IF_RATIO_LT_1": ("coverage_measurement", "coverage_measurement", "coverage_measurement", False),
    "HUMAN_ATTESTED": ("human_attestation", "human_attestation", "human_attestation", True),
    "OUT_OF_SCOPE": ("out_of_scope", "none", "scope_exclusion", False),
}


def _case(column: str, table: dict[str, tuple], k: int, otherwise: Column) -> Column:
    out = otherwise
    for name, values in table.items():
        out = F.when(F.col(column) == name, F.lit(values[k])).otherwise(out)
    return out


def question_status(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """The questions with status, refs and error.

    questions: packet_id, question_id, status_rule, in_scope, numerator, denominator, one row each; an absent
    rule is out of scope, an absent in_scope counts as true. evidence: packet_id, question_id, position, ref, holds;
    absent values do not hold. A question that no rule can decide has an error and no status."""
    seen = evidence.groupBy("packet_id", "question_id").agg(
        F.bool_and(F.coalesce("holds", F.lit(False))).alias("holds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "ref"))), lambda x: x["ref"]), "; ").alias("refs"),
    )
    rule, out = F.coalesce("status_rule", F.lit("OUT_OF_SCOPE")), ~F.coalesce("in_scope", F.lit(True))
    every, ratio = rule == "ALL_EVIDENCE_REQUIRED", rule == "PARTIAL_IF_RATIO_LT_1"
    out = out | (rule == "OUT_OF_SCOPE")
    positive = F.coalesce(F.col("denominator") > 0, F.lit(False))
    status = (
        F.when(out, "OUT_OF_SCOPE")
        .when(every, F.when(F.col("holds"), "EVIDENCED").when(~F.col("holds"), "FAILED"))
        .when(ratio & positive, F.when(F.col("numerator") >= F.col("denominator"), "EVIDENCED").otherwise("PARTIAL"))
        .when(rule == "HUMAN_ATTESTED", "HUMAN_ATTESTED")
    )
    error = F.when(out, None).when(every, F.when(F.col("holds").isNull(), "mapping_missing_evidence")).when(ratio, F.when(~positive, "invalid_ratio_denominator")).when(rule != "HUMAN_ATTESTED", "unsupported_status_rule")
    refs = F.when(~out & every, F.col("refs"))
    return questions.join(seen, ["packet_id", "question_id"], "left").withColumns({"status": status, "error": error, "refs": refs}).drop("holds")


def freshness(packets: DataFrame, now: str) -> DataFrame:
    """The packets (generated_at, evidence_time, expires_at: times; stale_after: P<n>D or null) with freshness_state.
    An absent time of generation or evidence is stale, and so is a period that cannot be read."""
    set_ = F.coalesce(F.col("stale_after") != "", F.lit(False))
    days = F.regexp_extract("stale_after", r"^P(\d+)D$", 1).try_cast("int")
    old = F.col("generated_at") > F.col("evidence_time") + F.make_interval(days=days)
    stale = F.col("generated_at").isNull() | F.col("evidence_time").isNull() | (set_ & F.coalesce(old, F.lit(True))) | F.coalesce(F.lit(now).cast("timestamp") > F.col("expires_at"), F.lit(False))
    return packets.withColumn("freshness_state", F.when(stale, "STALE").otherwise("FRESH"))


def settlement(packets: DataFrame, rows: DataFrame) -> DataFrame:
    """The packets with integrity_state, claim_state, regression_state and settlement_state.

    packets: packet_id, receipt_integrity, error_codes, claim_passed, claim_check, freshness_state, baseline_state.
    rows: packet_id and status of each question; a packet without one is out of scope."""
    has = lambda *s: F.coalesce(F.bool_or(F.col("status").isin(*s)), F.lit(False))
    found = rows.groupBy("packet_id").agg(F.count_if(F.col("status") != "OUT_OF_SCOPE").alias("in_scope"), has("PARTIAL", "HUMAN_ATTESTED").alias("partial"), has("FAILED").alias("failed"))
    spoilt = F.exists(F.coalesce("error_codes", F.array().cast("array<string>")), lambda c: c.startswith("E_PACK") | c.startswith("E_SIG"))
    passes = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("PASS")) == "PASS"
    joined = packets.join(found, "packet_id", "left").fillna(0, ["in_scope"]).fillna(False, ["partial", "failed"])
    joined = joined.withColumns({
        "integrity_state": F.when(passes("receipt_integrity") & ~spoilt, "PASS").otherwise("FAIL"),
        "claim_state": F.when(F.coalesce("claim_passed", passes("claim_check")), "PASS").otherwise("FAIL"),
        "regression_state": F.when((F.col("baseline_state") == "VERIFIED") & (F.col("partial") | F.col("failed")), "REGRESSED").otherwise("NONE"),
    })
    state = (
        F.when(F.col("integrity_state") != "PASS", "TAMPERED").when(F.col("in_scope") == 0, "OUT_OF_SCOPE")
        .when(F.col("regression_state") == "REGRESSED", "EVIDENCE_REGRESSION").when(F.col("claim_state") != "PASS", "INCOMPLETE_EVIDENCE")
        .when(F.col("partial"), "VERIFIED_WITH_GAPS").when(F.col("failed"), "INCOMPLETE_EVIDENCE")
        .when(F.col("freshness_state") == "STALE", "VERIFIED_WITH_GAPS").otherwise("VERIFIED")
    )
    return joined.withColumn("settlement_state", state).drop("in_scope", "partial", "failed")


def decision_points(coverage: DataFrame, questions: DataFrame) -> DataFrame:
    """A decision point for each coverage row (packet_id, prompt, status), with what its question (packet_id, prompt,
    question_id, status_rule; one row a prompt) or else its status lets expect."""
    source = coverage.withColumn("source_status", F.coalesce("status", F.lit("UNCERTAIN"))).drop("status")
    rows = source.join(questions.select("packet_id", "prompt", "question_id", "status_rule"), ["packet_id", "prompt"], "left")
    names = ["expected_receipt_type", "expected_emission", "authorization_source", "human_crossing", "observed_emission", "status"]
    by_status = [_case("source_status", STATUSES, k, F.lit(OTHER[k])) for k in range(6)]
    by_rule = [_case("status_rule", RULES, k, by_status[k]) for k in range(4)]
    return rows.withColumns(dict(zip(names, by_rule + by_status[4:], strict=True))).drop("status_rule")


def census(points: DataFrame) -> DataFrame:
    """Coverage of each packet over its points that are in scope."""
    within, missing = F.col("status") != "out_of_scope", F.col("status") == "missing"
    seen = F.col("status").isin("emitted", "human_attested", "uncertain", "refused")
    rows = points.groupBy("packet_id").agg(F.count_if(within).alias("expected_count"), F.count_if(seen).alias("observed_count"), F.count_if(missing).alias("missing_count"), F.count_if(F.col("status") == "uncertain").alias("unsure"))
    state = F.when(F.col("expected_count") == 0, "uncensusable").when(F.col("missing_count") > 0, "incomplete").when(F.col("unsure") > 0, "degraded").otherwise("complete")
    severity = F.when(F.col("coverage_state") == "degraded", "low").when(F.col("coverage_state") != "incomplete", "none").when(F.col("missing_count") == 1, "medium").otherwise("high")
    ratio = F.when(F.col("expected_count") == 0, 0.0).otherwise(F.col("observed_count") / F.col("expected_count"))
    return rows.withColumn("coverage_ratio", ratio).withColumn("coverage_state", state).withColumn("omission_severity", severity).drop("unsure")


def decision_gaps(points: DataFrame) -> DataFrame:
    """The points that are missing or uncertain, with severity, probable_cause and remediation_hint."""
    gone, source = F.col("status") == "missing", F.col("source_status")
    cause = (
        F.when(gone & (source == "FAILED"), "Declared evidence was not satisfied in the packet.")
        .when(gone, "No emitted evidence was available in the packet surface.")
        .when(source == "PARTIAL", "Coverage was partial in the packet surface.")
        .otherwise("Observed evidence is incomplete or degraded.")
    )
    wanted = F.col("expected_emission")
    hint = F.when(gone, F.format_string("Collect or surface the expected %s.", wanted)).otherwise(F.format_string("Complete or tighten the %s path, then rerun the census.", wanted))
    rows = points.where(F.col("status").isin("missing", "uncertain"))
    return rows.withColumns({"severity": F.when(gone, "high").otherwise("medium"), "probable_cause": cause, "remediation_hint": hint})


def gap_gate(points: DataFrame, max_missing: int = 0, max_uncertain: int = 0, max_total: int = 0) -> DataFrame:
    """(packet_id, missing_count, uncertain_count, gap_count, gate): fail, warn or pass of each packet."""
    rows = points.groupBy("packet_id").agg(F.count_if(F.col("status") == "missing").alias("missing_count"), F.count_if(F.col("status") == "uncertain").alias("uncertain_count"))
    rows = rows.withColumn("gap_count", F.col("missing_count") + F.col("uncertain_count"))
    fail = (F.col("missing_count") > max_missing) | (F.col("gap_count") > max_total)
    return rows.withColumn("gate", F.when(fail, "fail").when(F.col("uncertain_count") > max_uncertain, "warn").otherwise("pass"))


def authorization_paths(points: DataFrame) -> DataFrame:
    """(packet_id, authorization_source, points, human_crossings): points in scope by what authorizes them, and all
    points of that source that a human decides."""
    rows = points.groupBy("packet_id", "authorization_source").agg(F.count_if(F.col("status") != "out_of_scope").alias("points"), F.count_if(F.col("human_crossing")).alias("human_crossings"))
    return rows.where("points > 0 or human_crossings > 0")
