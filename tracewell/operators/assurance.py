"""Assurance over packs and decisions: compliance controls, trust, anchors, replay judgments, checkpoints, passports' events, configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The controls of each framework, with the check that decides them and their severity.
CONTROLS = [
    ("eu-ai-act", "EU-12.1", "receipts_present", "required"),
    ("eu-ai-act", "EU-12.2", "integrity_pass", "required"),
    ("eu-ai-act", "EU-12.3", "receipt_fields", "required"),
    ("eu-ai-act", "EU-12.4", "monitoring_fields", "required"),
    ("eu-ai-act", "EU-19.1", "portable_pack", "required"),
    ("eu-ai-act", "EU-19.2", "retention", "recommended"),
    ("soc2", "SOC2-CC7.2.1", "monitoring_fields", "required"),
    ("soc2", "SOC2-CC7.2.2", "claims_evaluated", "required"),
    ("soc2", "SOC2-CC7.2.3", "integrity_pass", "required"),
    ("soc2", "SOC2-CC7.2.4", "receipts_present", "required"),
    ("iso42001", "ISO-DOC.1", "manifest_present", "required"),
    ("iso42001", "ISO-DOC.2", "claims_evaluated", "required"),
    ("iso42001", "ISO-DOC.3", "integrity_pass", "required"),
    ("iso42001", "ISO-DOC.4", "receipts_present", "required"),
    ("nist-ai-rmf", "NIST-GOV.1", "signer_present", "required"),
    ("nist-ai-rmf", "NIST-MAP.1", "monitoring_fields", "required"),
    ("nist-ai-rmf", "NIST-MEASURE.1", "monitoring_fields", "required"),
    ("nist-ai-rmf", "NIST-MANAGE.1", "claims_evaluated", "required"),
]
# Authority classes that need anchors, and the receipt types that each anchor may be.
GOVERNING = ("BINDING", "MUTATING", "OVERRIDING")
ANCHORS = {
    "guardian_authorization_receipt_id": ("guardian_assessment", "guardian_verdict", "guardian_authorization", "proof_tier", "refusal", "decision_v1"),
    "settlement_outcome_id": ("settlement_outcome", "settlement_transition", "settlement_closure", "decision_v1"),
}
UNVERIFIABLE = ("missing_decision_credential", "missing_pack_root", "evidence_binding_mismatch", "policy_mismatch", "claim_binding_mismatch")


def _set(c: str | Column) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.coalesce(column.cast("string") != "", F.lit(False))


def _named(c: str) -> Column:
    """Given, and not by the word that stands for nothing."""
    return _set(c) & (F.col(c) != "unknown")


def compliance(packs: DataFrame, receipts: DataFrame, by: str, controls: list[tuple] = CONTROLS) -> DataFrame:
    """(by, framework, control_id, severity, verdict, evidence) of each pack and control.

    packs: by, integrity_pass, claims_present, signer_id, one row each; receipts: by, receipt_id, type, timestamp,
    model_id, provider. An absent value of a field counts as a missing field."""
    call, has = F.col("type") == "model_call", lambda *c: F.array_compact(F.array(*c))
    full = lambda *c: F.size(has(*c)) == len(c)
    sums = receipts.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(~full("receipt_id", "type", "timestamp")).alias("bad"), F.count_if(call).alias("calls"), F.count_if(call & full("model_id", "provider")).alias("whole")
    )
    rows = packs.join(sums, by, "left").fillna(0, ["n", "bad", "calls", "whole"])
    verdict = lambda test: F.when(F.coalesce(test, F.lit(False)), "PASS").otherwise("FAIL")
    n, bad, calls, whole = map(F.col, ("n", "bad", "calls", "whole"))
    text = F.format_string
    checks = {
        "receipts_present": (verdict(n > 0), F.when(n > 0, text("%d receipts recorded during execution.", n)).otherwise("No receipts found in evidence pack.")),
        "integrity_pass": (verdict(F.col("integrity_pass")), F.when(F.col("integrity_pass"), "Ed25519 signature valid. SHA-256 file hashes match.").otherwise("Integrity check did not pass.")),
        "receipt_fields": (verdict((n > 0) & (bad == 0)), F.when(n == 0, "No receipts to check.").when(bad == 0, text("All %d receipts have receipt_id, type, and timestamp.", n)).otherwise(text("%d/%d receipts missing required identification fields.", bad, n))),
        "monitoring_fields": (verdict((calls > 0) & (calls == whole)), F.when(calls == 0, "No model_call receipts found for monitoring data.").when(calls == whole, text("All %d model_call receipts include model_id and provider.", calls)).otherwise(text("%d/%d model_call receipts have complete monitoring fields.", whole, calls))),
        "portable_pack": (F.lit("PASS"), F.lit("Evidence pack exists as portable, self-contained files.")),
        "retention": (F.lit("UNKNOWN"), F.lit("Retention is not enforced by packs and must be verified separately.")),
        "claims_evaluated": (verdict(F.col("claims_present")), F.when(F.col("claims_present"), "Governance claims evaluated.").otherwise("No governance claims were defined or evaluated for this pack.")),
        "manifest_present": (verdict(_named(by)), F.when(_named(by), "Pack manifest present with attestation.").otherwise("Pack manifest missing or incomplete.")),
        "signer_present": (verdict(_named("signer_id")), F.when(_named("signer_id"), F.concat(F.lit("Pack signed by '"), "signer_id", F.lit("' with Ed25519 key."))).otherwise("No signer identity found in pack manifest.")),
    }
    done = F.array(*[F.struct(F.lit(f).alias("framework"), F.lit(c).alias("control_id"), F.lit(s).alias("severity"), checks[k][0].alias("verdict"), checks[k][1].alias("evidence")) for f, c, k, s in controls])
    return rows.select(by, F.explode(done).alias("c")).select(by, "c.*")


def compliance_summary(results: DataFrame, by: str) -> DataFrame:
    """(by, framework, total, passed, failed, unknown)."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return results.groupBy(by, "framework").agg(F.count("*").alias("total"), count("PASS").alias("passed"), count("FAIL").alias("failed"), count("UNKNOWN").alias("unknown"))


def classify_trust(requested: DataFrame, decisions: DataFrame, invalid: DataFrame, key: str = "receipt_id") -> DataFrame:
    """(key, state, reason) of each requested decision.

    decisions: key, signature, signer_key, signature_ok (null: no verifier), content_hash; invalid: keys that break a
    rule, once or more. An empty signature is invalid; one that cannot be checked goes before broken rules."""
    rows = requested.select(key).join(decisions.withColumn("here", F.lit(True)), key, "left").join(invalid.select(key).distinct().withColumn("broken", F.lit(True)), key, "left")
    given, blank = F.col("signature").isNotNull(), F.col("signature").rlike(r"(?U)^\s*$")
    unchecked = F.col("signature_ok").isNull() | F.col("signer_key").isNull()
    outcome = (
        F.when(F.col("here").isNull(), F.array(F.lit("MISSING"), F.lit("No receipt")))
        .when(given & blank, F.array(F.lit("INVALID"), F.lit("Malformed proof material")))
        .when(given & unchecked, F.array(F.lit("UNVERIFIABLE"), F.lit("Signature present, verification key unavailable")))
        .when(F.col("broken"), F.array(F.lit("INVALID"), F.lit("Schema or invariant validation failed")))
        .when(given & F.col("signature_ok"), F.array(F.lit("VERIFIED"), F.lit("Signature verified successfully")))
        .when(given, F.array(F.lit("INVALID"), F.lit("Signature mismatch")))
        .when(_set("content_hash"), F.array(F.lit("UNSIGNED"), F.lit("Receipt is structurally sound but unsigned")))
        .otherwise(F.array(F.lit("UNSIGNED"), F.lit("Receipt is unsigned and has no content hash")))
    )
    return rows.select(key, outcome[0].alias("state"), outcome[1].alias("reason"))


def anchor_errors(decisions: DataFrame, artifacts: DataFrame, key: str = "receipt_id") -> DataFrame:
    """(key, field, anchor_id, rule) of declared anchors that resolve to nothing or to a wrong type.

    decisions: key, authority_class, receipt_version and the anchor fields; only governing classes from version 0.2.0
    on are held to them, an absent version counts as 0.1.0. artifacts: receipt_id, receipt_type, one row an id."""
    parts = F.transform(F.split(F.coalesce("receipt_version", F.lit("0.1.0")), r"\."), lambda x: x.try_cast("int"))
    bound = decisions.where(F.col("authority_class").isin(*GOVERNING) & (parts >= F.array(F.lit(0), F.lit(2), F.lit(0))))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("anchor_id"), F.array(*map(F.lit, t)).alias("types")) for f, t in ANCHORS.items()]))
    declared = bound.select(key, fields.alias("a")).select(key, "a.*").where("anchor_id <> ''")
    found = declared.join(artifacts.select(F.col("receipt_id").alias("anchor_id"), F.lit(True).alias("here"), F.coalesce("receipt_type", F.lit("")).alias("kind")), "anchor_id", "left")
    rule = F.when(F.col("here").isNull(), "ANCHOR_NOT_FOUND").when(~F.array_contains("types", F.col("kind")), "ANCHOR_WRONG_KIND")
    return found.withColumn("rule", rule).where("rule is not null").select(key, "field", "anchor_id", "rule")


def replay_judgments(pairs: DataFrame, credentials: DataFrame) -> DataFrame:
    """(pair_id, verdict, reasons, logically_equivalent): does a replay reach what the original run did?

    pairs: pair_id, original, replay (pack ids). credentials: pack_id, has_credential, pack_root, evidence_root,
    policy_id, policy_hash, namespace, claim_ids (array), integrity_result, overall_result, claim_results (array of
    claim_id, result, severity), one row a pack. A pack without a row has no credential."""
    side = lambda name: credentials.select(F.col("pack_id").alias(name), F.struct("*").alias(name[0]))
    rows = pairs.join(side("original"), "original", "left").join(side("replay"), "replay", "left")
    here = lambda s: F.coalesce(F.col(f"{s}.has_credential"), F.lit(False))
    differ = lambda c: ~F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}"))
    ordered = lambda s: F.array_sort(F.coalesce(f"{s}.claim_results", F.array().cast(credentials.schema["claim_results"].dataType)))
    claims = lambda s: F.coalesce(f"{s}.claim_ids", F.array().cast("array<string>"))
    loose = lambda s: _set(f"{s}.pack_root") & ~F.col(f"{s}.evidence_root").eqNullSafe(F.col(f"{s}.pack_root"))
    both = here("o") & here("r")
    bound = differ("namespace") | (claims("o") != claims("r"))
    results = ordered("o") != ordered("r")
    reasons = {
        "claim_binding_mismatch": both & bound,
        "claim_results_mismatch": both & results,
        "evidence_binding_mismatch": both & (loose("o") | loose("r")),
        "integrity_result_mismatch": both & differ("integrity_result"),
        "missing_decision_credential": ~both,
        "missing_pack_root": both & ~(_set("o.pack_root") & _set("r.pack_root")),
        "overall_result_mismatch": both & differ("overall_result"),
        "policy_mismatch": both & differ("policy_hash"),
    }
    same = both & ~bound & ~results & ~differ("policy_id") & ~differ("policy_hash") & ~differ("integrity_result") & ~differ("overall_result")
    rows = rows.withColumn("reasons", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in reasons.items()]))).withColumn("logically_equivalent", same)
    broken = F.arrays_overlap("reasons", F.array(*map(F.lit, UNVERIFIABLE)))
    verdict = F.when(broken, "unverifiable").when(F.col("logically_equivalent"), "reproducible").otherwise("drifted")
    return rows.select("pair_id", verdict.alias("verdict"), "reasons", "logically_equivalent")


def checkpoint_attempts(entries: DataFrame, kind: str, order: str = "seq") -> DataFrame:
    """(checkpoint_id, problem, evaluation_id, trace_id): the evaluation in force of each attempt, or why there is none.

    entries: checkpoint_id, type, checkpoint_type, timestamp, evaluation_id, final_evaluation_id, trace_id and the
    order of entries with one time. A resolution names its evaluation, else the last one by time counts."""
    is_ = lambda t: F.col("type") == f"checkpoint.{t}"
    named = F.coalesce(F.nullif(F.col("final_evaluation_id"), F.lit("")), F.col("evaluation_id"))
    rows = entries.where("checkpoint_id <> ''").groupBy("checkpoint_id").agg(
        F.count_if(is_("requested")).alias("requests"), F.count_if(is_("evaluated")).alias("evaluations"), F.count_if(is_("resolved")).alias("resolutions"),
        F.bool_and(F.col("checkpoint_type").eqNullSafe(F.lit(kind))).alias("alike"), F.max_by(F.when(is_("evaluated"), F.col("evaluation_id")), F.when(is_("evaluated"), F.struct("timestamp", order))).alias("last"),
        F.max(F.when(is_("resolved"), named)).alias("named"), F.max(F.nullif(F.col("trace_id"), F.lit(""))).alias("trace_id"),
    )
    known = entries.where(is_("evaluated")).select("checkpoint_id", F.col("evaluation_id").alias("named"), F.lit(True).alias("known")).distinct()
    rows = rows.join(known, ["checkpoint_id", "named"], "left")
    problem = (
        F.when(F.col("requests") != 1, "not exactly one request").when(F.col("evaluations") == 0, "no evaluation")
        .when(F.col("resolutions") > 1, "more than one resolution").when(~F.col("alike"), "unsupported or mixed types")
        .when((F.col("resolutions") == 1) & F.col("known").isNull(), "unknown evaluation")
    )
    chosen = F.when(problem.isNull(), F.when(F.col("resolutions") == 1, F.col("named")).otherwise(F.col("last")))
    return rows.select("checkpoint_id", problem.alias("problem"), chosen.alias("evaluation_id"), "trace_id")


def governance_dimensions(passports: DataFrame, events: DataFrame, order: str = "seq") -> DataFrame:
    """(passport_id, governance_status, event_integrity, signed_total, signed_valid) of each passport.

    events: passport_id (where the event lies), target_id, event_id, event_type, signed, valid, and their order. Events
    that name another target go; of one event id the first counts; signed events that are not valid count against
    integrity and for nothing else."""
    rows = events.where(~_set("target_id") | (F.col("target_id") == F.col("passport_id")))
    columns = F.struct("event_type", "signed", "valid")
    named = rows.where(_set("event_id")).groupBy("passport_id", "event_id").agg(F.min_by(columns, order).alias("e"), F.lit(True).alias("has_id"))
    other = rows.where(~_set("event_id")).select("passport_id", "event_id", columns.alias("e"), F.lit(False).alias("has_id"))
    one = named.union(other).select("passport_id", "has_id", "e.*")
    signed = F.coalesce("signed", F.lit(False)) & F.col("has_id")
    fine = signed & F.coalesce("valid", F.lit(False))
    any_ = lambda t: F.bool_or((~signed | fine) & F.coalesce(F.col("event_type") == t, F.lit(False)))
    found = one.groupBy("passport_id").agg(F.count_if(signed).alias("signed_total"), F.count_if(fine).alias("signed_valid"), any_("revocation").alias("r"), any_("supersession").alias("s"), any_("challenge").alias("c"))
    out = passports.select("passport_id").join(found, "passport_id", "left").fillna(0, ["signed_total", "signed_valid"])
    status = F.when(F.col("r"), "revoked").when(F.col("s"), "superseded").when(F.col("c"), "challenged").otherwise("none")
    integrity = F.when(F.col("signed_total") == 0, "no_events").when(F.col("signed_total") == F.col("signed_valid"), "all_valid").otherwise("some_invalid")
    return out.select("passport_id", status.alias("governance_status"), integrity.alias("event_integrity"), "signed_total", "signed_valid")


def diverged_fields(requested: str = "requested_config", executed: str = "executed_config") -> Column:
    """The fields of two map columns that both declare with different values, in the order of the first."""
    other = lambda f: F.element_at(executed, f)
    return F.filter(F.map_keys(requested), lambda f: F.map_contains_key(executed, f) & ~F.element_at(requested, f).eqNullSafe(other(f)))
