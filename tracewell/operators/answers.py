"""Questionnaire answers against the evidence that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textgate import claim_kind, question_hint


def findings(answers: DataFrame, refs: DataFrame, fresh_days: int, allowed: list[str], strict: bool = False) -> DataFrame:
    """(answer_id, level, code): what is wrong with answers.

    answers: (answer_id, status, factual, claim_type, answer_bool, missing_requests count). refs, as
    resolved: (answer_id, ref_no, resolved, numeric, affirmative, age_days). Every unresolved or stale
    reference is a finding of its own; numeric and affirmative support is that of any resolved one."""
    rows = refs.withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    any_of = lambda c: F.bool_or(F.col("resolved") & F.coalesce(c, F.lit(False))).alias(c)
    support = rows.groupBy("answer_id").agg(F.count("*").alias("refs"), any_of("numeric"), any_of("affirmative"))
    joined = answers.join(support, "answer_id", "left").fillna(0, ["refs"]).fillna(False, ["numeric", "affirmative"])
    status, kind, yes = F.col("status"), F.col("claim_type"), F.coalesce("answer_bool", F.lit(False))
    code = lambda when, name: F.when(when, F.lit(name))
    rules = F.array_compact(
        F.array(
            code(F.col("factual") & status.isin("ANSWERED", "PARTIAL") & (F.col("refs") == 0), "VQ001_MISSING_CITATION"),
            code((status == "ANSWERED") & (F.col("missing_requests") > 0), "VQ008_ANSWER_STATUS_INVALID_FOR_CONTENT"),
            code((status == "INSUFFICIENT_EVIDENCE") & yes, "VQ008_ANSWER_STATUS_INVALID_FOR_CONTENT"),
            code((kind == "COMMITMENT") & F.lit("COMMITMENT" not in allowed), "VQ010_CLAIM_TYPE_POLICY_VIOLATION"),
            code((kind == "METRIC") & ~F.col("numeric"), "VQ004_NUMERIC_CLAIM_NO_NUMERIC_SOURCE"),
            code(yes & ~F.col("affirmative"), "VQ009_YES_WITHOUT_SUPPORT"),
        )
    )
    own = joined.select("answer_id", F.lit("error").alias("level"), F.explode(rules).alias("code"))
    each = rows.join(answers.select("answer_id", "claim_type"), "answer_id")
    stale = F.col("resolved") & F.col("claim_type").isin("PROCESS", "INCIDENT") & (F.col("age_days") > fresh_days)
    lost = each.where(~F.col("resolved")).select("answer_id", F.lit("error").alias("level"), F.lit("VQ002_EVIDENCE_REF_NOT_FOUND").alias("code"))
    old = each.where(stale).select("answer_id", F.lit("error" if strict else "warning").alias("level"), F.lit("VQ006_STALE_EVIDENCE").alias("code"))
    return own.union(lost).union(old)


def status_counts(answers: DataFrame, by: list[str]) -> DataFrame:
    """Answers by status."""
    return answers.groupBy(*by, "status").agg(F.count("*").alias("answers"))


def digests_match(current: DataFrame, locked: DataFrame) -> DataFrame:
    """(pack_id, problem) where the set of packs or a digest differs from the locked one. Both: (pack_id, digest)."""
    both = current.join(locked.withColumnRenamed("digest", "locked"), "pack_id", "full")
    problem = F.when(F.col("locked").isNull(), "not locked").when(F.col("digest").isNull(), "gone").when(F.col("digest") != F.col("locked"), "changed")
    return both.withColumn("problem", problem).where("problem is not null").select("pack_id", "problem")


# By kind of claim, who reviews it and what risks it holds; what is said, how sure, and what is asked for.
REVIEW = {"LEGAL": ("LEGAL", ("LEGAL_REVIEW",)), "INCIDENT": ("SECURITY", ("SECURITY_REVIEW",)), "TECH_CONTROL": ("SECURITY", ("SECURITY_REVIEW",)), "COMMITMENT": ("ENG", ("LEGAL_REVIEW", "SECURITY_REVIEW"))}
SAYS = {
    "none": ("INSUFFICIENT_EVIDENCE", "Insufficient direct evidence in provided proof packs.", 0.2, ("Provide direct artifact backing this claim (policy, report, or control evidence).",)),
    "metric": ("ANSWERED", "Observed {} receipts in the evidence pack attestation.", 0.95, ()),
    "activity": ("PARTIAL", "Receipts show operational activity, but direct control attestation is not explicit.", 0.6, ("Provide explicit control-policy artifact mapped to this questionnaire item.", "Provide ownership and review cadence evidence for this control.")),
    "legal": ("PARTIAL", "Legal/compliance response requires human legal review before final submission.", 0.45, ("Legal-approved wording for this clause.",)),
    "allowed": ("PARTIAL", "Commitment language requires explicit authority and legal approval.", 0.35, ("Provide authorized commitment owner and approval receipt.", "Attach policy allowing this commitment.")),
    "barred": ("INSUFFICIENT_EVIDENCE", "Policy profile disallows commitment claims without explicit allowlist.", 0.1, ("Switch to balanced policy or remove commitment phrasing.",)),
    "certificate": ("INSUFFICIENT_EVIDENCE", "No direct certification artifact found in provided evidence packs.", 0.15, ("Provide certification artifact and auditor-issued evidence.",)),
}


def compile_answers(questions: DataFrame, packs: DataFrame, receipts: DataFrame, commitments: bool = False) -> DataFrame:
    """One drafted answer per question, with its evidence reference and what is still missing.

    questions: org, question_id, question_text; packs: org, pack_id, attested (the number of receipts that its
    attestation states, or null: as many as there are); receipts: org, pack_id, line_no, receipt_id. The first pack of an organisation by
    id and the first receipt of it by line are cited. A null text is an empty one and no question of yes or no. Packs and receipts are reduced to
    a row an organisation before questions meet them. Pack ids are texts; a null pack id or organisation holds no evidence."""
    counts = receipts.groupBy("org", "pack_id").agg(F.count("*").alias("held"), F.min_by(F.struct("receipt_id"), "line_no").alias("receipt"))
    rows = packs.select("org", "pack_id", "attested").where("org is not null and pack_id is not null").join(counts, ["org", "pack_id"], "left")
    first = rows.groupBy("org").agg(F.min_by(F.struct("pack_id", F.coalesce("attested", "held", F.lit(0)).cast("long").alias("n"), F.col("receipt.receipt_id").alias("receipt_id"), F.coalesce(F.col("held") > 0, F.lit(False)).alias("some")), "pack_id").alias("p"))
    text = F.coalesce("question_text", F.lit(""))
    q = questions.select("org", "question_id", text.alias("text"), claim_kind(text).alias("claim_type")).join(first, "org", "left")
    kind, has = F.col("claim_type"), F.col("p").isNotNull()
    case = (
        F.when((kind == "METRIC") & has, "metric")
        .when(kind.isin("PROCESS", "TECH_CONTROL", "INCIDENT") & F.coalesce(F.col("p.some"), F.lit(False)), "activity")
        .when(kind == "LEGAL", "legal")
        .when(kind == "COMMITMENT", "allowed" if commitments else "barred")
        .when(kind == "CERTIFICATION", "certificate")
        .otherwise("none")
    )
    q = q.withColumn("said", case)
    pick = lambda f, otherwise: _choose(F.col("said"), {k: f(v) for k, v in SAYS.items()}, otherwise)
    metric, activity = F.col("said") == "metric", F.col("said") == "activity"
    ref = F.when(metric, F.struct(F.col("p.pack_id").alias("pack_id"), F.lit("__manifest__").alias("receipt_id"), F.lit("REPORT_SECTION").alias("evidence_kind"), F.lit("attestation.n_receipts").alias("pointer"))).when(activity, F.struct(F.col("p.pack_id").alias("pack_id"), F.coalesce("p.receipt_id", F.lit("")).alias("receipt_id"), F.lit("RECEIPT").alias("evidence_kind"), F.lit("type").alias("pointer")))
    texts = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    owner = _choose(kind, {k: F.lit(v[0]) for k, v in REVIEW.items()}, F.lit("NONE"))
    return q.select(
        "org", "question_id", F.concat(F.lit("ans_"), "question_id").alias("answer_id"), pick(lambda v: F.lit(v[0]), None).alias("status"),
        F.when(kind == "LEGAL", "POLICY_ONLY").otherwise("EVIDENCE_PLUS_EXPLANATION").alias("answer_mode"), "claim_type",
        F.when(metric & (question_hint(F.col("text")) == "yes_no"), F.col("p.n") > 0).alias("answer_bool"), F.when(metric, F.col("p.n")).alias("answer_value"),
        F.replace(pick(lambda v: F.lit(v[1]), None), F.lit("{}"), F.coalesce(F.col("p.n").cast("string"), F.lit(""))).alias("details"), pick(lambda v: F.lit(v[2]), None).alias("confidence"), ref.alias("evidence_ref"),
        owner.alias("review_owner_hint"), (owner != "NONE").alias("review_required"), _choose(kind, {k: texts(v[1]) for k, v in REVIEW.items()}, texts(("NONE",))).alias("risk_flags"), pick(lambda v: texts(v[3]), None).alias("missing_evidence_requests"),
    )


def _choose(by: Column, values: dict[str, Column], otherwise: Column | None) -> Column:
    out = otherwise
    for key, value in values.items():
        out = F.when(by == key, value) if out is None else F.when(by == key, value).otherwise(out)
    return out
