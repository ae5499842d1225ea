"""Claim artifacts by themselves and as chains: one case a rule, odd rows, repeated ids."""

import json

from pyspark.sql import functions as F

from tracewell.operators import claim_artifacts

CLAIM, CHANGE, CASE, ANSWER = "claim_assertion", "claim_support_change", "contradiction_registration", "contradiction_resolution"
A, B = "clm_" + "a" * 12, "clm_" + "b" * 12
GOOD = {
    CLAIM: {"claim_id": A, "artifact_type": CLAIM, "schema_version": "0.1", "timestamp": "2024-01-01T00:00:00Z", "episode_id": "e", "claim_text": "x" * 500, "claim_type": "FACTUAL", "checkable": False, "basis": {"basis_type": "extracted", "proof_tier_at_assertion": "DRAFT", "basis_refs": ["r"]}},
    CHANGE: {"change_id": "csc_" + "0" * 12, "artifact_type": CHANGE, "schema_version": 1, "timestamp": "2024-01-01T00:00:00+02:00", "claim_id": A, "episode_id": "e", "prior_support_status": "ASSERTED", "new_support_status": "SUPPORTED", "change_type": "evidence_added", "evidence_refs": ["r"]},
    CASE: {"contradiction_id": "ctr_" + "0" * 12, "artifact_type": CASE, "schema_version": 1, "timestamp": "t", "episode_id": "e", "claim_a_id": A, "claim_b_id": B, "conflict_type": "scope_overlap", "severity": "low", "detection": {"detection_method": "opa_policy", "detection_confidence": 1, "detection_evidence_refs": ["r"]}},
    ANSWER: {"resolution_id": "crr_" + "0" * 12, "artifact_type": ANSWER, "schema_version": 1, "timestamp": "t", "contradiction_id": "ctr_" + "0" * 12, "episode_id": "e", "resolution_outcome": "claim_a_prevails", "resolution_basis": {"authority_type": "human_judgment", "evidence_refs": ["r"]}},
}
SPOILT = [
    (CLAIM, {}, set()),
    (CLAIM, {"checkable": None}, {("required_field", "checkable")}),
    (CLAIM, {"artifact_type": CHANGE}, {("artifact_type", "artifact_type")}),
    (CLAIM, {"claim_id": A.upper()}, {("id_format", "claim_id")}),
    (CLAIM, {"claim_id": None}, {("id_format", "claim_id"), ("required_field", "claim_id")}),
    (CLAIM, {"claim_type": "guess"}, {("unknown_value", "claim_type")}),
    (CLAIM, {"claim_text": "x" * 501}, {("text_length", "claim_text")}),
    (CLAIM, {"claim_text": "é" * 500, "parent_claim_id": B}, set()),
    (CLAIM, {"basis": {"basis_type": "x", "proof_tier_at_assertion": "x", "basis_refs": []}}, {("unknown_value", "basis.basis_type"), ("unknown_value", "basis.proof_tier_at_assertion"), ("empty_refs", "basis.basis_refs")}),
    (CLAIM, {"basis": {"basis_refs": "r"}}, {("empty_refs", "basis.basis_refs")}),
    (CLAIM, {"basis": "text", "parent_claim_id": "x"}, {("id_format", "parent_claim_id")}),
    (CLAIM, {"timestamp": "yesterday"}, {("timestamp", "timestamp")}),
    (CHANGE, {}, set()),
    (CHANGE, {"prior_support_status": "RETRACTED"}, {("transition", "new_support_status")}),
    (CHANGE, {"prior_support_status": "SUPPORTED"}, {("transition", "new_support_status")}),
    (CHANGE, {"prior_support_status": "open", "new_support_status": "shut"}, {("unknown_value", "prior_support_status"), ("unknown_value", "new_support_status")}),
    (CHANGE, {"change_type": "contradiction_resolved"}, {("needed", "contradiction_id")}),
    (CHANGE, {"change_type": "governance_decision", "decision_receipt_id": ""}, {("needed", "decision_receipt_id")}),
    (CHANGE, {"change_type": 7}, {("unknown_value", "change_type")}),
    (CHANGE, {"evidence_refs": []}, {("empty_refs", "evidence_refs")}),
    (CHANGE, {"new_support_status": "WEAKENED", "evidence_refs": []}, set()),
    (CASE, {}, set()),
    (CASE, {"claim_b_id": A}, {("same_claim", "claim_b_id")}),
    (CASE, {"claim_a_id": B, "claim_b_id": A}, {("order", "claim_b_id")}),
    (CASE, {"severity": "severe", "conflict_type": "x"}, {("unknown_value", "severity"), ("unknown_value", "conflict_type")}),
    (CASE, {"detection": {"detection_confidence": 1.01, "detection_evidence_refs": [None]}}, {("range", "detection.detection_confidence")}),
    (CASE, {"detection": {"detection_confidence": "1"}}, {("range", "detection.detection_confidence"), ("empty_refs", "detection.detection_evidence_refs")}),
    (ANSWER, {}, set()),
    (ANSWER, {"resolution_outcome": "reconciled"}, {("needed", "superseding_claim_id")}),
    (ANSWER, {"resolution_basis": {"authority_type": "coin"}}, {("unknown_value", "resolution_basis.authority_type"), ("empty_refs", "resolution_basis.evidence_refs")}),
    (ANSWER, {"contradiction_id": "x", "resolution_outcome": "draw"}, {("id_format", "contradiction_id"), ("unknown_value", "resolution_outcome")}),
]
ODD = [(CLAIM, None), (CLAIM, ""), (CLAIM, "{"), (CLAIM, "[]"), (None, "{}"), ("other", "{}")]


def test_rules(spark):
    rows = [(i, k, json.dumps({**GOOD[k], **change})) for i, (k, change, _) in enumerate(SPOILT)] + [(1000 + i, k, raw) for i, (k, raw) in enumerate(ODD)]
    got = {}
    for r in claim_artifacts.artifact_rules(spark.createDataFrame(rows, "line_no long, kind string, raw string").withColumn("check", F.lit(1)).withColumn("field", F.lit(2))).collect():
        got.setdefault(r.line_no, set()).add((r.check, r.field))
    for i, (kind, change, want) in enumerate(SPOILT):
        assert got.get(i, set()) == want, (kind, change)
    assert [got[1000 + i] for i in range(6)] == [{("unreadable", "")}] * 4 + [{("unknown_kind", "")}] * 2


def tables(spark, a=(), s=(), c=(), r=()):
    make = lambda rows, names: spark.createDataFrame([("k", i, t, *x) for i, (t, *x) in enumerate(rows)], "chain_id string, line_no long, t long, " + ", ".join(f"{n} string" for n in names.split())).withColumn("ts", F.timestamp_seconds("t")).withColumns({n: F.lit(1) for n in ("known", "first", "known_ts")})
    return (
        make(a, "claim_id parent_claim_id"),
        make(s, "change_id claim_id prior_status new_status change_type contradiction_id"),
        make(c, "contradiction_id claim_a_id claim_b_id"),
        make(r, "resolution_id contradiction_id outcome superseding_claim_id"),
    )


def found(spark, **rows):
    return sorted((r.artifact_id, r.check, r.severity) for r in claim_artifacts.chain_findings(*tables(spark, **rows)).collect())


def test_whole_chain_has_no_findings(spark):
    rows = dict(
        a=[(1, "c1", None), (2, "c2", "c1"), (3, "c3", "")],
        s=[(5, "s2", "c1", "SUPPORTED", "CONTRADICTED", "contradiction_registered", "d"), (4, "s1", "c1", "ASSERTED", "SUPPORTED", "evidence_added", None), (8, "s3", "c2", "ASSERTED", "WEAKENED", "contradiction_resolved", "d")],
        c=[(5, "d", "c1", "c2")],
        r=[(6, "r", "d", "claim_a_prevails", None)],
    )
    assert found(spark, **rows) == []
    assert found(spark) == []


def test_each_finding(spark):
    e = "error"
    assert found(spark, a=[(5, "c1", "c2"), (9, "c2", "gone"), (7, "c1", None)]) == [("c1", "duplicate_claim_id", e), ("c1", "parent_backward_ref", e), ("c2", "parent_claim_exists", e)]
    changes = [(1, "s1", "c1", "ASSERTED", "RETRACTED", "x", None), (3, "s2", "c1", "SUPPORTED", None, "contradiction_registered", "d"), (4, "s3", "none", "ASSERTED", "", "x", None), (5, "s4", None, None, "WEAKENED", "x", None)]
    assert found(spark, a=[(2, "c1", None)], s=changes) == [
        ("s1", "support_after_assertion", e), ("s2", "contradiction_ref_exists", e), ("s2", "support_prior_mismatch", e), ("s2", "support_retracted_terminal", e), ("s3", "support_change_claim_exists", e), ("s4", "support_change_claim_exists", e), ("s4", "support_prior_mismatch", e),
    ]
    cases = [(1, "d1", "c1", "c2"), (9, "d2", "c1", "c2"), (9, "d2", "c1", "c2"), (9, "d3", "c1", "c9"), (9, "d4", "c1", "c2")]
    answers = [(9, "r1", "d4", "reconciled", "c8"), (0, "r2", "d1", "deferred", None), (9, "r3", "d9", "claim_a_prevails", None), (9, "r4", "d3", "claim_b_prevails", None)]
    assert found(spark, a=[(2, "c1", None), (None, "c2", None)], c=cases, r=answers) == [
        ("d1", "contradiction_claim_a_backward", e), ("d2", "contradiction_dedup", e), ("d2", "contradiction_dedup", e), ("d2", "duplicate_contradiction_id", e), ("d3", "contradiction_claim_b_exists", e),
        ("r1", "resolution_superseding_claim", e), ("r2", "resolution_after_registration", e), ("r3", "resolution_contradiction_exists", e), ("r4", "resolution_support_consistency", "warning"),
    ]


def test_verdicts(spark):
    chains = spark.createDataFrame([("k",), ("none",)], "chain_id string")
    findings = claim_artifacts.chain_findings(*tables(spark, a=[(1, "c", None), (1, "c", "x")]))
    assert sorted(map(tuple, claim_artifacts.chain_verdicts(chains, findings).collect())) == [("k", False, 2, 0), ("none", True, 0, 0)]
