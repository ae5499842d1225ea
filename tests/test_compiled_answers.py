"""Drafted answers: each kind of claim with and without evidence, nulls, ties."""

from tracewell.operators import answers


def test_kinds(spark):
    packs = spark.createDataFrame([("a", "p2", 9), ("a", "p1", None), ("b", "p3", 0), (None, "p0", 1)], "org string, pack_id string, attested long")
    receipts = spark.createDataFrame([("a", "p1", 2, "r2"), ("a", "p1", 1, "r1"), ("a", "p2", 0, "r0")], "org string, pack_id string, line_no long, receipt_id string")
    asked = [("a", "1", "Do you count calls?"), ("b", "2", "Do you count calls?"), ("a", "3", "Who holds keys?"), ("b", "4", "Who holds keys?"), ("c", "5", "latency"), ("a", "6", "We guarantee it"), ("a", "7", "GDPR"), ("a", "8", None), (None, "9", "latency"), ("a", "10", "ISO 27001")]
    questions = spark.createDataFrame(asked, "org string, question_id string, question_text string")
    rows = {r.question_id: r for r in answers.compile_answers(questions, packs, receipts).collect()}
    got = {k: (r.status, r.claim_type, r.answer_bool, r.answer_value, r.evidence_ref and (r.evidence_ref.pack_id, r.evidence_ref.receipt_id)) for k, r in rows.items()}
    none = "INSUFFICIENT_EVIDENCE"
    assert got == {
        "1": ("ANSWERED", "METRIC", True, 2, ("p1", "__manifest__")),
        "2": ("ANSWERED", "METRIC", False, 0, ("p3", "__manifest__")),
        "3": ("PARTIAL", "TECH_CONTROL", None, None, ("p1", "r1")),
        "4": (none, "TECH_CONTROL", None, None, None),
        "5": (none, "METRIC", None, None, None),
        "6": (none, "COMMITMENT", None, None, None),
        "7": ("PARTIAL", "LEGAL", None, None, None),
        "8": ("PARTIAL", "TECH_CONTROL", None, None, ("p1", "r1")),
        "9": (none, "METRIC", None, None, None),
        "10": (none, "CERTIFICATION", None, None, None),
    }
    assert rows["1"].details == "Observed 2 receipts in the evidence pack attestation." and rows["1"].missing_evidence_requests == []
    assert rows["6"].risk_flags == ["LEGAL_REVIEW", "SECURITY_REVIEW"] and rows["6"].review_owner_hint == "ENG"
    allowed = answers.compile_answers(questions.where("question_id = 6"), packs, receipts, commitments=True).first()
    assert (allowed.status, allowed.confidence) == ("PARTIAL", 0.35)
    assert answers.compile_answers(questions.limit(0), packs, receipts).count() == 0
