from tracewell.operators import assurance, packets


def test_question_rules(spark):
    ddl = "packet_id string, question_id int, status_rule string, in_scope boolean, numerator int, denominator int"
    rows = [("p", 1, "ALL_EVIDENCE_REQUIRED", True, None, None), ("p", 2, "ALL_EVIDENCE_REQUIRED", None, None, None), ("p", 3, "ALL_EVIDENCE_REQUIRED", True, None, None), ("p", 4, "PARTIAL_IF_RATIO_LT_1", True, 3, 4), ("p", 5, "PARTIAL_IF_RATIO_LT_1", True, 4, 4), ("p", 6, "PARTIAL_IF_RATIO_LT_1", True, 4, None), ("p", 7, None, True, None, None), ("p", 8, "HUMAN_ATTESTED", True, None, None), ("p", 9, "HUMAN_ATTESTED", False, None, None), ("p", 10, "new", True, None, None)]
    evidence = spark.createDataFrame([("p", 1, 2, "b", True), ("p", 1, 1, "a", True), ("p", 2, 1, "a", None), ("q", 3, 1, "a", True)], "packet_id string, question_id int, position int, ref string, holds boolean")
    got = {r.question_id: (r.status, r.refs, r.error) for r in packets.question_status(spark.createDataFrame(rows, ddl), evidence).collect()}
    assert got == {
        1: ("EVIDENCED", "a; b", None), 2: ("FAILED", "a", None), 3: (None, None, "mapping_missing_evidence"), 4: ("PARTIAL", None, None), 5: ("EVIDENCED", None, None),
        6: (None, None, "invalid_ratio_denominator"), 7: ("OUT_OF_SCOPE", None, None), 8: ("HUMAN_ATTESTED", None, None), 9: ("OUT_OF_SCOPE", None, None), 10: (None, None, "unsupported_status_rule"),
    }


def test_freshness(spark):
    t = lambda d: f"2024-01-{d:02d} 00:00:00"
    rows = [(1, t(31), t(1), None, None), (2, t(31), t(1), "P30D", None), (3, t(31), t(1), "P29D", None), (4, None, t(1), None, None), (5, t(1), None, None, None), (6, t(2), t(1), "", t(20)), (7, t(2), t(1), "P9M", None), (8, t(2), t(1), None, "2024-02-01 00:00:00")]
    df = spark.createDataFrame(rows, "packet_id int, g string, e string, stale_after string, x string").selectExpr("packet_id", "cast(g as timestamp) generated_at", "cast(e as timestamp) evidence_time", "stale_after", "cast(x as timestamp) expires_at")
    got = [r.freshness_state for r in packets.freshness(df, "2024-02-01 00:00:00").orderBy("packet_id").collect()]
    assert got == ["FRESH", "FRESH", "STALE", "STALE", "STALE", "STALE", "STALE", "FRESH"]


def test_settlement_order(spark):
    ddl = "packet_id int, receipt_integrity string, error_codes array<string>, claim_passed boolean, claim_check string, freshness_state string, baseline_state string"
    rows = [(1, "FAIL", None, True, None, "FRESH", None), (2, None, ["E_PACK_X"], True, None, "FRESH", None), (3, "PASS", [], True, None, "FRESH", None), (4, "PASS", [], True, None, "FRESH", "VERIFIED"), (5, "PASS", [], None, "FAIL", "FRESH", None), (6, "PASS", ["E_OTHER"], None, None, "FRESH", "VERIFIED_WITH_GAPS"), (7, "", [], True, "FAIL", "FRESH", None), (8, "PASS", [], True, None, "STALE", None), (9, "PASS", [], True, None, "FRESH", "VERIFIED")]
    status = [(1, "EVIDENCED"), (2, "EVIDENCED"), (3, "OUT_OF_SCOPE"), (4, "FAILED"), (5, "EVIDENCED"), (6, "PARTIAL"), (6, "FAILED"), (7, "FAILED"), (8, "EVIDENCED"), (9, "EVIDENCED"), (9, None)]
    got = packets.settlement(spark.createDataFrame(rows, ddl), spark.createDataFrame(status, "packet_id int, status string")).orderBy("packet_id").collect()
    assert [r.settlement_state for r in got] == ["TAMPERED", "TAMPERED", "OUT_OF_SCOPE", "EVIDENCE_REGRESSION", "INCOMPLETE_EVIDENCE", "VERIFIED_WITH_GAPS", "INCOMPLETE_EVIDENCE", "VERIFIED_WITH_GAPS", "VERIFIED"]


def test_census_and_gate(spark):
    coverage = spark.createDataFrame([("a", "x", "EVIDENCED"), ("a", "y", None), ("b", "x", "OUT_OF_SCOPE"), ("c", "x", "FAILED"), ("c", "y", "FAILED"), ("d", "x", "HUMAN_ATTESTED")], "packet_id string, prompt string, status string")
    questions = spark.createDataFrame([("a", "x", 1, "HUMAN_ATTESTED"), ("d", "x", 2, "OTHER")], "packet_id string, prompt string, question_id int, status_rule string")
    points = packets.decision_points(coverage, questions)
    got = {(r.packet_id, r.prompt): (r.status, r.expected_emission, r.human_crossing) for r in points.collect()}
    assert got[("a", "x")] == ("emitted", "human_attestation", True)
    assert got[("a", "y")] == ("uncertain", "unknown", None)
    assert got[("d", "x")] == ("human_attested", "human_attestation", True)
    seen = {r.packet_id: (r.coverage_ratio, r.coverage_state, r.omission_severity) for r in packets.census(points).collect()}
    assert seen == {"a": (1.0, "degraded", "low"), "b": (0.0, "uncensusable", "none"), "c": (0.0, "incomplete", "high"), "d": (1.0, "complete", "none")}
    assert {r.packet_id: r.gate for r in packets.gap_gate(points, 0, 0, 1).collect()} == {"a": "warn", "b": "pass", "c": "fail", "d": "pass"}
    assert packets.decision_gaps(points).count() == 3


def test_compliance_of_empty_and_whole_packs(spark):
    packs = spark.createDataFrame([("a", True, True, "s"), ("b", None, None, None)], "pack_id string, integrity_pass boolean, claims_present boolean, signer_id string")
    receipts = spark.createDataFrame([("a", "r", "model_call", "t", "m", "p"), ("a", "q", "other", "t", None, None)], "pack_id string, receipt_id string, type string, timestamp string, model_id string, provider string")
    totals = {(r.pack_id, r.framework): (r.passed, r.failed, r.unknown) for r in assurance.compliance_summary(assurance.compliance(packs, receipts, "pack_id"), "pack_id").collect()}
    assert totals == {("a", "eu-ai-act"): (5, 0, 1), ("a", "soc2"): (4, 0, 0), ("a", "iso42001"): (4, 0, 0), ("a", "nist-ai-rmf"): (4, 0, 0), ("b", "eu-ai-act"): (1, 4, 1), ("b", "soc2"): (0, 4, 0), ("b", "iso42001"): (1, 3, 0), ("b", "nist-ai-rmf"): (0, 4, 0)}


def test_trust_states(spark):
    rows = [("a", None, None, None, "h"), ("b", " ", "k", True, "h"), ("c", "s", None, True, "h"), ("d", "s", "k", None, "h"), ("e", "s", "k", True, "h"), ("f", "s", "k", False, "h"), ("g", "s", "k", True, None), ("h", None, None, None, None)]
    decisions = spark.createDataFrame(rows, "receipt_id string, signature string, signer_key string, signature_ok boolean, content_hash string")
    asked = spark.createDataFrame([(x,) for x in "abcdefghz"], "receipt_id string")
    broken = spark.createDataFrame([("c",), ("g",), ("g",)], "receipt_id string")
    got = {r.receipt_id: r.state for r in assurance.classify_trust(asked, decisions, broken).collect()}
    assert got == {"a": "UNSIGNED", "b": "INVALID", "c": "UNVERIFIABLE", "d": "UNVERIFIABLE", "e": "VERIFIED", "f": "INVALID", "g": "INVALID", "h": "UNSIGNED", "z": "MISSING"}


def test_governance_counts_the_first_of_an_event(spark):
    events = spark.createDataFrame([("a", None, "e", "challenge", True, True, 1), ("a", None, "e", "revocation", True, True, 2), ("b", "b", "f", "revocation", True, False, 1), ("b", "c", "g", "revocation", False, None, 2), ("b", "", None, "supersession", True, None, 3)], "passport_id string, target_id string, event_id string, event_type string, signed boolean, valid boolean, seq int")
    passports = spark.createDataFrame([("a",), ("b",), ("c",)], "passport_id string")
    got = {tuple(r) for r in assurance.governance_dimensions(passports, events).collect()}
    assert got == {("a", "challenged", "all_valid", 1, 1), ("b", "superseded", "some_invalid", 1, 0), ("c", "none", "no_events", 0, 0)}
