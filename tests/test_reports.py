from tracewell.operators import reports, textgate


def test_markers_bound_lines(spark):
    pairs = spark.createDataFrame([("a", "an experimental draft", "Roadmap: production-ready\nIt is production-ready"), ("b", "a prototype", "a prototype\nan experimental, validated and reliable engine"), ("c", "x", ""), ("d", None, "goal: all"), ("e", "draft", None)], "id string, x string, y string")
    assert {tuple(r) for r in textgate.non_claims(pairs, "id", "x", "y").collect()} == {("a", 1, "bounded_or_aspirational_marker:roadmap"), ("d", 1, "bounded_or_aspirational_marker:goal:")}
    got = {(r.id, r.line, r.transition) for r in textgate.claim_transitions(pairs, "id", "x", "y").collect()}
    assert got == {("a", 2, "prototype_to_production"), ("b", 2, "experimental_to_reliable")}
    named = textgate.claim_transitions(pairs, "id", "x", "y", (*textgate.ALLOW_MARKERS, "prototype", "experimental"))
    assert {(r.id, r.line) for r in named.collect()} == {("a", 2), ("b", 2)}
    generic = textgate.non_claims(pairs, "id", "x", "y", ("prototype", "experimental"))
    assert {(r.id, r.line) for r in generic.collect()} == {("b", 1)}
    ids = textgate.transition_ids(textgate.claim_transitions(pairs, "id", "x", "y"), "id")
    assert {r.transition_id for r in ids.collect()} == {"cgt_001"}


def test_overall_verdict_order(spark):
    names = ["integrity_verdict", "trust_verdict", "replay_verdict", "claim_verdict"]
    rows = [("TAMPERED", "UNTRUSTED", "DIVERGE", "HONEST_FAIL"), (None, "UNTRUSTED", "DIVERGE", None), ("PASS", None, "DIVERGE", "HONEST_FAIL"), ("PASS", "TRUSTED", "MATCH", "HONEST_FAIL"), (None, None, None, None)]
    got = [r.overall_verdict for r in reports.overall_verdicts(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).coalesce(1)).collect()]
    assert got == ["TAMPERED", "UNTRUSTED", "REPLAY_DIVERGED", "HONEST_FAIL", "PASS"]


def test_residual_risks(spark):
    results = spark.createDataFrame([("a", True, "T2", None, None, None), ("b", False, None, "warning", "1", None), ("c", False, "T2", None, None, None), ("d", True, None, "warning", None, None), ("e", None, None, "warning", None, "2"), ("f", True, "", None, None, None)], "claim_id string, passed boolean, tier_cap string, severity string, expected string, actual string")
    notes = spark.createDataFrame([("a", "why", "me", "", None)], "claim_id string, why_tolerated string, owner string, expiry_condition string, next_cheapest_evidence string")
    got = {r.claim_id: (r.risk_statement, r.why_tolerated, r.owner, r.next_cheapest_evidence) for r in reports.residual_risks(results, notes).collect()}
    assert got == {
        "a": ("Claim passed but capped: T2", "why", "me", "name a falsifier for this claim"),
        "b": ("Warning claim failed: expected 1, actual ?", "warning severity — not blocking", "", ""),
        "e": ("Warning claim failed: expected ?, actual 2", "warning severity — not blocking", "", ""),
    }


def test_posture_divergence_types(spark):
    o, v, c, u = "DEBT_OUTSTANDING", "DEBT_OVERDUE", "CLEAN", "UNKNOWN"
    cases = [(None, c, "PRODUCTION_UNAVAILABLE", False), (None, o, "PRODUCTION_UNAVAILABLE", True), (c, u, "STORE_UNAVAILABLE", True), (c, c, "NONE", False), (o, c, "DEBT_RESOLVED", True), (c, v, "DEBT_ACCRUED", True), (o, v, "DEBT_WORSENED", True), (v, o, "DEBT_IMPROVED", True), (u, c, "STATE_CHANGED", True)]
    ddl = "id int, posture string, evaluated_at string"
    current = spark.createDataFrame([(i, x[1], "t") for i, x in enumerate(cases)], ddl)
    rows = [(i, n, "governance_posture_snapshot", p, "t") for i, x in enumerate(cases) if x[0] for n, p in ((1, "OTHER"), (2, x[0]))]
    before = reports.last_snapshots(spark.createDataFrame(rows, "id int, seq int, type string, posture string, evaluated_at string"), "id")
    got = {r.id: (r.divergence_type, r.diverged) for r in reports.posture_divergence(current, before, "id").collect()}
    assert got == {i: x[2:] for i, x in enumerate(cases)}
