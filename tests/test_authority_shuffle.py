"""What chains shuffle: flat rows, none of them gathered on the way."""

from tests.test_authority import chain

from tracewell.operators import authority


def test_uses_are_not_gathered(spark):
    """One reference, the contract, is also a receipt and listed: it is judged once as a reference, once for each use."""
    row, artifacts, proofs, _ = chain("a", verifier_receipt_refs=["a-tests", "a-lint", "a-contract"], revoked_artifact_refs=["a-contract"], unlogged="contract")
    text = ["chain_id", "at", *authority.REQUIRED, *authority.OPTIONAL]
    ddl = ", ".join(f"{n} string" for n in text) + ", verifier_receipt_refs array<string>, revoked_artifact_refs array<string>, action_domain_authorized boolean, claim_tier string, evidence_tier string"
    proofs = spark.createDataFrame(proofs, "chain_id string, ref string, log_index string, integrated_time string, body_hash string")
    found = authority.findings(spark.createDataFrame([row], ddl), spark.createDataFrame(artifacts, authority.ARTIFACT), proofs, spark.createDataFrame([], "ref string, revoked_at string"))
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    want = [("missing_log_inclusion", 2), ("receipt_unbound", 7), ("receipt_unbound", 7), ("receipt_unbound", 7), ("revoked_artifact_used", 11)]
    assert sorted((r.reason, r.step) for r in found.where("ref = 'a-contract'").collect()) == want


def test_verdicts_gather_no_findings(spark):
    """Verdicts are sums over findings: no list of them is made, spilled or shuffled on the way."""
    made = [chain(n, **over) for n, over in (("a", {}), ("b", {"adj__signed_by": "compiler"}), ("c", {"verifier_receipt_refs": ["c-tests"]}))]
    text = ["chain_id", "at", *authority.REQUIRED, *authority.OPTIONAL]
    ddl = ", ".join(f"{n} string" for n in text) + ", verifier_receipt_refs array<string>, revoked_artifact_refs array<string>, action_domain_authorized boolean, claim_tier string, evidence_tier string"
    chains, artifacts = spark.createDataFrame([m[0] for m in made], ddl), spark.createDataFrame([a for m in made for a in m[1]], authority.ARTIFACT)
    proofs = spark.createDataFrame([p for m in made for p in m[2]], "chain_id string, ref string, log_index string, integrated_time string, body_hash string")
    verdicts = authority.verdicts(chains, authority.findings(chains, artifacts, proofs, spark.createDataFrame([], "ref string, revoked_at string")))
    plan = verdicts._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    got = {r.chain_id: (r.status, r.reason, r.findings) for r in verdicts.collect()}
    assert got == {"a": ("legitimate", "ok", 0), "b": ("illegitimate", "role_isolation_violation", 1), "c": ("illegitimate", "missing_artifact", 1)}
