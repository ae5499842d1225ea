"""Authority chains: one sound chain and what each change makes of it."""

from tracewell.operators import authority

NAMES = [f.split(" ", 1)[0] for f in authority.ARTIFACT.replace("\n", " ").split(", ")]


def artifact(ref, who, **own):
    row = {"ref": ref, "schema_version": "1", "canonical_hash": "h-" + ref, "signature": "s", "signed_by": who, "role": who, "requires_log_inclusion": True} | own
    return tuple(row.get(n) for n in NAMES)


def chain(name, **over):
    """(chain, artifacts, proofs, revocations) of one chain; refs carry its name. ``over`` changes fields of the chain, or of
    an artifact as ``<artifact>__<field>``, or drops it as ``no_<artifact>`` or its proof as ``unlogged``."""
    r = lambda x: f"{name}-{x}"
    fields = {x: {k.split("__")[1]: v for k, v in over.items() if k.startswith(x + "__")} for x in ("claim", "norm", "type", "charter", "lib", "contract", "tests", "lint", "proof", "adj", "action", "rollback")}
    kinds = {
        "claim": artifact(r("claim"), "claimant", **fields["claim"]),
        "norm": artifact(r("norm"), "normalizer", **{"candidate_claim_types": [(r("type"), True, 10)], "selected": r("type"), "ambiguity_flag": False} | fields["norm"]),
        "type": artifact(r("type"), "principal"),
        "charter": artifact(r("charter"), "principal-charter", **fields["charter"]),
        "lib": artifact(r("lib"), "principal-library"),
        "contract": artifact(r("contract"), "compiler", **{"compiled_by": authority.COMPILER, "claim_type_ref": r("type"), "invariant_library_ref": r("lib"), "required_receipts": ["tests", "lint"]} | fields["contract"]),
        "tests": artifact(r("tests"), "verifier-tests", **{"contract_ref": r("contract"), "claim_ref": r("claim"), "question_shape": "q", "receipt_kind": "tests", "tier_demotion_at": "2026-06-01T00:00:00Z"} | fields["tests"]),
        "lint": artifact(r("lint"), "verifier-lint", **{"contract_ref": r("contract"), "claim_ref": r("claim"), "question_shape": "q", "receipt_kind": "lint"} | fields["lint"]),
        "proof": artifact(r("proof"), "composer", **{"monotone": True} | fields["proof"]),
        "adj": artifact(r("adj"), "judge", **{"move": "match", "claim_ref": r("claim"), "final": True, "earliest_adjudicable_at": "2026-05-01T00:00:00Z"} | fields["adj"]),
        "action": artifact(r("action"), "actor", **fields["action"]),
        "rollback": artifact(r("rollback"), "operator"),
    }
    row = {
        "chain_id": name, "at": "2026-05-10 00:00:00", "claim_ref": r("claim"), "normalization_receipt_ref": r("norm"), "claim_type_ref": r("type"), "charter_clause_ref": r("charter"), "invariant_library_ref": r("lib"), "verifier_contract_ref": r("contract"), "adjudication_receipt_ref": r("adj"),
        "scope_composition_proof_ref": r("proof"), "action_receipt_ref": r("action"), "rollback_contract_ref": r("rollback"), "verifier_receipt_refs": [r("tests"), r("lint")], "revoked_artifact_refs": [], "action_domain_authorized": True, "claim_tier": "B", "evidence_tier": "B",
    }
    row |= {k: v for k, v in over.items() if k in row}
    proofs = [(name, r(x), "1", "t", None) for x in kinds if x != over.get("unlogged")]
    revoked = [(r(x), at) for x, at in over.get("revocations", ())]
    return tuple(row.values()), [a for x, a in kinds.items() if x != over.get("without")], proofs, revoked


CASES = {
    "sound": ({}, ("legitimate", "ok")),
    "unlogged": ({"unlogged": "contract"}, ("illegitimate", "missing_log_inclusion")),
    "looser": ({"norm__candidate_claim_types": [("looser-type", True, 1), ("looser-strict", True, 9)]}, ("illegitimate", "non_strict_claimtype_selected")),
    "charter_allows": ({"norm__candidate_claim_types": [("x", True, 9)], "norm__selection_authority": "charter_clause"}, ("legitimate", "ok")),
    "stale": ({"tests__tier_demotion_at": "2026-05-09T00:00:00Z"}, ("downgraded", "stale_receipt")),
    "bad_time": ({"tests__refusal_at": "soon"}, ("illegitimate", "noncanonical_artifact")),
    "extrapolated": ({"proof__composite_scope_exceeds_union": True}, ("illegitimate", "scope_composition_extrapolated")),
    "no_proof": ({"scope_composition_proof_ref": None}, ("illegitimate", "scope_composition_extrapolated")),
    "no_rollback": ({"rollback_contract_ref": None}, ("illegitimate", "action_without_rollback")),
    "irreversible": ({"rollback_contract_ref": None, "action__charter_allows_irreversible": True}, ("legitimate", "ok")),
    "self_signed": ({"adj__role": "simulator", "adj__signed_by": "simulator"}, ("illegitimate", "self_signed_forbidden")),
    "two_roles": ({"adj__signed_by": "compiler"}, ("illegitimate", "role_isolation_violation")),
    "early": ({"adj__earliest_adjudicable_at": "2026-05-11T00:00:00Z"}, ("provisional", "too_early_for_final_adjudication")),
    "ambiguous": ({"norm__ambiguity_flag": True}, ("provisional", "normalization_ambiguous")),
    "stale_first": ({"norm__ambiguity_flag": True, "lint__refusal_at": "2026-01-01T00:00:00Z"}, ("downgraded", "stale_receipt")),
    "listed": ({"revoked_artifact_refs": ["listed-charter"], "adj__move": "guess"}, ("revoked", "revoked_artifact_used")),
    "revoked_before": ({"revocations": [("lib", "2026-05-09 00:00:00")]}, ("revoked", "revoked_artifact_used")),
    "revoked_after": ({"revocations": [("lib", "2026-05-11 00:00:00")]}, ("legitimate", "ok")),
    "missing_kind": ({"verifier_receipt_refs": ["missing_kind-tests"]}, ("illegitimate", "missing_artifact")),
    "gone": ({"without": "tests"}, ("illegitimate", "missing_artifact")),
    "unsigned": ({"claim__signature": ""}, ("illegitimate", "invalid_signature")),
    "unbound": ({"contract__invariant_library_ref": "other"}, ("illegitimate", "contract_unbound")),
    "too_high": ({"evidence_tier": "C"}, ("illegitimate", "claim_exceeds_evidence")),
    "unknown_tier": ({"claim_tier": None, "evidence_tier": "Z"}, ("illegitimate", "claim_exceeds_evidence")),
    "guess": ({"adj__move": None}, ("illegitimate", "invalid_adjudication_move")),
    "unauthorized": ({"action_domain_authorized": None}, ("illegitimate", "charter_unauthorized")),
    "unnamed": ({"claim_type_ref": None}, ("illegitimate", "missing_artifact")),
}


def test_cases(spark):
    made = [chain(name, **over) for name, (over, _) in CASES.items()]
    fields = "chain_id string, at string, " + ", ".join(f"{x} string" for x in authority.REQUIRED + authority.OPTIONAL) + ", verifier_receipt_refs array<string>, revoked_artifact_refs array<string>, action_domain_authorized boolean, claim_tier string, evidence_tier string"
    chains = spark.createDataFrame([m[0] for m in made], fields)
    artifacts = spark.createDataFrame([a for m in made for a in m[1]], authority.ARTIFACT)
    proofs = spark.createDataFrame([p for m in made for p in m[2]], "chain_id string, ref string, log_index string, integrated_time string, body_hash string")
    revoked = spark.createDataFrame([x for m in made for x in m[3]], "ref string, revoked_at string").selectExpr("ref", "cast(revoked_at as timestamp) revoked_at")
    found = authority.findings(chains.withColumn("at", chains["at"].cast("timestamp")), artifacts, proofs, revoked)
    got = {r["chain_id"]: (r["status"], r["reason"]) for r in authority.verdicts(chains, found).collect()}
    assert got == {name: want for name, (_, want) in CASES.items()}
