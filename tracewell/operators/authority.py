"""Authority chains: every artifact that a chain refers to, its signers' roles, bindings, time locks and revocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.receipts import parse_time

# What a chain must name, adjudication moves, tiers from low to high.
REQUIRED = ("claim_ref", "normalization_receipt_ref", "claim_type_ref", "charter_clause_ref", "invariant_library_ref", "verifier_contract_ref", "adjudication_receipt_ref")
OPTIONAL = ("scope_composition_proof_ref", "action_receipt_ref", "rollback_contract_ref")
MOVES = ("concept_underspecified", "contract_uncompilable", "receipt_insufficient", "proxy_match", "partial", "mismatch", "match", "refuse", "tier_downgrade")
TIERS = ("none", "hypothesis", "C", "B", "A")
COMPILER = "deterministic_contract_compiler"
# Reasons that make a chain illegitimate.
ILLEGITIMATE = ("missing_artifact", "noncanonical_artifact", "invalid_signature", "missing_log_inclusion", "role_isolation_violation", "self_signed_forbidden", "claim_type_missing", "normalization_missing", "non_strict_claimtype_selected", "charter_unauthorized", "contract_unbound", "receipt_unbound", "receipt_scope_exceeded", "scope_composition_extrapolated", "invalid_adjudication_move", "claim_exceeds_evidence", "action_without_rollback")

#: Columns of an artifact; each kind uses some.
ARTIFACT = """ref string, schema_version string, canonical_hash string, signature string, signed_by string, role string, requires_log_inclusion boolean, revoked boolean,
candidate_claim_types array<struct<claim_type_ref:string,viable:boolean,strictness_rank:bigint>>, selected string, ambiguity_flag boolean, escalated boolean, selection_authority string,
claim_type_ref string, invariant_library_ref string, compiled_by string, required_receipts array<string>, contract_ref string, claim_ref string, question_shape string, receipt_kind string,
scope_exceeds_contract boolean, monotone boolean, composite_scope_exceeds_union boolean, move string, truth_bearing_free_text boolean, tier_demotion_at string, refusal_at string,
earliest_adjudicable_at string, final boolean, charter_allows_irreversible boolean"""


# How a chain uses a reference, as numbers; a reference in its list of revoked ones, and the chain itself, are no uses.
_USES = {"norm": 1, "contract": 2, "adj": 3, "proof": 4, "action": 5, "receipt": 6}
_LISTED, _CHAIN = -1, -2
# Marks of a row above its use: the reference's first row, the use's flag, listed as revoked, a proof that is whole; then its place.
_FIRST, _FLAG, _MARKED, _LOGGED, _PLACE = 8, 16, 32, 64, 128


def _given(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


_FINDING = "struct<step:int,place:int,key:string,rule:int,reason:string,ref:string>"


def _found(rules: list[tuple[int, Column, str, Column]], place: Column, key: Column) -> Column:
    """An array of the rules that hold: (step, when, reason, ref), in their order at a place; empty arrays are not built rule by rule."""
    made, some = [], F.lit(False)
    for i, (step, when, reason, ref) in enumerate(rules):
        some = some | when
        made.append(F.when(when, F.struct(F.lit(step).alias("step"), place.cast("int").alias("place"), key.alias("key"), F.lit(i).alias("rule"), F.lit(reason).alias("reason"), ref.alias("ref"))))
    return F.when(some, F.array_compact(F.array(*made)).cast(f"array<{_FINDING}>"))


def findings(chains: DataFrame, artifacts: DataFrame, proofs: DataFrame, revocations: DataFrame) -> DataFrame:
    """(chain_id, reason, ref, step, place, key, rule): all that is wrong with each chain, with its place in the order of checks.

    chains: chain_id, at (when it is judged), the references of REQUIRED and OPTIONAL, verifier_receipt_refs and
    revoked_artifact_refs (lists), action_domain_authorized, claim_tier, evidence_tier. artifacts: ARTIFACT, one row a ref.
    proofs: chain_id, ref, log_index, integrated_time, body_hash. revocations: ref, revoked_at; what was revoked by the
    time at which a chain is judged counts.

    A reference of a chain is one row with its proof and what its rules compare, flat, with its marks as one number, as most of
    what is shuffled are these rows; it meets its artifact by one equi-join on the reference. Artifacts come narrowed to what the
    rules read, with one row a reference, so an artifact that very many chains use is skewed on the chains' side only, which adaptive
    execution splits. One more shuffle on the chain brings signers, kinds and findings together; no table is joined twice.
    Nothing is gathered but a chain's own lists and findings.
    """
    c, null, no = F.col, F.lit(None).cast("string"), F.lit(False)
    lists = lambda x: F.coalesce(F.col(x), F.array().cast("array<string>"))
    tier = lambda t: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), F.coalesce(F.nullif(t, F.lit("")), F.lit("none"))), F.lit(0)), F.lit(0))

    def use(number: int, ref: Column, one: Column = null, two: Column = null, flag: Column = no, place: Column = F.lit(0)) -> Column:
        return F.struct(ref.alias("ref"), F.lit(number).alias("use"), place.cast("int").alias("place"), one.cast("string").alias("one"), two.cast("string").alias("two"), _yes(flag).alias("flag"))

    of = {
        "normalization_receipt_ref": ("norm", c("claim_type_ref")),
        "verifier_contract_ref": ("contract", c("claim_type_ref"), c("invariant_library_ref")),
        "adjudication_receipt_ref": ("adj", c("claim_ref"), null, tier(c("claim_tier")) > tier(c("evidence_tier"))),
        "scope_composition_proof_ref": ("proof", null, null, F.size(lists("verifier_receipt_refs")) > 1),
        "action_receipt_ref": ("action", null, null, ~_given(c("rollback_contract_ref"))),
    }
    uses = [use(_USES[of[f][0]], F.nullif(c(f), F.lit("")), *of[f][1:]) if f in of else use(0, F.nullif(c(f), F.lit(""))) for f in REQUIRED + OPTIONAL]
    receipts = F.transform(lists("verifier_receipt_refs"), lambda x, i: use(_USES["receipt"], x, c("verifier_contract_ref"), c("claim_ref"), no, i))
    listed = F.transform(lists("revoked_artifact_refs"), lambda x: use(_LISTED, x))
    every = F.concat(F.array(use(_CHAIN, null), *uses), receipts, listed)
    named = chains.where("chain_id is not null").select("chain_id", c("at").cast("timestamp").alias("at"), F.explode(every).alias("u")).select("chain_id", "at", "u.*").where((c("use") == _CHAIN) | c("ref").isNotNull())
    index = c("log_index")
    placed = _given(index) if dict(proofs.dtypes)["log_index"] == "string" else F.coalesce(index != 0, F.lit(False))
    logged = proofs.where("ref is not null").select("chain_id", "ref", F.struct((placed & _given(c("integrated_time").cast("string"))).alias("ok"), c("body_hash").cast("string").alias("body_hash")).alias("proof"))
    refs = named.unionByName(logged, allowMissingColumns=True).repartition("chain_id")
    # one sort serves all: the rows of a reference, its uses first, within its chain
    of_chain, of_ref = Window.partitionBy("chain_id"), Window.partitionBy("chain_id", "ref")
    refs = refs.withColumn("nth", F.row_number().over(of_ref.orderBy(c("use").desc_nulls_last())))
    refs = refs.withColumns({"proof": F.max("proof").over(of_ref), "listed": F.max(c("use") == _LISTED).over(of_ref)})
    refs = refs.withColumns({"at": F.max("at").over(of_chain), "known": F.max(c("use") == _CHAIN).over(of_chain)})
    refs = refs.where(c("known") & c("ref").isNotNull() & ((c("nth") == 1) | (c("use") > 0)))
    marks = F.greatest(c("use"), F.lit(0)).cast("long") + F.coalesce("place", F.lit(0)) * _PLACE
    for bit, when in ((_FIRST, c("nth") == 1), (_FLAG, c("flag")), (_MARKED, c("listed")), (_LOGGED, c("proof.ok"))):
        marks = marks + F.when(when, bit).otherwise(0)
    refs = refs.select("chain_id", "ref", "at", marks.alias("marks"), "one", "two", c("proof.body_hash").alias("body_hash"))

    # what an artifact tells by itself is one number of bits; times are read once an artifact
    viable = F.filter(F.coalesce("candidate_claim_types", F.array().cast("array<struct<claim_type_ref:string,viable:boolean,strictness_rank:bigint>>")), lambda x: _yes(x["viable"]))
    rank = lambda x: F.coalesce(x["strictness_rank"], F.lit(0))
    most = F.array_max(F.transform(viable, rank))
    strictest = F.get(F.filter(viable, lambda x: rank(x) == most), F.lit(0))
    earliest, refusal, demotion = (parse_time(c(n)) for n in ("earliest_adjudicable_at", "refusal_at", "tier_demotion_at"))
    tells = {
        "full": _given(c("schema_version")) & _given(c("canonical_hash")),
        "signed": _given(c("signature")) & _given(c("signed_by")),
        "logs": F.coalesce("requires_log_inclusion", F.lit(True)),
        "revoked": _yes(c("revoked")),
        "unselected": ~_given(c("selected")),
        "ambiguous": _yes(c("ambiguity_flag")) & ~_yes(c("escalated")),
        "loose": c("candidate_claim_types").isNotNull() & (F.size(viable) > 0) & _differs(c("selected"), strictest["claim_type_ref"]) & _differs(c("selection_authority"), F.lit("charter_clause")),
        "by_hand": _differs(c("compiled_by"), F.lit(COMPILER)),
        "shapeless": ~_given(c("question_shape")),
        "too_wide": _yes(c("scope_exceeds_contract")),
        "bad_demotion": _given(c("tier_demotion_at")) & demotion.isNull(),
        "bad_refusal": _given(c("refusal_at")) & refusal.isNull(),
        "not_monotone": ~_yes(c("monotone")),
        "extrapolates": _yes(c("composite_scope_exceeds_union")),
        "no_move": ~_yes(c("move").isin(*MOVES)),
        "free_text": _yes(c("truth_bearing_free_text")),
        "bad_earliest": _given(c("earliest_adjudicable_at")) & earliest.isNull(),
        "irreversible": _yes(c("charter_allows_irreversible")),
    }
    bits = F.lit(0)
    for i, when in enumerate(tells.values()):
        bits = bits.bitwiseOR(F.when(when, 1 << i).otherwise(0))
    is_ = {n: _yes(c("bits").bitwiseAND(F.lit(1 << i)) != 0) for i, n in enumerate(tells)}
    special = ["selected", "claim_type_ref", "invariant_library_ref", "required_receipts", "contract_ref", "claim_ref", "receipt_kind", "stale_at", "early_until"]
    some = F.lit(False)
    for n in special:
        some = some | c(n).isNotNull()
    told = artifacts.withColumns({"bits": bits, "stale_at": F.least(refusal, demotion), "early_until": F.when(_yes(c("final")), earliest)})
    narrow = told.select("ref", "bits", "canonical_hash", "signed_by", "role", F.when(some, F.struct(*special)).alias("a"))
    gone = revocations.groupBy("ref").agg(F.min("revoked_at").alias("revoked_at"))
    seen = refs.join(narrow, "ref", "left").join(gone, "ref", "left")

    # what holds of a reference however it is used is told by its first row, what holds of a use by the use's row
    marked = lambda bit: c("marks").bitwiseAND(F.lit(bit)) != 0
    here, ref, at = c("bits").isNotNull(), c("ref"), c("at")
    included = F.coalesce(marked(_LOGGED) & F.coalesce(c("body_hash") == c("canonical_hash"), F.lit(True)), F.lit(False))
    kind = lambda k: c("marks").bitwiseAND(F.lit(_FIRST - 1)) == _USES[k]
    one, two, flag = c("one"), c("two"), marked(_FLAG)
    simulated = here & _yes(c("role") == "simulator")
    of_refs = _found(
        [
            (2, ~here, "missing_artifact", ref),
            (2, here & ~is_["full"], "noncanonical_artifact", ref),
            (2, here & ~is_["signed"], "invalid_signature", ref),
            (2, here & is_["logs"] & ~included, "missing_log_inclusion", ref),
            (11, marked(_MARKED) | is_["revoked"] | _yes(c("revoked_at") <= at), "revoked_artifact_used", ref),
        ],
        F.lit(0),
        ref,
    )
    of_receipts = _found(
        [
            (4, simulated, "self_signed_forbidden", ref),
            (7, ~here, "missing_artifact", ref),
            (7, here & _differs(c("a.contract_ref"), one), "receipt_unbound", ref),
            (7, here & _differs(c("a.claim_ref"), two), "receipt_unbound", ref),
            (7, here & is_["shapeless"], "receipt_unbound", ref),
            (7, is_["too_wide"], "receipt_scope_exceeded", ref),
            (10, is_["bad_demotion"], "noncanonical_artifact", ref),
            (10, is_["bad_refusal"], "noncanonical_artifact", ref),
            (10, _yes(at >= c("a.stale_at")), "stale_receipt", ref),
        ],
        F.shiftright("marks", _PLACE.bit_length() - 1),
        F.lit(""),
    )
    # rules of a chain's own fields and parts keep their numbers in one list: (step, kind or none, when, reason, ref)
    rules = [(1, "", ~_given(c(f)), "missing_artifact", F.lit(f)) for f in REQUIRED]
    rules += [
        (4, "adj", simulated, "self_signed_forbidden", ref),
        (4, "contract", simulated, "self_signed_forbidden", ref),
        (5, "norm", ~here, "normalization_missing", null),
        (5, "norm", here & (is_["unselected"] | _differs(c("a.selected"), one)), "claim_type_missing", ref),
        (5, "norm", is_["ambiguous"], "normalization_ambiguous", ref),
        (5, "norm", is_["loose"], "non_strict_claimtype_selected", ref),
        (6, "contract", here & _differs(c("a.claim_type_ref"), one), "contract_unbound", ref),
        (6, "contract", here & _differs(c("a.invariant_library_ref"), two), "contract_unbound", ref),
        (6, "contract", is_["by_hand"], "contract_unbound", ref),
        (8, "proof", flag & ~here, "scope_composition_extrapolated", ref),
        (8, "proof", flag & is_["not_monotone"], "scope_composition_extrapolated", ref),
        (8, "proof", flag & is_["extrapolates"], "scope_composition_extrapolated", ref),
        (9, "adj", is_["no_move"], "invalid_adjudication_move", ref),
        (9, "adj", is_["free_text"], "invalid_adjudication_move", ref),
        (9, "adj", here & _differs(c("a.claim_ref"), one), "receipt_unbound", ref),
        (9, "adj", here & flag, "claim_exceeds_evidence", ref),
        (10, "adj", is_["bad_earliest"], "noncanonical_artifact", ref),
        (10, "adj", _yes(at < c("a.early_until")), "too_early_for_final_adjudication", ref),
        (12, "", ~_yes(c("action_domain_authorized")), "charter_unauthorized", c("charter_clause_ref")),
        (12, "action", flag & ~is_["irreversible"], "action_without_rollback", ref),
    ]
    # the parts that a chain does not name at all
    proof_ref = c("scope_composition_proof_ref")
    unnamed = {9: (~_given(c("normalization_receipt_ref")), null), 16: (~_given(proof_ref) & (F.size(lists("verifier_receipt_refs")) > 1), proof_ref)}
    last = F.lit(1_000_000_000)  # after a step's receipts
    of_parts = _found([(step, kind(k) & when if k else F.lit(False), reason, r if k else null) for step, k, when, reason, r in rules], last, F.lit(""))
    of_chains = _found([(step, unnamed[i][0] if i in unnamed else F.lit(False) if k else when, reason, unnamed[i][1] if i in unnamed else null if k else r) for i, (step, k, when, reason, r) in enumerate(rules)], last, F.lit(""))

    # who signed as what, kinds of receipts that are there or needed, and what is found beside them
    seen = seen.withColumns({"of_ref": F.when(marked(_FIRST), of_refs), "of_use": F.when(kind("receipt"), of_receipts).otherwise(of_parts)})
    found = F.when(c("of_ref").isNull(), c("of_use")).when(c("of_use").isNull(), c("of_ref")).otherwise(F.concat("of_ref", "of_use"))
    is_role = marked(_FIRST) & here & _given(c("signed_by")) & _given(c("role"))
    is_kind = kind("receipt") & here & _given(c("a.receipt_kind"))
    needed = kind("contract") & here & (F.size(c("a.required_receipts")) > 0)
    side = seen.select("chain_id", *[F.when(is_role, c(x)).alias(x) for x in ("signed_by", "role")], F.when(is_kind, c("a.receipt_kind")).alias("kind"), F.when(needed, F.array_compact(c("a.required_receipts"))).alias("required"), F.when(needed, ref).alias("needs"), found.alias("found"))
    # rows grow when told apart, so partitions must not be joined by their size before
    parts = int(chains.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = side.where("role is not null or kind is not null or required is not null or found is not null").repartition(parts, "chain_id")

    def fact(about: str, what: Column, role: Column = null, needs: Column = null, f: Column = F.lit(None)) -> Column:
        return F.struct(F.lit(about).alias("about"), what.alias("what"), role.alias("role"), needs.alias("needs"), f.cast(f"array<{_FINDING}>").alias("found"))

    own = F.when(c("role").isNotNull(), fact("role", c("signed_by"), c("role"), null, c("found"))).when(c("found").isNotNull(), fact("none", null, null, null, c("found")))
    there = F.when(c("kind").isNotNull(), fact("kind", c("kind")))
    asked = F.transform("required", lambda x: fact("kind", x, null, c("needs")))
    facts = F.when(c("required").isNull(), F.array(own, there)).otherwise(F.concat(F.array(own, there), asked))
    rows = side.select("chain_id", F.explode(F.array_compact(facts)).alias("r")).select("chain_id", "r.*")
    # of what is told about one signer or kind the first row says what is wrong
    alike = Window.partitionBy("chain_id", "about", "what")
    sums = rows.withColumn("nth", F.row_number().over(alike.orderBy("needs"))).withColumns({"least": F.min("role").over(alike), "most": F.max("role").over(alike), "has": F.max(c("needs").isNull()).over(alike), "needs": F.max("needs").over(alike)})
    sums = sums.withColumn("about", F.when(c("nth") == 1, c("about")))
    isolated = _found([(3, (c("about") == "role") & (c("least") != c("most")), "role_isolation_violation", c("what"))], F.lit(0), c("what"))
    lacking = _found([(7, (c("about") == "kind") & ~c("has") & c("needs").isNotNull(), "missing_artifact", c("needs"))], last, c("what"))
    unpack = lambda df, x: df.select("chain_id", F.explode(x).alias("f")).select("chain_id", "f.*")
    none_found = F.array().cast(f"array<{_FINDING}>")
    every = F.concat(*[F.coalesce(x, none_found) for x in (c("found"), isolated, lacking)])
    wrong = sums.where("found is not null or least <> most or not has").select("chain_id", every.alias("x"))
    return unpack(wrong, "x").unionByName(unpack(chains, of_chains))


def verdicts(chains: DataFrame, found: DataFrame) -> DataFrame:
    """(chain_id, status, reason, findings). A revoked artifact decides; else the first reason that makes a chain
    illegitimate, in the order of checks; else stale receipts, an early final judgment, an open ambiguity."""
    has = lambda r: F.max(F.col("reason") == r)
    bad = F.col("reason").isin(*ILLEGITIMATE)
    order = F.struct("step", "place", "key", "rule", "reason")
    sums = found.groupBy("chain_id").agg(has("revoked_artifact_used").alias("revoked"), F.min(F.when(bad, order)).alias("first"), has("stale_receipt").alias("stale"), has("too_early_for_final_adjudication").alias("early"), has("normalization_ambiguous").alias("open"), F.count("*").alias("findings"))
    pair = lambda status, reason: F.struct(F.lit(status).alias("status"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    outcome = (
        F.when(F.col("findings").isNull(), pair("legitimate", "ok"))
        .when(F.col("revoked"), pair("revoked", "revoked_artifact_used"))
        .when(F.col("first").isNotNull(), pair("illegitimate", F.col("first.reason")))
        .when(F.col("stale"), pair("downgraded", "stale_receipt"))
        .when(F.col("early"), pair("provisional", "too_early_for_final_adjudication"))
        .otherwise(pair("provisional", "normalization_ambiguous"))
    )
    return chains.select("chain_id").join(sums, "chain_id", "left").select("chain_id", outcome.alias("o"), F.coalesce("findings", F.lit(0)).alias("findings")).select("chain_id", "o.*", "findings")
