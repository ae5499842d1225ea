"""Claim artifacts: assertions, changes of support, contradictions and their resolutions; each by itself and as chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.receipts import parse_time
from .governance import support_chain

# Required fields of each kind of artifact, its id first; prefixes of ids; known values of fields; moves of support.
REQUIRED = {
    "claim_assertion": ("claim_id", "artifact_type", "schema_version", "timestamp", "episode_id", "claim_text", "claim_type", "checkable", "basis"),
    "claim_support_change": ("change_id", "artifact_type", "schema_version", "timestamp", "claim_id", "episode_id", "prior_support_status", "new_support_status", "change_type", "evidence_refs"),
    "contradiction_registration": ("contradiction_id", "artifact_type", "schema_version", "timestamp", "episode_id", "claim_a_id", "claim_b_id", "conflict_type", "severity", "detection"),
    "contradiction_resolution": ("resolution_id", "artifact_type", "schema_version", "timestamp", "contradiction_id", "episode_id", "resolution_outcome", "resolution_basis"),
}
PREFIXES = {"claim_id": "clm", "change_id": "csc", "contradiction_id": "ctr", "resolution_id": "crr"}
CLAIM_TYPES = ("FACTUAL", "CODE_OUTPUT", "CONSTRAINT", "POLICY", "SYNTHESIS")
BASIS_TYPES = ("extracted", "policy_declared", "governance_inferred", "human_asserted")
PROOF_TIERS = ("DRAFT", "CHECKED", "TOOL_VERIFIED", "ADVERSARIAL", "CONSTITUTIONAL")
SUPPORT = ("ASSERTED", "SUPPORTED", "WEAKENED", "CONTRADICTED", "RETRACTED")
CHANGE_TYPES = ("evidence_added", "evidence_removed", "verification_passed", "verification_failed", "verification_inconclusive", "contradiction_registered", "contradiction_resolved", "governance_decision", "retraction")
CONFLICT_TYPES = ("direct_negation", "inconsistent_evidence", "policy_conflict", "temporal_inconsistency", "scope_overlap")
SEVERITIES = ("critical", "high", "medium", "low")
DETECTION_METHODS = ("automated_verification", "semantic_similarity", "opa_policy", "human_identified", "cross_episode")
OUTCOMES = ("claim_a_prevails", "claim_b_prevails", "both_retracted", "reconciled", "out_of_scope", "deferred")
AUTHORITIES = ("automated_verification", "governance_decision", "human_judgment", "new_evidence", "policy_update")
MOVES = {
    "ASSERTED": ("SUPPORTED", "WEAKENED", "CONTRADICTED", "RETRACTED"),
    "SUPPORTED": ("WEAKENED", "CONTRADICTED", "RETRACTED"),
    "WEAKENED": ("SUPPORTED", "CONTRADICTED", "RETRACTED"),
    "CONTRADICTED": ("SUPPORTED", "WEAKENED", "RETRACTED"),
    "RETRACTED": (),
}
MOST_TEXT = 500


class _Fields:
    """Columns over the fields of a JSON object in the variant column ``v``."""

    def get(self, path: str) -> Column:
        return F.try_variant_get("v", f"$.{path}", "variant")

    def kind(self, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(self.get(path)), F.lit("VOID"))

    def given(self, path: str) -> Column:
        """Present, and neither null, false, zero nor empty."""
        empty = F.coalesce(F.to_json(self.get(path)), F.lit("null")).isin("null", '""', "false", "0", "0.0", "[]", "{}")
        return ~empty

    def text(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", F.try_variant_get("v", f"$.{path}", "string"))

    def one_of(self, path: str, known: tuple[str, ...]) -> Column:
        return F.coalesce(self.text(path).isin(*known), F.lit(False))

    def unknown(self, path: str, known: tuple[str, ...]) -> Column:
        return self.given(path) & ~self.one_of(path, known)

    def is_id(self, path: str, field: str) -> Column:
        return F.coalesce(self.text(path).rlike(f"^{PREFIXES[field]}_[0-9a-f]{{12}}$"), F.lit(False))

    def an_object(self, path: str) -> Column:
        return F.startswith(self.kind(path), F.lit("OBJECT"))

    def listed(self, path: str) -> Column:
        """An array that is not empty."""
        return self.get(path + "[0]").isNotNull()

    def no_time(self, path: str) -> Column:
        return self.given(path) & parse_time(self.text(path)).isNull()


def _rules(kind: str) -> list[tuple[str, str, Column]]:
    """(check, field, whether it fails) for artifacts of a kind."""
    f = _Fields()
    own = REQUIRED[kind][0]
    rules = [("required_field", name, f.kind(name) == "VOID") for name in REQUIRED[kind]]
    rules += [("artifact_type", "artifact_type", ~f.one_of("artifact_type", (kind,))), ("id_format", own, ~f.is_id(own, own))]
    if kind == "claim_assertion":
        basis = f.an_object("basis")
        rules += [
            ("unknown_value", "claim_type", f.unknown("claim_type", CLAIM_TYPES)),
            ("text_length", "claim_text", F.coalesce(F.length(f.text("claim_text")) > MOST_TEXT, F.lit(False))),
            ("unknown_value", "basis.basis_type", basis & f.unknown("basis.basis_type", BASIS_TYPES)),
            ("unknown_value", "basis.proof_tier_at_assertion", basis & f.unknown("basis.proof_tier_at_assertion", PROOF_TIERS)),
            ("empty_refs", "basis.basis_refs", basis & ~f.listed("basis.basis_refs")),
            ("id_format", "parent_claim_id", (f.kind("parent_claim_id") != "VOID") & ~f.is_id("parent_claim_id", "claim_id")),
            ("timestamp", "timestamp", f.no_time("timestamp")),
        ]
    elif kind == "claim_support_change":
        prior, new = "prior_support_status", "new_support_status"
        moves = F.lit(False)
        for a, to in MOVES.items():
            moves = moves | (f.one_of(prior, (a,)) & f.one_of(new, to) if to else F.lit(False))
        rules += [
            ("id_format", "claim_id", f.given("claim_id") & ~f.is_id("claim_id", "claim_id")),
            ("unknown_value", prior, f.unknown(prior, SUPPORT)),
            ("unknown_value", new, f.unknown(new, SUPPORT)),
            ("transition", new, f.one_of(prior, SUPPORT) & f.one_of(new, SUPPORT) & ~moves),
            ("unknown_value", "change_type", f.unknown("change_type", CHANGE_TYPES)),
            ("needed", "contradiction_id", f.one_of("change_type", ("contradiction_registered", "contradiction_resolved")) & ~f.given("contradiction_id")),
            ("needed", "decision_receipt_id", f.one_of("change_type", ("governance_decision",)) & ~f.given("decision_receipt_id")),
            ("empty_refs", "evidence_refs", f.one_of(new, ("SUPPORTED",)) & ~f.listed("evidence_refs")),
            ("timestamp", "timestamp", f.no_time("timestamp")),
        ]
    elif kind == "contradiction_registration":
        a, b, found = "claim_a_id", "claim_b_id", f.an_object("detection")
        sure = "detection.detection_confidence"
        number = f.kind(sure).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
        both = f.given(a) & f.given(b)
        rules += [
            ("id_format", a, f.given(a) & ~f.is_id(a, "claim_id")),
            ("id_format", b, f.given(b) & ~f.is_id(b, "claim_id")),
            ("same_claim", b, both & F.coalesce(f.text(a) == f.text(b), F.lit(False))),
            ("order", b, both & F.coalesce(f.text(a) > f.text(b), F.lit(False))),
            ("unknown_value", "conflict_type", f.unknown("conflict_type", CONFLICT_TYPES)),
            ("unknown_value", "severity", f.unknown("severity", SEVERITIES)),
            ("unknown_value", "detection.detection_method", found & f.unknown("detection.detection_method", DETECTION_METHODS)),
            ("range", sure, found & (f.kind(sure) != "VOID") & ~(number & F.coalesce(F.try_variant_get("v", f"$.{sure}", "double").between(0.0, 1.0), F.lit(False)))),
            ("empty_refs", "detection.detection_evidence_refs", found & ~f.listed("detection.detection_evidence_refs")),
        ]
    else:
        outcome, basis = "resolution_outcome", f.an_object("resolution_basis")
        rules += [
            ("id_format", "contradiction_id", f.given("contradiction_id") & ~f.is_id("contradiction_id", "contradiction_id")),
            ("unknown_value", outcome, f.unknown(outcome, OUTCOMES)),
            ("needed", "superseding_claim_id", f.one_of(outcome, ("reconciled",)) & ~f.given("superseding_claim_id")),
            ("empty_refs", "resolution_basis.evidence_refs", f.one_of(outcome, ("claim_a_prevails", "claim_b_prevails")) & basis & ~f.listed("resolution_basis.evidence_refs")),
            ("unknown_value", "resolution_basis.authority_type", basis & f.unknown("resolution_basis.authority_type", AUTHORITIES)),
        ]
    return rules


def artifact_rules(artifacts: DataFrame, key: str = "line_no") -> DataFrame:
    """(key, kind, artifact_id, check, field): every rule of its kind that an artifact breaks.

    artifacts: key, kind (the verifier that it is given to), raw (its JSON). Fields are read by their JSON types: what is not a text is
    no known value and no id. A null, unreadable or other than an object breaks ``unreadable`` alone; an unknown kind ``unknown_kind``.
    An artifact without a readable id is ``<unknown>``. No shuffle: each row is judged by itself."""
    rows = artifacts.select(key, "kind", F.try_parse_json("raw").alias("v"))
    readable = F.startswith(F.coalesce(F.schema_of_variant("v"), F.lit("")), F.lit("OBJECT"))
    hit = lambda check, field: F.struct(F.lit(check).alias("check"), F.lit(field).alias("field"))
    broken, name = F.array(hit("unknown_kind", "")), F.lit(None).cast("string")
    for kind in REQUIRED:
        mine = F.col("kind") == kind
        broken = F.when(mine, F.array_compact(F.array(*[F.when(fails, hit(check, field)) for check, field, fails in _rules(kind)]))).otherwise(broken)
        name = F.when(mine, _Fields().text(REQUIRED[kind][0])).otherwise(name)
    broken = F.when(F.col("kind").isin(*REQUIRED) & ~readable, F.array(hit("unreadable", ""))).otherwise(broken)
    return rows.select(key, "kind", F.coalesce(name, F.lit("<unknown>")).alias("artifact_id"), F.explode(broken).alias("b")).select(key, "kind", "artifact_id", "b.check", "b.field")


def _not_first(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows after the first of each group in the order of their lines; the first line is aggregated before the shuffle."""
    return rows.join(rows.groupBy(*by).agg(F.min("line_no").alias("first")), by).where("line_no > first")


def chain_findings(assertions: DataFrame, changes: DataFrame, contradictions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(chain_id, artifact_id, check, severity): what is wrong between the artifacts of each chain.

    All: chain_id, line_no (unique in its table and chain), ts (a timestamp, null if there is none or it can't be read).
    assertions: claim_id, parent_claim_id. changes: change_id, claim_id, prior_status, new_status, change_type,
    contradiction_id. contradictions: contradiction_id, claim_a_id, claim_b_id. resolutions: resolution_id,
    contradiction_id, outcome, superseding_claim_id. Null ids are empty ones. Of artifacts with one id the last line
    counts, and each after the first is a finding. Times that are missing break no order. Errors, but for a resolved
    contradiction whose losing claim shows no change: that is a warning. What is looked up has one row a key, so a claim
    that many refer to is only a skewed join, which is split at run time."""
    ids = ("claim_id", "parent_claim_id", "change_id", "contradiction_id", "claim_a_id", "claim_b_id", "resolution_id", "superseding_claim_id")
    full = lambda d, *names: d.select("chain_id", "line_no", "ts", *[F.coalesce(c, F.lit("")).alias(c) if c in ids else c for c in names])
    a, r = full(assertions, "claim_id", "parent_claim_id"), full(resolutions, "resolution_id", "contradiction_id", "outcome", "superseding_claim_id")
    s = full(changes, "change_id", "claim_id", "prior_status", "new_status", "change_type", "contradiction_id")
    c = full(contradictions, "contradiction_id", "claim_a_id", "claim_b_id")
    last = lambda d, key, *more: d.groupBy("chain_id", key).agg(*[F.max_by(m, "line_no").alias("known_" + m) for m in ("ts", *more)], F.lit(True).alias("known"))
    claims, cases = last(a, "claim_id"), last(c, "contradiction_id", "claim_a_id", "claim_b_id")
    to_claim = lambda d, ref: d.join(claims.withColumnRenamed("claim_id", ref), ["chain_id", ref], "left")
    found = lambda d, name, check, severity="error": d.select("chain_id", F.col(name).alias("artifact_id"), F.lit(check).alias("check"), F.lit(severity).alias("severity"))
    unknown, early = F.col("known").isNull(), F.col("ts") < F.col("known_ts")

    parents = to_claim(a.where("parent_claim_id <> ''"), "parent_claim_id")
    out = [
        found(_not_first(a, ["chain_id", "claim_id"]), "claim_id", "duplicate_claim_id"),
        found(_not_first(c, ["chain_id", "contradiction_id"]), "contradiction_id", "duplicate_contradiction_id"),
        found(parents.where(unknown), "claim_id", "parent_claim_exists"),
        found(parents.where(early), "claim_id", "parent_backward_ref"),
    ]
    lost = s.groupBy("chain_id", "claim_id").agg(F.min_by("change_id", "line_no").alias("change_id"))
    out.append(found(lost.join(claims, ["chain_id", "claim_id"], "left_anti"), "change_id", "support_change_claim_exists"))
    pair = lambda name: F.struct("chain_id", name).alias(name)
    steps = support_chain(a.select(pair("claim_id"), "ts", "line_no"), s.select(pair("claim_id"), pair("change_id"), "ts", "prior_status", "new_status"))
    out.append(steps.where("check <> 'claim_exists'").select("change_id.chain_id", F.col("change_id.change_id").alias("artifact_id"), F.concat(F.lit("support_"), "check").alias("check"), F.lit("error").alias("severity")))
    cited = s.where("change_type in ('contradiction_registered', 'contradiction_resolved') and contradiction_id <> ''")
    out.append(found(cited.join(cases, ["chain_id", "contradiction_id"], "left_anti"), "change_id", "contradiction_ref_exists"))
    for side in ("claim_a", "claim_b"):
        rows = to_claim(c, side + "_id")
        out += [found(rows.where(unknown), "contradiction_id", f"contradiction_{side}_exists"), found(rows.where(early), "contradiction_id", f"contradiction_{side}_backward")]
    settled = r.where(F.col("outcome").isin(*[o for o in OUTCOMES if o != "deferred"])).select("chain_id", "contradiction_id").distinct()
    still = c.where("claim_a_id <> '' and claim_b_id <> ''").join(settled, ["chain_id", "contradiction_id"], "left_anti")
    out.append(found(_not_first(still, ["chain_id", "claim_a_id", "claim_b_id"]), "contradiction_id", "contradiction_dedup"))
    answered = r.join(cases, ["chain_id", "contradiction_id"], "left")
    out += [found(answered.where(unknown), "resolution_id", "resolution_contradiction_exists"), found(answered.where(early), "resolution_id", "resolution_after_registration")]
    new = r.where("outcome = 'reconciled' and superseding_claim_id <> ''").withColumn("claim_id", F.col("superseding_claim_id"))
    out.append(found(new.join(claims, ["chain_id", "claim_id"], "left_anti"), "resolution_id", "resolution_superseding_claim"))
    loser = F.when(F.col("outcome") == "claim_a_prevails", F.col("known_claim_b_id")).when(F.col("outcome") == "claim_b_prevails", F.col("known_claim_a_id"))
    lost = answered.where("known").withColumn("claim_id", loser).where("claim_id is not null")
    told = s.where("change_type = 'contradiction_resolved'").select("chain_id", "claim_id", "contradiction_id").distinct()
    out.append(found(lost.join(told, ["chain_id", "claim_id", "contradiction_id"], "left_anti"), "resolution_id", "resolution_support_consistency", "warning"))
    total = out[0]
    for d in out[1:]:
        total = total.union(d)
    return total


def chain_verdicts(chains: DataFrame, findings: DataFrame) -> DataFrame:
    """(chain_id, passed, errors, warnings) of every chain (chain_id)."""
    counts = findings.groupBy("chain_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = chains.select("chain_id").distinct().join(counts, "chain_id", "left").fillna(0, ["errors", "warnings"])
    return rows.select("chain_id", (F.col("errors") == 0).alias("passed"), "errors", "warnings")
