"""Registered queries: items as claim artifacts, and as the artifacts of each supplier's chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import settle
from ..operators import claim_artifacts
from .views import table

# Texts of artifacts, in expressions that Spark and the SQL both read: p, u and k are an item's part, supplier and order.
_ID = "substr(md5(cast({} as string)), 1, 12)"
_TIME = """CASE p % 7 WHEN 0 THEN '"2024-01-05T10:00:00Z"' WHEN 1 THEN '"yesterday"' WHEN 2 THEN 'null' ELSE '"2024-02-05T10:00:00+00:00"' END"""
_HEAD = """'","artifact_type":"' || CASE WHEN p % 31 = 4 THEN 'claim' ELSE kind END || '","schema_version":' || CASE WHEN p % 37 = 4 THEN 'null' ELSE '1' END || ',"timestamp":' || """ + _TIME + """ || ',"episode_id":"e"'"""
_RAW = {
    "claim_assertion": f"""'{{"claim_id":"' || CASE WHEN p % 29 = 4 THEN 'clm_XYZ' ELSE 'clm_' || {_ID.format("k")} END || {_HEAD} || ',"claim_text":"' || CASE WHEN p % 17 = 4 THEN repeat('long ', 101) ELSE 'short' END || '","claim_type":' || CASE p % 5 WHEN 0 THEN '"FACTUAL"' WHEN 1 THEN '"POLICY"' WHEN 2 THEN '"guess"' WHEN 3 THEN '7' ELSE '""' END
      || ',"checkable":false,"basis":' || CASE k % 6 WHEN 0 THEN '"text"' WHEN 1 THEN '{{"basis_type":"rumour","basis_refs":["a"]}}' WHEN 2 THEN '{{"basis_type":"extracted","basis_refs":[]}}' WHEN 3 THEN '{{"proof_tier_at_assertion":"checked","basis_refs":"a"}}' ELSE '{{"basis_type":"extracted","proof_tier_at_assertion":"CHECKED","basis_refs":["a",null]}}' END
      || CASE u % 4 WHEN 0 THEN ',"parent_claim_id":null' WHEN 1 THEN ',"parent_claim_id":"x"' WHEN 2 THEN ',"parent_claim_id":"clm_' || {_ID.format("p")} || '"' ELSE '' END || '}}'""",
    "claim_support_change": f"""'{{"change_id":"' || CASE WHEN p % 29 = 4 THEN 'csc_' ELSE 'csc_' || {_ID.format("k")} END || {_HEAD} || ',"claim_id":"' || CASE WHEN u % 5 = 4 THEN 'c' ELSE 'clm_' || {_ID.format("p")} END || '","prior_support_status":"' || CASE p % 6 WHEN 0 THEN 'ASSERTED' WHEN 1 THEN 'SUPPORTED' WHEN 2 THEN 'WEAKENED' WHEN 3 THEN 'CONTRADICTED' WHEN 4 THEN 'RETRACTED' ELSE 'open' END
      || '","new_support_status":"' || CASE k % 6 WHEN 0 THEN 'ASSERTED' WHEN 1 THEN 'SUPPORTED' WHEN 2 THEN 'WEAKENED' WHEN 3 THEN 'CONTRADICTED' WHEN 4 THEN 'RETRACTED' ELSE '' END || '","change_type":"' || CASE u % 6 WHEN 0 THEN 'evidence_added' WHEN 1 THEN 'contradiction_registered' WHEN 2 THEN 'governance_decision' WHEN 3 THEN 'retraction' WHEN 4 THEN 'contradiction_resolved' ELSE 'other' END
      || '"' || CASE p % 4 WHEN 0 THEN ',"contradiction_id":"ctr_1"' WHEN 1 THEN ',"decision_receipt_id":"r"' WHEN 2 THEN ',"contradiction_id":""' ELSE '' END || ',"evidence_refs":' || CASE p % 5 WHEN 0 THEN '[]' WHEN 1 THEN 'null' ELSE '["a"]' END || '}}'""",
    "contradiction_registration": f"""'{{"contradiction_id":"' || CASE WHEN p % 29 = 4 THEN 'ctr_0' ELSE 'ctr_' || {_ID.format("k")} END || {_HEAD} || ',"claim_a_id":"clm_' || {_ID.format("p % 9")} || CASE WHEN u % 7 = 4 THEN '0' ELSE '' END || '","claim_b_id":"clm_' || {_ID.format("k % 9")} || '","conflict_type":"' || CASE WHEN u % 3 = 0 THEN 'quarrel' ELSE 'direct_negation' END || '","severity":' || CASE p % 3 WHEN 0 THEN '"high"' WHEN 1 THEN '"severe"' ELSE 'null' END
      || ',"detection":' || CASE k % 6 WHEN 0 THEN '[]' WHEN 1 THEN '{{"detection_method":"luck","detection_confidence":0.5,"detection_evidence_refs":["a"]}}' WHEN 2 THEN '{{"detection_method":"opa_policy","detection_confidence":1.5}}' WHEN 3 THEN '{{"detection_confidence":"high","detection_evidence_refs":["a"]}}' WHEN 4 THEN '{{"detection_confidence":-1,"detection_evidence_refs":[]}}' ELSE '{{"detection_confidence":1,"detection_evidence_refs":[1]}}' END || '}}'""",
    "contradiction_resolution": f"""'{{"resolution_id":"' || CASE WHEN p % 29 = 4 THEN 'crr' ELSE 'crr_' || {_ID.format("k")} END || {_HEAD} || ',"contradiction_id":"' || CASE WHEN u % 5 = 4 THEN 'c' ELSE 'ctr_' || {_ID.format("p")} END || '","resolution_outcome":"' || CASE k % 6 WHEN 0 THEN 'claim_a_prevails' WHEN 1 THEN 'claim_b_prevails' WHEN 2 THEN 'reconciled' WHEN 3 THEN 'deferred' WHEN 4 THEN 'draw' ELSE 'out_of_scope' END || '"' || CASE WHEN p % 3 = 0 THEN ',"superseding_claim_id":"s"' ELSE '' END
      || ',"resolution_basis":' || CASE p % 4 WHEN 0 THEN '{{"authority_type":"coin"}}' WHEN 1 THEN '{{"authority_type":"human_judgment","evidence_refs":["a"]}}' WHEN 2 THEN '{{"evidence_refs":{{}}}}' ELSE 'null' END || CASE WHEN p % 41 = 4 THEN '' ELSE '}}' END""",
}
_KINDS = tuple(_RAW)
_KIND = "CASE n % 4 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_TEXT = "CASE n % 4 " + " ".join(f"WHEN {i} THEN {_RAW[k]}" for i, k in enumerate(_KINDS)) + " END"
# Artifacts of chains, likewise; times are seconds.
_TS = "CASE WHEN p % 11 = 4 THEN NULL ELSE k END"
_CHAINS = {
    "a": f"chain_id, line_no, {_TS} AS ts, 'c' || (p % 150) AS claim_id, CASE WHEN p % 3 = 0 THEN 'c' || (p % 170) WHEN p % 5 = 0 THEN '' END AS parent_claim_id",
    "s": f"chain_id, line_no, {_TS} AS ts, 'x' || line_no AS change_id, CASE WHEN p % 43 <> 4 THEN 'c' || (p % 155) END AS claim_id, CASE p % 5 WHEN 0 THEN 'ASSERTED' WHEN 1 THEN 'SUPPORTED' WHEN 2 THEN 'WEAKENED' WHEN 3 THEN 'RETRACTED' END AS prior_status, CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN 'RETRACTED' WHEN 2 THEN 'WEAKENED' WHEN 3 THEN NULL ELSE 'SUPPORTED' END AS new_status, CASE p % 3 WHEN 0 THEN 'contradiction_registered' WHEN 1 THEN 'contradiction_resolved' ELSE 'retraction' END AS change_type, CASE WHEN k % 5 > 0 THEN 'd' || (p % 60) END AS contradiction_id",
    "c": f"chain_id, line_no, {_TS} AS ts, 'd' || (p % 50) AS contradiction_id, 'c' || (p % 140) AS claim_a_id, CASE WHEN k % 13 <> 4 THEN 'c' || (k % 3 * 50) END AS claim_b_id",
    "r": f"chain_id, line_no, {_TS} AS ts, 'r' || line_no AS resolution_id, 'd' || (p % 55) AS contradiction_id, CASE k % 5 WHEN 0 THEN 'claim_a_prevails' WHEN 1 THEN 'claim_b_prevails' WHEN 2 THEN 'reconciled' ELSE 'deferred' END AS outcome, CASE WHEN p % 4 > 0 THEN 'c' || (p % 170) END AS superseding_claim_id",
}


def claim_artifact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as one artifact; how many break each rule."""
    i = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS p", "l_suppkey AS u", "l_orderkey AS k", "l_linenumber AS n")
    raw = i.selectExpr("p", "u", "k", "n", f"{_KIND} AS kind").selectExpr("k * 10 + n AS line_no", "kind", f"{_TEXT} AS raw")
    found = claim_artifacts.artifact_rules(raw)
    return found.groupBy("kind", "check", "field").agg(F.count("*").alias("n"), F.sum("line_no").alias("lines"), F.countDistinct("artifact_id").alias("artifacts"))


def _chain_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    i = table(spark, sf_dir, "lineitem")
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    # written, as each table of it is read for many joins
    base = settle(i.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("chain_id"), line.alias("line_no")).agg(F.min("l_partkey").alias("p"), F.min("l_orderkey").alias("k"), F.min("l_linenumber").alias("n")))
    return {t: base.where(f"n % 4 = {m}").selectExpr(*_split(text)).withColumn("ts", F.timestamp_seconds("ts")) for m, (t, text) in enumerate(_CHAINS.items())}


def _split(text: str) -> list[str]:
    """The columns of a list of expressions; none holds a comma."""
    return text.split(", ")


def claim_chain_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's items are the artifacts of one chain."""
    return claim_artifacts.chain_findings(*_chain_tables(spark, sf_dir).values())


def claim_chain_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every supplier's chain."""
    chains = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("chain_id"))
    return claim_artifacts.chain_verdicts(chains, claim_chain_findings(spark, sf_dir))


QUERIES = {f.__name__: f for f in (claim_artifact_rules, claim_chain_findings, claim_chain_verdicts)}


def _none(f: str) -> str:
    return f"coalesce(json_type(j, '$.{f}'), 'NULL') = 'NULL'"


def _str(f: str) -> str:
    return f"(CASE WHEN json_type(j, '$.{f}') = 'VARCHAR' THEN json_extract_string(j, '$.{f}') END)"


def _given(f: str) -> str:
    return f"""coalesce(CAST(json_extract(j, '$.{f}') AS VARCHAR), 'null') NOT IN ('null', '""', 'false', '0', '[]', '{{}}')"""


def _bad(f: str, known: str) -> str:
    return f"{_given(f)} AND NOT coalesce(list_contains(string_split('{known}', ' '), {_str(f)}), FALSE)"


def _no_id(f: str, prefix: str) -> str:
    return f"NOT coalesce(regexp_full_match({_str(f)}, '{prefix}_[0-9a-f]{{12}}'), FALSE)"


def _bare(f: str) -> str:
    return f"json_extract(j, '$.{f}[0]') IS NULL"


def _object(f: str) -> str:
    return f"json_type(j, '$.{f}') = 'OBJECT'"


_LATE = f"{_given('timestamp')} AND NOT coalesce(regexp_matches({_str('timestamp')}, '^\\d{{4}}-\\d\\d-\\d\\d'), FALSE)"
_SUPPORT = "ASSERTED SUPPORTED WEAKENED CONTRADICTED RETRACTED"
_MOVES = "ASSERTED>SUPPORTED ASSERTED>WEAKENED ASSERTED>CONTRADICTED ASSERTED>RETRACTED SUPPORTED>WEAKENED SUPPORTED>CONTRADICTED SUPPORTED>RETRACTED WEAKENED>SUPPORTED WEAKENED>CONTRADICTED WEAKENED>RETRACTED CONTRADICTED>SUPPORTED CONTRADICTED>WEAKENED CONTRADICTED>RETRACTED"
_CHECKS = [
    ("claim_assertion", "unknown_value", "claim_type", _bad("claim_type", "FACTUAL CODE_OUTPUT CONSTRAINT POLICY SYNTHESIS")),
    ("claim_assertion", "text_length", "claim_text", f"length({_str('claim_text')}) > 500"),
    ("claim_assertion", "unknown_value", "basis.basis_type", f"{_object('basis')} AND " + _bad("basis.basis_type", "extracted policy_declared governance_inferred human_asserted")),
    ("claim_assertion", "unknown_value", "basis.proof_tier_at_assertion", f"{_object('basis')} AND " + _bad("basis.proof_tier_at_assertion", "DRAFT CHECKED TOOL_VERIFIED ADVERSARIAL CONSTITUTIONAL")),
    ("claim_assertion", "empty_refs", "basis.basis_refs", f"{_object('basis')} AND {_bare('basis.basis_refs')}"),
    ("claim_assertion", "id_format", "parent_claim_id", f"NOT ({_none('parent_claim_id')}) AND {_no_id('parent_claim_id', 'clm')}"),
    ("claim_assertion", "timestamp", "timestamp", _LATE),
    ("claim_support_change", "id_format", "claim_id", f"{_given('claim_id')} AND {_no_id('claim_id', 'clm')}"),
    ("claim_support_change", "unknown_value", "prior_support_status", _bad("prior_support_status", _SUPPORT)),
    ("claim_support_change", "unknown_value", "new_support_status", _bad("new_support_status", _SUPPORT)),
    ("claim_support_change", "transition", "new_support_status", f"list_contains(string_split('{_SUPPORT}', ' '), {_str('prior_support_status')}) AND list_contains(string_split('{_SUPPORT}', ' '), {_str('new_support_status')}) AND NOT list_contains(string_split('{_MOVES}', ' '), {_str('prior_support_status')} || '>' || {_str('new_support_status')})"),
    ("claim_support_change", "unknown_value", "change_type", _bad("change_type", "evidence_added evidence_removed verification_passed verification_failed verification_inconclusive contradiction_registered contradiction_resolved governance_decision retraction")),
    ("claim_support_change", "needed", "contradiction_id", f"starts_with({_str('change_type')}, 'contradiction_') AND NOT ({_given('contradiction_id')})"),
    ("claim_support_change", "needed", "decision_receipt_id", f"{_str('change_type')} = 'governance_decision' AND NOT ({_given('decision_receipt_id')})"),
    ("claim_support_change", "empty_refs", "evidence_refs", f"{_str('new_support_status')} = 'SUPPORTED' AND {_bare('evidence_refs')}"),
    ("claim_support_change", "timestamp", "timestamp", _LATE),
    ("contradiction_registration", "id_format", "claim_a_id", _no_id("claim_a_id", "clm")),
    ("contradiction_registration", "id_format", "claim_b_id", _no_id("claim_b_id", "clm")),
    ("contradiction_registration", "same_claim", "claim_b_id", f"{_str('claim_a_id')} = {_str('claim_b_id')}"),
    ("contradiction_registration", "order", "claim_b_id", f"{_str('claim_a_id')} > {_str('claim_b_id')}"),
    ("contradiction_registration", "unknown_value", "conflict_type", _bad("conflict_type", "direct_negation inconsistent_evidence policy_conflict temporal_inconsistency scope_overlap")),
    ("contradiction_registration", "unknown_value", "severity", _bad("severity", "critical high medium low")),
    ("contradiction_registration", "unknown_value", "detection.detection_method", f"{_object('detection')} AND " + _bad("detection.detection_method", "automated_verification semantic_similarity opa_policy human_identified cross_episode")),
    ("contradiction_registration", "range", "detection.detection_confidence", f"{_object('detection')} AND NOT ({_none('detection.detection_confidence')}) AND NOT coalesce(TRY_CAST(CAST(json_extract(j, '$.detection.detection_confidence') AS VARCHAR) AS DOUBLE) BETWEEN 0 AND 1, FALSE)"),
    ("contradiction_registration", "empty_refs", "detection.detection_evidence_refs", f"{_object('detection')} AND {_bare('detection.detection_evidence_refs')}"),
    ("contradiction_resolution", "id_format", "contradiction_id", _no_id("contradiction_id", "ctr")),
    ("contradiction_resolution", "unknown_value", "resolution_outcome", _bad("resolution_outcome", "claim_a_prevails claim_b_prevails both_retracted reconciled out_of_scope deferred")),
    ("contradiction_resolution", "needed", "superseding_claim_id", f"{_str('resolution_outcome')} = 'reconciled' AND NOT ({_given('superseding_claim_id')})"),
    ("contradiction_resolution", "empty_refs", "resolution_basis.evidence_refs", f"ends_with({_str('resolution_outcome')}, '_prevails') AND {_object('resolution_basis')} AND {_bare('resolution_basis.evidence_refs')}"),
    ("contradiction_resolution", "unknown_value", "resolution_basis.authority_type", f"{_object('resolution_basis')} AND " + _bad("resolution_basis.authority_type", "automated_verification governance_decision human_judgment new_evidence policy_update")),
]
_OWN = {"claim_assertion": ("claim_id", "clm"), "claim_support_change": ("change_id", "csc"), "contradiction_registration": ("contradiction_id", "ctr"), "contradiction_resolution": ("resolution_id", "crr")}
_BROKEN = ", ".join(
    [f"CASE WHEN kind = '{k}' AND {_none(f)} THEN {{'check': 'required_field', 'field': '{f}'}} END" for k, fields in claim_artifacts.REQUIRED.items() for f in fields]
    + [f"CASE WHEN coalesce({_str('artifact_type')}, '') <> kind THEN {{'check': 'artifact_type', 'field': 'artifact_type'}} END"]
    + [f"CASE WHEN kind = '{k}' AND {_no_id(f, x)} THEN {{'check': 'id_format', 'field': '{f}'}} END" for k, (f, x) in _OWN.items()]
    + [f"CASE WHEN kind = '{k}' AND {when} THEN {{'check': '{check}', 'field': '{f}'}} END" for k, check, f, when in _CHECKS]
)
_FINDINGS = (
    "WITH b AS (SELECT 's' || l_suppkey AS chain_id, l_orderkey * 10 + l_linenumber AS line_no, min(l_partkey) AS p, min(l_orderkey) AS k, min(l_linenumber) AS n FROM lineitem GROUP BY ALL)"
    + "".join(f", {t} AS (SELECT {text} FROM b WHERE n % 4 = {m})" for m, (t, text) in enumerate(_CHAINS.items()))
    + """
, ka AS (SELECT DISTINCT ON (chain_id, claim_id) chain_id, claim_id, ts FROM a ORDER BY line_no DESC
), kc AS (SELECT DISTINCT ON (chain_id, contradiction_id) * FROM c ORDER BY line_no DESC
), w AS (
  SELECT *, coalesce(claim_id, '') AS cl, coalesce(last_value(nullif(new_status, '') IGNORE NULLS) OVER (PARTITION BY chain_id, coalesce(claim_id, '') ORDER BY ts NULLS FIRST, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'ASSERTED') AS expected FROM s
), e AS (
  SELECT chain_id, claim_id AS artifact_id, 'duplicate_claim_id' AS "check" FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, claim_id ORDER BY line_no) AS nth FROM a) WHERE nth > 1
  UNION ALL SELECT chain_id, contradiction_id, 'duplicate_contradiction_id' FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, contradiction_id ORDER BY line_no) AS nth FROM c) WHERE nth > 1
  UNION ALL SELECT a.chain_id, a.claim_id, 'parent_claim_exists' FROM a LEFT JOIN ka ON ka.chain_id = a.chain_id AND ka.claim_id = parent_claim_id WHERE parent_claim_id <> '' AND ka.claim_id IS NULL
  UNION ALL SELECT a.chain_id, a.claim_id, 'parent_backward_ref' FROM a JOIN ka ON ka.chain_id = a.chain_id AND ka.claim_id = parent_claim_id WHERE a.ts < ka.ts
  UNION ALL SELECT chain_id, arg_min(change_id, line_no), 'support_change_claim_exists' FROM w WHERE NOT EXISTS (SELECT 1 FROM ka WHERE ka.chain_id = w.chain_id AND ka.claim_id = cl) GROUP BY chain_id, cl
  UNION ALL SELECT w.chain_id, change_id, 'support_after_assertion' FROM w JOIN ka ON ka.chain_id = w.chain_id AND ka.claim_id = cl WHERE w.ts < ka.ts
  UNION ALL SELECT chain_id, change_id, 'support_prior_mismatch' FROM w WHERE prior_status IS DISTINCT FROM expected
  UNION ALL SELECT chain_id, change_id, 'support_retracted_terminal' FROM w WHERE expected = 'RETRACTED'
  UNION ALL SELECT chain_id, change_id, 'contradiction_ref_exists' FROM s WHERE starts_with(change_type, 'contradiction_') AND contradiction_id <> '' AND NOT EXISTS (SELECT 1 FROM kc WHERE kc.chain_id = s.chain_id AND kc.contradiction_id = s.contradiction_id)
  UNION ALL SELECT chain_id, contradiction_id, 'contradiction_claim_a_exists' FROM c WHERE NOT EXISTS (SELECT 1 FROM ka WHERE ka.chain_id = c.chain_id AND ka.claim_id = claim_a_id)
  UNION ALL SELECT chain_id, contradiction_id, 'contradiction_claim_b_exists' FROM c WHERE NOT EXISTS (SELECT 1 FROM ka WHERE ka.chain_id = c.chain_id AND ka.claim_id = claim_b_id)
  UNION ALL SELECT c.chain_id, contradiction_id, 'contradiction_claim_a_backward' FROM c JOIN ka ON ka.chain_id = c.chain_id AND ka.claim_id = claim_a_id WHERE c.ts < ka.ts
  UNION ALL SELECT c.chain_id, contradiction_id, 'contradiction_claim_b_backward' FROM c JOIN ka ON ka.chain_id = c.chain_id AND ka.claim_id = claim_b_id WHERE c.ts < ka.ts
  UNION ALL SELECT chain_id, contradiction_id, 'contradiction_dedup' FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, claim_a_id, claim_b_id ORDER BY line_no) AS nth FROM c WHERE claim_b_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.chain_id = c.chain_id AND r.contradiction_id = c.contradiction_id AND outcome <> 'deferred')) WHERE nth > 1
  UNION ALL SELECT chain_id, resolution_id, 'resolution_contradiction_exists' FROM r WHERE NOT EXISTS (SELECT 1 FROM kc WHERE kc.chain_id = r.chain_id AND kc.contradiction_id = r.contradiction_id)
  UNION ALL SELECT r.chain_id, resolution_id, 'resolution_after_registration' FROM r JOIN kc USING (chain_id, contradiction_id) WHERE r.ts < kc.ts
  UNION ALL SELECT chain_id, resolution_id, 'resolution_superseding_claim' FROM r WHERE outcome = 'reconciled' AND superseding_claim_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ka WHERE ka.chain_id = r.chain_id AND ka.claim_id = superseding_claim_id)
), l AS (
  SELECT chain_id, resolution_id, r.contradiction_id, coalesce(CASE outcome WHEN 'claim_a_prevails' THEN claim_b_id ELSE claim_a_id END, '') AS loser FROM r JOIN kc USING (chain_id, contradiction_id) WHERE outcome IN ('claim_a_prevails', 'claim_b_prevails')
), found AS (
  SELECT *, 'error' AS severity FROM e
  UNION ALL SELECT chain_id, resolution_id, 'resolution_support_consistency', 'warning' FROM l WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.chain_id = l.chain_id AND cl = loser AND w.contradiction_id = l.contradiction_id AND change_type = 'contradiction_resolved')
)
"""
)
ORACLES = {
    "claim_artifact_rules": f"""
WITH i AS (SELECT l_partkey AS p, l_suppkey AS u, l_orderkey AS k, l_linenumber AS n FROM lineitem
), t AS (SELECT *, {_KIND} AS kind FROM i
), x AS (SELECT k * 10 + n AS line_no, kind, {_TEXT} AS raw FROM t
), y AS (SELECT line_no, kind, json_valid(raw) AS ok, TRY_CAST(CASE WHEN json_valid(raw) THEN raw END AS JSON) AS j FROM x
), f AS (
  SELECT line_no, kind, coalesce(CASE kind {" ".join(f"WHEN '{k}' THEN {_str(f)}" for k, (f, _) in _OWN.items())} END, '<unknown>') AS artifact_id,
    unnest(CASE WHEN NOT ok THEN [{{'check': 'unreadable', 'field': ''}}] ELSE list_filter([{_BROKEN}], lambda b: b IS NOT NULL) END) AS b FROM y
)
SELECT kind, b."check" AS "check", b.field AS field, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS lines, count(DISTINCT artifact_id) AS artifacts FROM f GROUP BY ALL
""",
    "claim_chain_findings": _FINDINGS + "SELECT * FROM found",
    "claim_chain_verdicts": _FINDINGS
    + "SELECT 's' || s_suppkey AS chain_id, count_if(severity = 'error') = 0 AS passed, count_if(severity = 'error')::BIGINT AS errors, count_if(severity = 'warning')::BIGINT AS warnings FROM supplier LEFT JOIN found ON chain_id = 's' || s_suppkey GROUP BY s_suppkey",
}
