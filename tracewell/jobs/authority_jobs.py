"""Registered queries: orders as authority chains, whose artifacts are spoilt by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import authority
from .views import table

_TYPES = {n: t for n, t in (line.strip().split(" ", 1) for line in authority.ARTIFACT.replace("\n", " ").split(", "))}


def _name(letter: str, number: Column) -> Column:
    return F.concat(F.lit(letter), number)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min(F.col("l_shipdate").cast("date")).alias("l_shipdate"))
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    later = lambda n: F.date_format(F.date_add(day, n), "yyyy-MM-dd'T'00:00:00'Z'")
    many = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_linenumber").alias("lines"))
    many = many.select("o_orderkey", F.array_sort(F.transform("lines", lambda x: F.concat(F.lit("v"), "o_orderkey", F.lit("-"), x))).alias("verifier_receipt_refs"))
    # a chain is few bytes until its references are told apart, so its partitions must not be joined by size
    dealt = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    chains = dealt.join(many, "o_orderkey", "left").select(
        k.alias("chain_id"), F.date_add(day, 30).cast("timestamp").alias("at"), _name("m", k).alias("claim_ref"), F.when(k % 53 != 1, _name("n", k)).alias("normalization_receipt_ref"), _name("t", c % 7).alias("claim_type_ref"),
        _name("h", c % 11).alias("charter_clause_ref"), _name("l", c % 5).alias("invariant_library_ref"), F.when(k % 59 == 1, "").otherwise(_name("c", k)).alias("verifier_contract_ref"), _name("a", k).alias("adjudication_receipt_ref"),
        F.when(k % 47 != 2, _name("p", k)).alias("scope_composition_proof_ref"), F.when(k % 2 == 0, _name("x", k)).alias("action_receipt_ref"), F.when(k % 43 != 4, _name("r", k)).alias("rollback_contract_ref"),
        "verifier_receipt_refs", F.when(k % 61 == 5, F.array(_name("h", c % 11))).alias("revoked_artifact_refs"), (k % 67 != 3).alias("action_domain_authorized"), F.lit("B").alias("claim_tier"), F.when(k % 71 == 4, "C").when(k % 71 != 5, "A").otherwise("B").alias("evidence_tier"),
    )

    def made(df: DataFrame, ref: Column, who: Column, **own: Column) -> DataFrame:
        base = {"ref": ref, "schema_version": F.lit("1"), "canonical_hash": F.concat(F.lit("hash-"), ref), "signature": F.lit("s"), "signed_by": who, "role": who, "requires_log_inclusion": F.lit(True)} | own
        return df.select(*[base.get(n, F.lit(None)).cast(t).alias(n) for n, t in _TYPES.items()])

    yes = F.lit(True)
    candidates = F.array(F.struct(_name("t", c % 7).alias("claim_type_ref"), yes.alias("viable"), F.lit(5).cast("long").alias("strictness_rank")), F.struct(_name("t", (c + 1) % 7).alias("claim_type_ref"), (k % 37 == 6).alias("viable"), F.lit(9).cast("long").alias("strictness_rank")))
    shared = o.select(c).distinct()
    line, part, ship = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_shipdate")
    kind = F.concat(F.lit("k"), F.col("l_suppkey") % 3)
    parts = [
        made(o, _name("m", k), F.lit("claimant"), signature=F.when(k % 73 != 6, "s")),
        made(o, _name("n", k), F.lit("normalizer"), candidate_claim_types=candidates, selected=_name("t", F.when(k % 79 == 7, c + 2).otherwise(c) % 7), ambiguity_flag=k % 17 == 8, escalated=k % 34 == 8, selection_authority=F.when(k % 74 == 6, "charter_clause")),
        made(shared.select((c % 7).alias("i")).distinct(), _name("t", F.col("i")), F.lit("principal")),
        made(shared.select((c % 11).alias("i")).distinct(), _name("h", F.col("i")), F.lit("charter")),
        made(shared.select((c % 5).alias("i")).distinct(), _name("l", F.col("i")), F.lit("library")),
        made(o, _name("c", k), F.when(k % 83 == 9, "simulator").otherwise("compiler"), claim_type_ref=_name("t", c % 7), invariant_library_ref=_name("l", F.when(k % 89 == 9, c + 1).otherwise(c) % 5), compiled_by=F.when(k % 97 != 9, authority.COMPILER).otherwise("hand"), required_receipts=F.when(k % 3 == 0, F.array(F.lit("k0"))).otherwise(F.array().cast("array<string>"))),
        made(o, _name("a", k), F.when(k % 101 == 9, "simulator").otherwise("judge"), move=F.when(k % 103 == 9, "guess").otherwise("match"), truth_bearing_free_text=k % 107 == 9, claim_ref=_name("m", k), final=k % 5 == 0, earliest_adjudicable_at=F.when(k % 113 == 9, "soon").otherwise(later(25 + F.col("o_orderkey").cast("int") % 7))),
        made(o, _name("p", k), F.lit("composer"), monotone=k % 109 != 9, composite_scope_exceeds_union=k % 127 == 9),
        made(o, _name("x", k), F.lit("actor"), charter_allows_irreversible=k % 4 == 0),
        made(o, _name("r", k), F.lit("operator"), schema_version=F.when(k % 131 != 9, "1")),
        made(items.where("l_partkey % 199 <> 3"), F.concat(F.lit("v"), "l_orderkey", F.lit("-"), "l_linenumber"), F.when(part % 211 == 5, "compiler").otherwise(F.concat(F.lit("verifier"), line)), role=F.when(part % 223 == 5, "simulator").otherwise(F.concat(F.lit("verifier"), line)), contract_ref=_name("c", F.col("l_orderkey") + F.when(part % 227 == 5, 1).otherwise(0)), claim_ref=_name("m", F.col("l_orderkey")), question_shape=F.when(part % 229 != 5, "q"), receipt_kind=kind, scope_exceeds_contract=part % 233 == 5, refusal_at=F.when(part % 239 == 5, "never").otherwise(F.date_format(F.date_add(ship, 20 + (part % 300).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'"))),
    ]
    artifacts = parts[0]
    for more in parts[1:]:
        artifacts = artifacts.unionByName(more)
    every = F.concat(F.array(*[_name(x, k) for x in "mncapxr"]), F.array(_name("t", c % 7), _name("h", c % 11), _name("l", c % 5)), F.coalesce("verifier_receipt_refs", F.array().cast("array<string>")))
    code = (F.col("chain_id") * 13 + F.ascii("ref") + F.right("ref", F.lit(1)).cast("long")) % 500
    logged = dealt.join(many, "o_orderkey", "left").select(k.alias("chain_id"), F.explode(every).alias("ref")).where(code != 7)
    proofs = logged.select("chain_id", "ref", F.when(code == 8, "").otherwise("7").alias("log_index"), F.lit("t").alias("integrated_time"), F.when(code == 9, "other").when(code < 250, F.concat(F.lit("hash-"), "ref")).alias("body_hash"))
    revocations = shared.select((c % 11).alias("i")).distinct().where("i % 4 = 1").select(_name("h", F.col("i")).alias("ref"), F.lit("1997-01-01").cast("timestamp").alias("revoked_at"))
    return chains, artifacts, proofs, revocations


def chain_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority.findings(*_tables(spark, sf_dir)).select("chain_id", "reason", "ref")


def chain_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains, artifacts, proofs, revocations = _tables(spark, sf_dir)
    return authority.verdicts(chains, authority.findings(chains, artifacts, proofs, revocations))


QUERIES = {"chain_findings": chain_findings, "chain_verdicts": chain_verdicts}
_SQL = """
WITH it AS (
  SELECT l_orderkey AS k, l_linenumber AS line, min(l_partkey) AS part, min(l_suppkey) AS supp, CAST(min(l_shipdate) AS DATE) AS ship, 'v' || l_orderkey || '-' || l_linenumber AS ref FROM lineitem GROUP BY l_orderkey, l_linenumber
), o AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, (SELECT list(ref ORDER BY ref) FROM it WHERE it.k = o_orderkey) AS vs FROM orders
), ch AS (
  SELECT k, c, d, coalesce(vs, []) AS vs, d + 30 AS told, 'm' || k AS claim, CASE WHEN k % 53 <> 1 THEN 'n' || k END AS norm, 't' || (c % 7) AS type, 'h' || (c % 11) AS charter, 'l' || (c % 5) AS library,
    CASE WHEN k % 59 = 1 THEN '' ELSE 'c' || k END AS contract, 'a' || k AS adj, CASE WHEN k % 47 <> 2 THEN 'p' || k END AS proof, CASE WHEN k % 2 = 0 THEN 'x' || k END AS action, CASE WHEN k % 43 <> 4 THEN 'r' || k END AS rollback FROM o
), every AS (
  SELECT k, unnest(['m' || k, 'n' || k, 'c' || k, 'a' || k, 'p' || k, 'x' || k, 'r' || k, type, charter, library] || vs) AS ref FROM ch
), logged AS (
  SELECT k, ref, (k * 13 + ascii(ref) + CAST(right(ref, 1) AS BIGINT)) % 500 AS code FROM every
), receipts AS (
  SELECT it.*, part % 199 <> 3 AS here, CASE WHEN part % 211 = 5 THEN 'compiler' ELSE 'verifier' || line END AS signer, CASE WHEN part % 223 = 5 THEN 'simulator' ELSE 'verifier' || line END AS role FROM it
), refs AS (
  SELECT k, unnest([claim, norm, type, charter, library, nullif(contract, ''), adj, proof, action, rollback] || vs) AS ref FROM ch
  UNION SELECT k, ref FROM logged WHERE code <> 7
), seen AS (
  SELECT refs.*, substr(refs.ref, 1, 1) AS kind, coalesce(r.here, TRUE) AS here, l.code,
    CASE substr(refs.ref, 1, 1) WHEN 'm' THEN 'claimant' WHEN 'n' THEN 'normalizer' WHEN 't' THEN 'principal' WHEN 'h' THEN 'charter' WHEN 'l' THEN 'library' WHEN 'c' THEN CASE WHEN refs.k % 83 = 9 THEN 'simulator' ELSE 'compiler' END
      WHEN 'a' THEN CASE WHEN refs.k % 101 = 9 THEN 'simulator' ELSE 'judge' END WHEN 'p' THEN 'composer' WHEN 'x' THEN 'actor' WHEN 'r' THEN 'operator' ELSE r.role END AS role, r.signer
  FROM refs LEFT JOIN receipts r ON r.ref = refs.ref LEFT JOIN logged l ON l.k = refs.k AND l.ref = refs.ref AND l.code <> 7 WHERE refs.ref IS NOT NULL
), roles AS (
  SELECT k, coalesce(signer, role) AS signer FROM seen WHERE here GROUP BY k, coalesce(signer, role) HAVING count(DISTINCT role) > 1
), used AS (
  SELECT ch.k, ch.contract, ch.told, r.* EXCLUDE (k), list_position(ch.vs, r.ref) AS place FROM ch JOIN receipts r ON r.k = ch.k
), found AS (
  SELECT k, 2 AS step, 0 AS place, ref AS key, 0 AS rule, 'missing_artifact' AS reason, ref FROM seen WHERE NOT here
  UNION ALL SELECT k, 2, 0, ref, 1, 'noncanonical_artifact', ref FROM seen WHERE kind = 'r' AND k % 131 = 9
  UNION ALL SELECT k, 2, 0, ref, 2, 'invalid_signature', ref FROM seen WHERE kind = 'm' AND k % 73 = 6
  UNION ALL SELECT k, 2, 0, ref, 3, 'missing_log_inclusion', ref FROM seen WHERE here AND (code IS NULL OR code IN (8, 9))
  UNION ALL SELECT k, 3, 0, signer, 0, 'role_isolation_violation', signer FROM roles
  UNION ALL SELECT k, 4, place, '', 0, 'self_signed_forbidden', ref FROM used WHERE here AND role = 'simulator'
  UNION ALL SELECT k, 4, 1000000000, '', 7, 'self_signed_forbidden', adj FROM ch WHERE k % 101 = 9
  UNION ALL SELECT k, 4, 1000000000, '', 8, 'self_signed_forbidden', contract FROM ch WHERE contract <> '' AND k % 83 = 9
  UNION ALL SELECT k, 1, 1000000000, '', 1, 'missing_artifact', 'normalization_receipt_ref' FROM ch WHERE norm IS NULL
  UNION ALL SELECT k, 1, 1000000000, '', 5, 'missing_artifact', 'verifier_contract_ref' FROM ch WHERE contract = ''
  UNION ALL SELECT k, 5, 1000000000, '', 9, 'normalization_missing', NULL FROM ch WHERE norm IS NULL
  UNION ALL SELECT k, 5, 1000000000, '', 10, 'claim_type_missing', norm FROM ch WHERE norm IS NOT NULL AND k % 79 = 7
  UNION ALL SELECT k, 5, 1000000000, '', 11, 'normalization_ambiguous', norm FROM ch WHERE norm IS NOT NULL AND k % 17 = 8 AND k % 34 <> 8
  UNION ALL SELECT k, 5, 1000000000, '', 12, 'non_strict_claimtype_selected', norm FROM ch WHERE norm IS NOT NULL AND k % 74 <> 6 AND CASE WHEN k % 37 = 6 THEN (c + 1) % 7 ELSE c % 7 END <> CASE WHEN k % 79 = 7 THEN (c + 2) % 7 ELSE c % 7 END
  UNION ALL SELECT k, 6, 1000000000, '', 14, 'contract_unbound', contract FROM ch WHERE contract <> '' AND k % 89 = 9
  UNION ALL SELECT k, 6, 1000000000, '', 15, 'contract_unbound', contract FROM ch WHERE contract <> '' AND k % 97 = 9
  UNION ALL SELECT k, 7, place, '', 1, 'missing_artifact', ref FROM used WHERE NOT here
  UNION ALL SELECT k, 7, place, '', 2, 'receipt_unbound', ref FROM used WHERE here AND 'c' || (k + CASE WHEN part % 227 = 5 THEN 1 ELSE 0 END) <> contract
  UNION ALL SELECT k, 7, place, '', 4, 'receipt_unbound', ref FROM used WHERE here AND part % 229 = 5
  UNION ALL SELECT k, 7, place, '', 5, 'receipt_scope_exceeded', ref FROM used WHERE here AND part % 233 = 5
  UNION ALL SELECT k, 7, 1000000000, 'k0', 0, 'missing_artifact', contract FROM ch WHERE contract <> '' AND k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM used WHERE used.k = ch.k AND used.here AND used.supp % 3 = 0)
  UNION ALL SELECT k, 8, 1000000000, '', 16, 'scope_composition_extrapolated', proof FROM ch WHERE len(vs) > 1 AND proof IS NULL
  UNION ALL SELECT k, 8, 1000000000, '', 17, 'scope_composition_extrapolated', proof FROM ch WHERE len(vs) > 1 AND proof IS NOT NULL AND k % 109 = 9
  UNION ALL SELECT k, 8, 1000000000, '', 18, 'scope_composition_extrapolated', proof FROM ch WHERE len(vs) > 1 AND proof IS NOT NULL AND k % 127 = 9
  UNION ALL SELECT k, 9, 1000000000, '', 19, 'invalid_adjudication_move', adj FROM ch WHERE k % 103 = 9
  UNION ALL SELECT k, 9, 1000000000, '', 20, 'invalid_adjudication_move', adj FROM ch WHERE k % 107 = 9
  UNION ALL SELECT k, 9, 1000000000, '', 22, 'claim_exceeds_evidence', adj FROM ch WHERE k % 71 = 4
  UNION ALL SELECT k, 10, place, '', 7, 'noncanonical_artifact', ref FROM used WHERE here AND part % 239 = 5
  UNION ALL SELECT k, 10, place, '', 8, 'stale_receipt', ref FROM used WHERE here AND part % 239 <> 5 AND told >= ship + CAST(20 + part % 300 AS INTEGER)
  UNION ALL SELECT k, 10, 1000000000, '', 23, 'noncanonical_artifact', adj FROM ch WHERE k % 113 = 9
  UNION ALL SELECT k, 10, 1000000000, '', 24, 'too_early_for_final_adjudication', adj FROM ch WHERE k % 113 <> 9 AND k % 5 = 0 AND told < d + 25 + CAST(k % 7 AS INTEGER)
  UNION ALL SELECT k, 11, 0, ref, 4, 'revoked_artifact_used', ref FROM seen WHERE kind = 'h' AND (k % 61 = 5 OR (TRY_CAST(substr(ref, 2) AS BIGINT) % 4 = 1 AND (SELECT told FROM ch WHERE ch.k = seen.k) >= DATE '1997-01-01'))
  UNION ALL SELECT k, 12, 1000000000, '', 25, 'charter_unauthorized', charter FROM ch WHERE k % 67 = 3
  UNION ALL SELECT k, 12, 1000000000, '', 26, 'action_without_rollback', action FROM ch WHERE action IS NOT NULL AND rollback IS NULL AND k % 4 <> 0
), firsts AS (
  SELECT k, arg_min(reason, {'a': step, 'b': place, 'c': key, 'd': rule}) AS reason FROM found WHERE reason NOT IN ('normalization_ambiguous', 'stale_receipt', 'too_early_for_final_adjudication', 'revoked_artifact_used') GROUP BY k
), sums AS (
  SELECT k, bool_or(reason = 'revoked_artifact_used') AS revoked, bool_or(reason = 'stale_receipt') AS stale, bool_or(reason = 'too_early_for_final_adjudication') AS early, count(*) AS findings FROM found GROUP BY k
)
"""
ORACLES = {
    "chain_findings": _SQL + "SELECT k AS chain_id, reason, ref FROM found",
    "chain_verdicts": _SQL
    + """SELECT ch.k AS chain_id, coalesce(findings, 0) AS findings,
  CASE WHEN findings IS NULL THEN 'legitimate' WHEN revoked THEN 'revoked' WHEN firsts.reason IS NOT NULL THEN 'illegitimate' WHEN stale THEN 'downgraded' ELSE 'provisional' END AS status,
  CASE WHEN findings IS NULL THEN 'ok' WHEN revoked THEN 'revoked_artifact_used' WHEN firsts.reason IS NOT NULL THEN firsts.reason WHEN stale THEN 'stale_receipt' WHEN early THEN 'too_early_for_final_adjudication' ELSE 'normalization_ambiguous' END AS reason
FROM ch LEFT JOIN sums ON sums.k = ch.k LEFT JOIN firsts ON firsts.k = ch.k""",
}
