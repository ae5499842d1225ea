"""Registered queries: customers' orders as packs with reports and manifests, whose passports are minted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import passports
from .views import table

# Texts of reports and manifests, in expressions that Spark and the SQL both read.
_REPORT = """CASE WHEN o_orderkey % 23 = 4 THEN NULL WHEN o_orderkey % 29 = 4 THEN '{"attestation":' WHEN o_orderkey % 31 = 4 THEN '[]' ELSE '{"attestation":{"pack_id":"p' || o_orderkey || '","receipt_integrity":' || CASE o_custkey % 4 WHEN 0 THEN '"FAIL"' WHEN 1 THEN 'null' ELSE '"PASS"' END
  || CASE o_orderkey % 3 WHEN 0 THEN ',"claim_check":"PASS"' WHEN 1 THEN ',"claim_check":"FAIL"' ELSE ',"claim_check":"N/A"' END || ',"pack_root_sha256":"' || md5(o_orderpriority) || '"}}' END"""
_MANIFEST = """CASE WHEN o_custkey % 7 = 4 THEN NULL WHEN o_custkey % 7 = 5 THEN '{}' ELSE '{"attestation":{"pack_root_sha256":"' || md5(o_orderpriority) || '","timestamp_start":"2024-01-0' || (o_orderkey % 9 + 1) || '"}}' END"""


def minted_passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's passport draft, with the results of its claims."""
    packs = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS pack_id", f"{_REPORT} AS report", f"{_MANIFEST} AS manifest")
    found = passports.mint(packs, "2026-03-15 12:00:00", 45)
    return found.selectExpr("pack_id", "issued_at", "valid_until", "window_start", "window_end", "pack_ref", "array_join(transform(claims, c -> concat_ws(' ', c.claim_id, c.result, c.evidence_ref)), ';') AS claims", "evidence_summary.core_claims_passed", "evidence_summary.proof_pack_hash", "reliance", "evidence_mix", "error")


QUERIES = {f.__name__: f for f in (minted_passports,)}
ORACLES = {
    "minted_passports": f"""
WITH x AS (SELECT o_orderkey AS pack_id, {_REPORT} AS report, {_MANIFEST} AS manifest FROM orders
), y AS (
  SELECT pack_id, json_type(CASE WHEN json_valid(report) THEN report END) = 'OBJECT' AS ok, CASE WHEN json_valid(report) THEN json_extract(report, '$.attestation') END AS a, manifest IS NOT NULL AS listed, json_extract(manifest, '$.attestation') AS m FROM x
), z AS (
  SELECT pack_id, listed, m, coalesce(ok, FALSE) AS ok, a->>'$.pack_root_sha256' AS root, 'proof_pack/' || coalesce(a->>'$.pack_id', '') || '/verify_report.json#' AS base,
    CASE WHEN a->>'$.receipt_integrity' = 'PASS' THEN 'pass' ELSE 'fail' END AS i, CASE WHEN coalesce(a->>'$.claim_check', 'N/A') <> 'N/A' THEN CASE WHEN a->>'$.claim_check' = 'PASS' THEN 'pass' ELSE 'fail' END END AS c FROM y
), n AS (SELECT *, CASE WHEN NOT ok THEN 0 WHEN c IS NULL THEN 2 ELSE 3 END AS n, CASE WHEN i = 'pass' THEN 2 ELSE 0 END + CASE WHEN c = 'pass' THEN 1 ELSE 0 END AS passed FROM z)
SELECT pack_id, '2026-03-15T12:00:00+00:00' AS issued_at, '2026-04-29T12:00:00+00:00' AS valid_until, coalesce(m->>'$.timestamp_start', '2026-03-15T12:00:00+00:00') AS window_start, '2026-03-15T12:00:00+00:00' AS window_end,
  CASE WHEN listed THEN 'sha256:' || coalesce(m->>'$.pack_root_sha256', '') END AS pack_ref,
  CASE WHEN ok THEN 'C-001 ' || i || ' ' || base || 'integrity;C-002 ' || i || ' ' || base || 'hash_chain' || coalesce(';C-003 ' || c || ' ' || base || 'claims', '') ELSE '' END AS claims,
  CASE WHEN ok THEN passed || '/' || n END AS core_claims_passed, CASE WHEN ok THEN coalesce(root, '') END AS proof_pack_hash, 'R0' AS reliance, n || ' machine / 0 human' AS evidence_mix, CASE WHEN NOT ok THEN 'report_missing' END AS error FROM n
""",
}
