"""Registered queries: governance. Orders stand for passports and manifests, items for what happened to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, governance
from .text_jobs import _FOUND, _findings
from .views import receipts, sql, table

NOW = "2001-06-01 00:00:00"
LOCK = {"pack_format_version": "1.2", "claim_set_hash": "h3", "mode": "allowlist", "allowed_fingerprints": ["s0", "s1", "s2", "s3"], "version_min": "1.9.0", "version_max": "2.0.0"}
REQUIRED = ["build", "lint", "tests"]


def verdict_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (key % n % len(names) + 1).cast("int"))
    flag = lambda n: F.when(key % n == 0, False).when(key % n == 1, None).otherwise(True)
    p = table(spark, sf_dir, "orders").select(key.alias("passport"), flag(7).alias("signature_valid"), (key % 11 != 0).alias("schema_valid"), flag(13).alias("content_hash_valid"), pick(17, "active", "revoked", "active", "superseded", "challenged").alias("governance_status"), pick(19, "ok", "ok", "some_invalid").alias("event_integrity"), pick(23, "fresh", "stale").alias("freshness_status"))
    return governance.verdict_matrix(p).groupBy("mode", "verdict", "reason").agg(F.count("*").alias("passports"), F.sum("passport").alias("key_sum"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = coverage.scan_summary(_findings(spark, sf_dir))
    n = F.substring("project", 5, 20).cast("long")
    facts = s.select("project", "sites_total", "instrumented", (n % 3 != 0).alias("lock_present"), (n % 4 != 0).alias("lock_valid"), (n % 5 == 0).alias("lock_stale"), (n % 2 == 0).alias("has_run"), (n % 6 != 1).alias("has_verify"), (n % 4 == 0).alias("has_lock"), (n % 9 != 3).alias("has_ref"), (n % 7).alias("receipt_files"))
    return governance.readiness(facts)


def readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("project", "coverage_points", "lock_points", "ci_points", "receipt_points", "raw_score", "score", "grade")


def fastest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.fastest_path(_scored(spark, sf_dir), "project")


def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    was = rows.where("instrumented % 2 = 0").select("project", F.when(F.col("instrumented") % 3 == 0, F.lit(95.0)).otherwise(F.lit(10.0)).alias("score"))
    return governance.score_gate(rows, was, "project", 40.0)


def lock_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    m = table(spark, sf_dir, "orders").select(key.alias("pack_id"), F.when(key % 5 == 0, "1.1").otherwise("1.2").alias("pack_format_version"), F.when(key % 6 != 0, F.concat(F.lit("h"), key % 4)).alias("claim_set_hash"), F.concat(F.lit("s"), key % 6).alias("signer"), F.concat_ws(".", key % 3, key % 12, F.lit(0)).alias("version"))
    return governance.lock_errors(m, LOCK)


def passport_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("passport_id"), F.col("o_orderdate").cast("timestamp").alias("valid_until"))
    kind = F.when(F.col("l_partkey") % 29 == 0, "revocation").when(F.col("l_partkey") % 17 == 0, "supersession").when(F.col("l_partkey") % 7 == 0, "challenge").otherwise("other")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("passport_id"), kind.alias("kind"))
    return governance.passport_states(o, e, NOW)


def passport_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    result = F.element_at(F.array(*map(F.lit, ("fail", "partial", "present", "pass"))), (F.col("p") % 4 + 1).cast("int"))
    c = items.groupBy(F.col("l_orderkey").alias("passport_id"), F.concat(F.lit("C-"), "l_linenumber").alias("claim_id")).agg(F.max("l_partkey").alias("p")).select("passport_id", "claim_id", result.alias("result"))
    pairs = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderkey").alias("passport_a"), (F.col("o_orderkey") + 1).alias("passport_b"))
    return governance.passport_claims(pairs, c)


def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of packs (their source); the manifest is spoilt by rule."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("pack_id"), "doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("length"))
    path = lambda n: F.when(F.col("doc_id") % 41 == n, F.concat(F.lit("../f"), "doc_id")).otherwise(F.concat(F.lit("f"), "doc_id"))
    files = d.where("doc_id % 23 <> 5").withColumn("path", F.concat(F.lit("f"), "doc_id"))
    manifest = d.where("doc_id % 31 <> 7").select("pack_id", path(3).alias("path"), F.when(F.col("doc_id") % 19 == 2, "bad").otherwise(F.col("sha256")).alias("sha256"), (F.col("length") + (F.col("doc_id") % 13 == 4).cast("int")).alias("bytes"))
    expected = d.where("doc_id % 31 < 9").select("pack_id", F.concat(F.lit("f"), "doc_id").alias("path"))
    return governance.manifest_problems(manifest, files.select("pack_id", "path", "sha256", "length"), expected)


def support_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders assert claims; their items change the support."""
    names = F.array(*map(F.lit, ("ASSERTED", "SUPPORTED", "DISPUTED", "RETRACTED", "SUPPORTED")))
    pick = lambda c: F.element_at(names, (F.col(c) % 5 + 1).cast("int"))
    a = table(spark, sf_dir, "orders").where("o_orderkey % 8 <> 3").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("line_no"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").cast("timestamp").alias("ts"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    c = items.select(F.col("l_orderkey").alias("claim_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("change_id"), "ts", pick("p").alias("prior_status"), pick("s").alias("new_status"))
    return governance.support_chain(a, c)


def duplicate_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    c = items.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("contradiction_id"), (F.col("p") % 40).alias("claim_a"), F.col("s").alias("claim_b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"))
    return governance.duplicate_pairs(c, c.where("line_no % 3 = 1"))


def required_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    name = F.element_at(F.array(*map(F.lit, ("build", "lint", "tests", "docs", "Build"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    conclusion = F.when(F.col("l_suppkey") % 4 == 0, "failure").when(F.col("l_suppkey") % 4 == 1, None).otherwise("Success")
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("head"), name.alias("name"), conclusion.alias("conclusion"))
    return governance.required_checks(o.select(F.col("o_orderkey").alias("head")), REQUIRED, seen)


def newest_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.newest_traces(receipts(spark, sf_dir), 20)


def previous_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack_id"), F.col("o_custkey").alias("parent"), F.col("o_orderdate").alias("mtime"))
    return governance.previous_pack(o)


QUERIES = {f.__name__: f for f in (verdict_matrix, readiness_score, fastest_path, score_gate, lock_errors, passport_states, passport_claims, manifest_problems, support_chain, duplicate_contradictions, required_checks, newest_traces, previous_pack)}

_SCORED = _FOUND + """, f AS (SELECT *, CAST(substr(project, 5) AS BIGINT) AS n FROM scan)
, pts AS (SELECT project, instrumented, n,
  round(39 * greatest(0, least(1, instrumented / sites_total))::DOUBLE, 1) AS coverage_points,
  CASE WHEN n % 3 <> 0 AND n % 4 <> 0 AND n % 5 <> 0 THEN 17.0 WHEN n % 3 <> 0 THEN 7.7 ELSE 0.0 END::DOUBLE AS lock_points,
  CASE WHEN n % 2 = 0 AND n % 6 <> 1 AND n % 4 = 0 THEN 22.0 WHEN n % 2 = 0 AND n % 6 <> 1 THEN 15.4 WHEN n % 6 <> 1 AND n % 9 <> 3 THEN 11.0 WHEN n % 9 <> 3 THEN 5.5 ELSE 0 END::DOUBLE AS ci_points,
  CASE WHEN n % 7 > 0 THEN 22.0 ELSE 0.0 END::DOUBLE AS receipt_points FROM f)
, raw AS (SELECT *, round(coverage_points + lock_points + ci_points + receipt_points, 1) AS raw_score FROM pts)
, sc AS (SELECT *, CASE WHEN n % 7 = 0 AND raw_score >= 70 THEN 69.9::DOUBLE ELSE raw_score END AS score FROM raw)
"""

ORACLES = {
    "verdict_matrix": """WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS sig, o_orderkey % 11 <> 0 AS sch, CASE o_orderkey % 13 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS ch,
  ['active', 'revoked', 'active', 'superseded', 'challenged'][(o_orderkey % 17 % 5 + 1)::INT] AS gov, ['ok', 'ok', 'some_invalid'][(o_orderkey % 19 % 3 + 1)::INT] AS ev, ['fresh', 'stale'][(o_orderkey % 23 % 2 + 1)::INT] AS fr FROM orders)
, m AS (SELECT *, unnest(['permissive', 'balanced', 'strict']) AS mode FROM p)
, r AS (SELECT *, CASE WHEN sig = FALSE THEN 'signature invalid' WHEN NOT sch THEN 'schema invalid' WHEN ch = FALSE THEN 'content hash mismatch' WHEN gov = 'revoked' THEN 'revoked' WHEN ev = 'some_invalid' THEN 'events invalid' WHEN gov = 'superseded' THEN 'superseded' WHEN gov = 'challenged' THEN 'challenged' WHEN fr = 'stale' THEN 'stale' WHEN sig IS NULL THEN 'unsigned' ELSE 'clean' END AS reason FROM m)
SELECT mode, CASE WHEN reason = 'clean' THEN 'PASS' WHEN reason IN ('events invalid', 'superseded', 'unsigned') THEN CASE WHEN mode = 'strict' THEN 'FAIL' ELSE 'WARN' END WHEN reason IN ('challenged', 'stale') THEN CASE WHEN mode = 'permissive' THEN 'WARN' ELSE 'FAIL' END ELSE 'FAIL' END AS verdict, reason, count(*) AS passports, sum(k)::BIGINT AS key_sum FROM r GROUP BY ALL""",
    "readiness_score": _SCORED + "SELECT project, coverage_points, lock_points, ci_points, receipt_points, raw_score, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM sc",
    "fastest_path": _SCORED + """, g AS (SELECT project, 'coverage' AS part, 39 - coverage_points AS gap, 0 AS i FROM sc UNION ALL SELECT project, 'lockfile', 17 - lock_points, 1 FROM sc UNION ALL SELECT project, 'ci_gate', 22 - ci_points, 2 FROM sc UNION ALL SELECT project, 'receipts', 22 - receipt_points, 3 FROM sc)
SELECT project, part, round(gap, 1) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY gap DESC, i) AS rn FROM g) WHERE rn = 1 AND gap > 0""",
    "score_gate": _SCORED + """, w AS (SELECT project, CASE WHEN instrumented % 3 = 0 THEN 95.0::DOUBLE ELSE 10.0 END AS was FROM sc WHERE instrumented % 2 = 0)
SELECT project, score, was, coalesce(score < was, FALSE) AS regressed, CASE WHEN score < 40 OR coalesce(score < was, FALSE) THEN 'FAIL' ELSE 'PASS' END AS result FROM sc LEFT JOIN w USING (project)""",
    "lock_errors": """WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS pack_id, 'pack_format_version' AS field FROM o WHERE k % 5 = 0 UNION ALL SELECT k, 'claim_set_hash' FROM o WHERE k % 6 = 0 OR k % 4 <> 3 UNION ALL SELECT k, 'signer' FROM o WHERE k % 6 > 3
UNION ALL SELECT k, 'version_min' FROM o WHERE k % 3 < 1 OR (k % 3 = 1 AND k % 12 < 9) UNION ALL SELECT k, 'version_max' FROM o WHERE k % 3 >= 2""",
    "passport_states": f"""WITH e AS (SELECT l_orderkey, bool_or(l_partkey % 29 = 0) AS r, bool_or(l_partkey % 29 <> 0 AND l_partkey % 17 = 0) AS s, count_if(l_partkey % 29 <> 0 AND l_partkey % 17 <> 0 AND l_partkey % 7 = 0)::BIGINT AS c FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS passport_id, CASE WHEN r THEN 'REVOKED' WHEN s THEN 'SUPERSEDED' WHEN c > 0 THEN 'CHALLENGED' WHEN o_orderdate < TIMESTAMP '{NOW}' THEN 'STALE' ELSE 'FRESH' END AS state, coalesce(c, 0) AS challenges FROM orders LEFT JOIN e ON l_orderkey = o_orderkey""",
    "passport_claims": """WITH c AS (SELECT l_orderkey AS id, 'C-' || l_linenumber AS claim_id, max(l_partkey) % 4 AS r FROM lineitem GROUP BY ALL)
, a AS (SELECT o_orderkey AS pair_id, claim_id, r AS ra FROM orders JOIN c ON id = o_orderkey WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS pair_id, claim_id, r AS rb FROM orders JOIN c ON id = o_orderkey + 1 WHERE o_orderkey % 2 = 0)
SELECT pair_id, claim_id, ['fail', 'partial', 'present', 'pass'][(ra + 1)::INT] AS a_result, ['fail', 'partial', 'present', 'pass'][(rb + 1)::INT] AS b_result, CASE WHEN ra IS NULL THEN 'new' WHEN rb IS NULL THEN 'removed' WHEN rb < ra THEN 'regressed' WHEN rb > ra THEN 'improved' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (pair_id, claim_id)""",
    "manifest_problems": """WITH d AS (SELECT source AS pack_id, doc_id, sha256(text) AS h FROM documents), m AS (SELECT *, CASE WHEN doc_id % 41 = 3 THEN '../f' ELSE 'f' END || doc_id AS path FROM d WHERE doc_id % 31 <> 7)
, p AS (SELECT pack_id, path, CASE WHEN doc_id % 41 = 3 THEN 'escape' WHEN doc_id % 23 = 5 THEN 'missing' WHEN doc_id % 19 = 2 THEN 'hash' WHEN doc_id % 13 = 4 THEN 'size' END AS problem FROM m)
SELECT * FROM p WHERE problem IS NOT NULL UNION ALL SELECT pack_id, 'f' || doc_id, 'not in manifest' FROM d WHERE doc_id % 31 < 9 AND (doc_id % 31 = 7 OR doc_id % 41 = 3)""",
    "support_chain": """WITH c AS (SELECT l_orderkey AS claim_id, l_orderkey || '-' || l_linenumber AS change_id, min(l_shipdate) AS ts, ['ASSERTED', 'SUPPORTED', 'DISPUTED', 'RETRACTED', 'SUPPORTED'][(min(l_partkey) % 5 + 1)::INT] AS prior, ['ASSERTED', 'SUPPORTED', 'DISPUTED', 'RETRACTED', 'SUPPORTED'][(min(l_suppkey) % 5 + 1)::INT] AS new FROM lineitem GROUP BY l_orderkey, l_linenumber)
, x AS (SELECT *, coalesce(lag(new) OVER (PARTITION BY claim_id ORDER BY ts, change_id), 'ASSERTED') AS expected FROM c), j AS (SELECT x.*, o_orderdate AS claim_ts FROM x LEFT JOIN orders ON o_orderkey = claim_id AND o_orderkey % 8 <> 3)
SELECT change_id, 'claim_exists' AS "check" FROM j WHERE claim_ts IS NULL UNION ALL SELECT change_id, 'after_assertion' FROM j WHERE ts < claim_ts UNION ALL SELECT change_id, 'prior_mismatch' FROM j WHERE prior <> expected UNION ALL SELECT change_id, 'retracted_terminal' FROM j WHERE expected = 'RETRACTED'""",
    "duplicate_contradictions": """WITH c AS (SELECT l_orderkey || '-' || l_linenumber AS contradiction_id, min(l_partkey) % 40 AS claim_a, min(l_suppkey) AS claim_b, l_orderkey * 10 + l_linenumber AS line_no FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT contradiction_id, claim_a, claim_b FROM (SELECT *, row_number() OVER (PARTITION BY claim_a, claim_b ORDER BY line_no) AS nth FROM c WHERE line_no % 3 <> 1) WHERE nth > 1""",
    "required_checks": """WITH s AS (SELECT l_orderkey AS head, ['build', 'lint', 'tests', 'docs', 'Build'][(l_partkey % 5 + 1)::INT] AS name, l_suppkey % 4 AS c FROM lineitem), g AS (SELECT head, name, count_if(c <> 1) AS done, count_if(c = 0) AS bad FROM s GROUP BY ALL), w AS (SELECT o_orderkey AS head, unnest(['build', 'lint', 'tests']) AS name FROM orders)
SELECT w.head, w.name, CASE WHEN done IS NULL THEN CASE WHEN w.head IN (SELECT head FROM s) THEN 'NAME_MISMATCH_POSSIBLE' ELSE 'NOT_OBSERVED_YET' END WHEN done = 0 THEN 'OBSERVED_PENDING' WHEN bad > 0 THEN 'OBSERVED_FAIL' ELSE 'OBSERVED_PASS' END AS status FROM w LEFT JOIN g USING (head, name)""",
    "newest_traces": sql("\nSELECT trace_id, count(*) AS receipts, max(seq) AS last_seq FROM receipts GROUP BY trace_id ORDER BY last_seq DESC LIMIT 20"),
    "previous_pack": "SELECT o_orderkey AS pack_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders",
}
