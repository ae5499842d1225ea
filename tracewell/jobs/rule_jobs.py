"""Registered queries: record shapes, member names, digests, claim policy, coverage matrices, timelines, proofs, hysteresis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, lifecycle, records, textgate
from ..streaming import streams
from .lifecycle_jobs import _EV, _EVENTS, commitments
from .text_jobs import _landed
from .views import receipts, table

RULES = {"prototype_to_production": ("BLOCK", "high", ["tests", "review"]), "local_to_general": ("NEEDS_REVIEW", "", ["bench"]), "observed_to_causal": ("BLOCK", "", [])}
CLASSES = ["prototype_to_production", "local_to_general", "observed_to_causal", "demo_to_enterprise"]
EVIDENCE = {"tests": ["tests/*.py", "checks/?.py"], "review": ["docs/review-1*.md"], "bench": ["bench.py", "perf/*"], "unused": []}


def _pick(expr, names: list):
    return F.element_at(F.array(*map(F.lit, names)), (expr % len(names) + 1).cast("int"))


def commitment_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.commitment_timeline(commitments(spark, sf_dir))


def decision_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions whose fields are spoilt by keys; the texts of status and priority give references."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ref = F.when(c % 6 != 5, F.struct(_pick(k, ["receipt", "metric", "rumour"]).alias("ref_type"), F.when(k % 4 != 1, F.col("o_orderpriority")).alias("ref_id"), _pick(c, ["supporting", "contextual", "none"]).alias("ref_role")))
    given = {c: F.lit("x") for c in records.REQUIRED} | {"receipt_id": F.concat(F.lit("d"), k), "receipt_type": F.when(k % 11 != 3, "decision_v1"), "receipt_version": _pick(c, ["0.1.0", "0.2.0", "9"]), "verdict": _pick(k, ["APPROVE", "REFUSE", "PERHAPS", ""]), "authority_class": _pick(c, ["BINDING", "ADVISORY", "ROYAL"]), "disposition": _pick(k + c, ["execute", "block", "wait"]), "policy_hash": F.when(c % 8 != 1, "h"), "evidence_sufficient": F.when(k % 9 != 4, F.lit(True)), "provenance_complete": F.lit(False)}
    extra = {"confidence": F.when(c % 2 == 0, _pick(k, ["high", "sure"])), "source_organ": F.lit(None).cast("string"), "proof_tier": F.when(k % 2 == 0, _pick(c, ["DRAFT", "FINAL"])), "dissent_severity": F.when(c % 5 == 0, _pick(k, ["note", "loud"])), "evidence_refs": F.when(k % 3 != 0, F.array(ref))}
    return records.decision_shape(table(spark, sf_dir, "orders").select(*[v.alias(n) for n, v in (given | extra).items()]), ["0.1.0", "0.2.0"])


def foreign_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a document as a member name within a list within an object."""
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "^([^ \n\t]+)", 1)
    raw = F.to_json(F.struct(F.array(F.create_map(word, F.lit(1))).alias("meta")))
    return table(spark, sf_dir, "documents").select("doc_id", records.foreign_name(raw).alias("f")).select("doc_id", "f.path", "f.name").where("name is not null")


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("even"))
    return table(spark, sf_dir, "orders").select("o_orderkey", records.stable_id("src", fields).alias("id"))


def result_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat(F.lit("c"), "l_linenumber").alias("claim_id")).agg(F.min("l_linestatus").alias("actual"), F.min("l_returnflag").alias("expected"))
    rows = items.withColumn("passed", F.col("actual") == F.col("expected")).withColumn("severity", F.when(F.col("l_orderkey") % 2 == 0, "critical"))
    return records.result_fingerprints(rows, "l_orderkey", "p1", "s1")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as transitions of their order, part keys as the paths of the order's change."""
    items = table(spark, sf_dir, "lineitem")
    found = items.select("l_orderkey", F.col("l_linenumber").alias("line"), _pick(F.col("l_suppkey"), CLASSES).alias("transition"), F.lit("low").alias("severity")).distinct()
    p = F.col("l_partkey")
    path = F.when(p % 4 == 0, F.concat(F.lit("tests/a/t"), p, F.lit(".py"))).when(p % 4 == 1, F.concat(F.lit("docs/review-"), p, F.lit(".md"))).when(p % 4 == 2, F.concat(F.lit("perf/"), p)).otherwise(F.concat(F.lit("checks/"), p, F.lit(".py")))
    return textgate.apply_policy(found, RULES, textgate.claim_evidence_paths(items.select("l_orderkey", path.alias("path")), EVIDENCE, "l_orderkey"), "l_orderkey")


def claim_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(c, ",")
    return _judged(spark, sf_dir).select("l_orderkey", "line", "transition", "severity", "verdict", text("required").alias("required"), text("missing").alias("missing"))


def claim_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textgate.overall_claims(_judged(spark, sf_dir), "l_orderkey")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as rows of their order's coverage matrix; some matrices lack their header, rows or a cell."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    status = _pick(F.col("s"), [*records.STATUSES, "LOST"])
    row = F.concat(F.lit("| q"), n, F.lit(" |  "), status, F.lit(" | `f"), F.col("p") % 5, F.lit(".json#/a`; g"), n, F.lit(" and `f9` | s |"), F.when((k % 10 == 3) & (n == 2), "").otherwise(" n |"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    rows = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("x"))
    head = F.when(k % 10 == 1, F.array(F.lit("# none"))).otherwise(F.array(F.lit("# Coverage"), F.lit(""), F.lit("| " + " | ".join(records.MATRIX) + " |"), F.lit("|---|---|---|---|---|")))
    body = F.when(k % 10 == 2, F.array(F.lit("text"))).otherwise(F.col("x.r"))
    return records.matrix_rows(rows.select("l_orderkey", F.concat(head, body).alias("lines")), F.col("lines"), "l_orderkey")


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).withColumn("refs", F.array_join(records.evidence_refs(F.col("evidence")), ",")).drop("evidence")


def coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    scope = items.where("l_linenumber % 3 <> 2 and l_orderkey % 4 <> 0").select("l_orderkey", F.concat(F.lit("q"), "l_linenumber").alias("question"), (F.col("l_linenumber") % 2 == 0).alias("out"))
    files = items.select("l_orderkey", F.explode(F.array(F.concat(F.lit("g"), "l_linenumber"), F.concat(F.lit("f"), F.col("l_linenumber") % 3, F.lit(".json")))).alias("path"))
    return records.coverage_rows_check(_matrix(spark, sf_dir), scope, files, "l_orderkey")


def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every receipt's proof within its run, checked against the run's root."""
    leaves = receipts(spark, sf_dir).select("trace_id", "seq", F.sha2(F.concat("receipt_id", F.lit(":"), "seq"), 256).alias("leaf"))
    rows = integrity.rooted_proofs(leaves, "trace_id", "seq", "leaf")
    return rows.select("trace_id", "place", "leaf", F.size("proof").alias("steps"), F.get("proof", F.lit(0)).alias("sibling"), integrity.merkle_included(F.col("leaf"), F.col("proof"), F.col("root"), F.col("place")).alias("included"))


def grace_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return _landed(spark, streams.grace(e.select("user_id", "event_id", ((k % 7) / 20 <= 0.25).alias("passes")), "user_id", "event_id"))


QUERIES = {f.__name__: f for f in (commitment_timeline, decision_shape, foreign_names, stable_ids, result_fingerprints, claim_policy, claim_overall, coverage_matrix, coverage_rows, merkle_proofs, grace_stream)}


def _choose(expr: str, names: list[str]) -> str:
    return f"CASE ({expr}) % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


_JUDGED = f"""WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber AS line, {_choose("l_suppkey", CLASSES)} AS transition FROM lineitem)
, met AS (SELECT l_orderkey, bool_or(l_partkey % 4 = 0 OR (l_partkey % 4 = 3 AND l_partkey < 10)) AS tests, bool_or(l_partkey % 4 = 1 AND CAST(l_partkey AS VARCHAR) LIKE '1%') AS review, bool_or(l_partkey % 4 = 2) AS bench FROM lineitem GROUP BY l_orderkey)
, j AS (SELECT l_orderkey, line, transition, CASE transition WHEN 'prototype_to_production' THEN 'high' WHEN 'demo_to_enterprise' THEN 'medium' ELSE 'low' END AS severity,
  CASE transition WHEN 'prototype_to_production' THEN 'tests,review' WHEN 'local_to_general' THEN 'bench' ELSE '' END AS required,
  CASE transition WHEN 'prototype_to_production' THEN array_to_string(list_filter([CASE WHEN NOT tests THEN 'tests' END, CASE WHEN NOT review THEN 'review' END], lambda x: x IS NOT NULL), ',') WHEN 'local_to_general' THEN CASE WHEN bench THEN '' ELSE 'bench' END ELSE '' END AS missing FROM t JOIN met USING (l_orderkey))
, v AS (SELECT *, CASE WHEN required <> '' AND missing = '' THEN 'PASS' WHEN transition IN ('prototype_to_production', 'observed_to_causal') THEN 'BLOCK' ELSE 'NEEDS_REVIEW' END AS verdict FROM j)
"""
_ROWS = f"""WITH i AS (SELECT l_orderkey, l_linenumber AS n, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
, c AS (SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 1 THEN 'missing header' WHEN l_orderkey % 10 = 2 THEN 'no rows' WHEN l_orderkey % 10 = 3 AND bool_or(n = 2) THEN 'wrong column count' END AS problem FROM i GROUP BY l_orderkey)
, m AS (SELECT l_orderkey, problem, NULL AS row, NULL AS question, NULL AS status, NULL AS scope, NULL AS notes, '' AS refs FROM c WHERE problem IS NOT NULL
  UNION ALL SELECT l_orderkey, NULL, (row_number() OVER (PARTITION BY l_orderkey ORDER BY n) - 1)::INT, 'q' || n, {_choose("s", [*records.STATUSES, "LOST"])}, 's', 'n', 'f' || (p % 5) || '.json#/a,g' || n || ',f9' FROM i JOIN c USING (l_orderkey) WHERE problem IS NULL)
"""

ORACLES = {
    "commitment_timeline": _EVENTS + """, w AS (SELECT *, CASE WHEN type = 'commitment.terminated' THEN '' ELSE array_to_string(list_filter([
    CASE WHEN reg_seq IS NULL OR reg_seq >= seq THEN 'no registration' END, CASE WHEN anchor IS NULL THEN 'no anchor' END,
    CASE WHEN end_seq < seq AND end_type LIKE 'fulfillment.%' THEN 'after closure' END, CASE WHEN end_seq < seq AND end_type = 'commitment.terminated' THEN 'after termination' END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM ends)
, l AS (SELECT commitment_id, seq, 'commitment.registered' AS type, 0 AS r, 'registered by actor_id=''' || actor_id || ''', due_at=' || due_at AS summary, 'ok' AS note FROM reg
  UNION ALL SELECT commitment_id, seq, type, 1, 'observed result_id=''' || result_id || '''', 'anchor edge present' FROM ev WHERE type = 'result.observed'
  UNION ALL SELECT commitment_id, seq, type, 2, 'fulfillment for result_id=''' || result_id || '''', CASE WHEN valid THEN 'closes commitment' ELSE 'invalid anchor (' || reasons || ')' END FROM w WHERE type LIKE 'fulfillment.%'
  UNION ALL SELECT commitment_id, seq, type, 3, 'terminated (reason=' || reason || CASE WHEN replacement_id IS NULL THEN '' ELSE ', replacement=''' || replacement_id || '''' END || ')', 'terminates commitment' FROM w WHERE type = 'commitment.terminated' AND valid)
SELECT commitment_id, (row_number() OVER (PARTITION BY commitment_id ORDER BY seq, r, summary))::INT AS line, seq, type, summary, note FROM l""",
    "decision_shape": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), p AS (SELECT k, unnest(list_filter([
  CASE WHEN k % 11 = 3 THEN 'receipt_type missing' END, CASE WHEN k % 11 = 3 THEN 'receipt_type unknown' END, CASE WHEN c % 3 = 2 THEN 'receipt_version unknown' END, CASE WHEN k % 4 = 2 THEN 'verdict unknown' END,
  CASE WHEN c % 3 = 2 THEN 'authority_class unknown' END, CASE WHEN (k + c) % 3 = 2 THEN 'disposition unknown' END, CASE WHEN c % 8 = 1 THEN 'policy_hash missing' END, CASE WHEN k % 9 = 4 THEN 'evidence_sufficient missing' END,
  CASE WHEN c % 2 = 0 AND k % 2 = 1 THEN 'confidence unknown' END, CASE WHEN k % 2 = 0 AND c % 2 = 1 THEN 'proof_tier unknown' END, CASE WHEN c % 5 = 0 AND k % 2 = 1 THEN 'dissent_severity unknown' END,
  CASE WHEN k % 3 <> 0 AND c % 6 = 5 THEN 'evidence_refs[0] no object' END, CASE WHEN k % 3 <> 0 AND c % 6 <> 5 AND k % 4 = 1 THEN 'evidence_refs[0].ref_id missing' END,
  CASE WHEN k % 3 = 2 AND c % 6 <> 5 THEN 'evidence_refs[0].ref_type unknown' END, CASE WHEN k % 3 <> 0 AND c % 6 <> 5 AND c % 3 = 2 THEN 'evidence_refs[0].ref_role unknown' END], lambda x: x IS NOT NULL)) AS x FROM o)
SELECT 'd' || k AS receipt_id, split_part(x, ' ', 1) AS field, substr(x, strpos(x, ' ') + 1) AS problem FROM p""",
    "foreign_names": "WITH w AS (SELECT doc_id, regexp_extract(text, '^([^ \\n\\t]+)', 1) AS name FROM documents) SELECT doc_id, '$.meta[0]' AS path, name FROM w WHERE regexp_matches(name, '[^\\x00-\\x7F]')",
    "stable_ids": """SELECT o_orderkey, 'src_' || substr(sha256('{"customer":' || o_custkey || ',"even":' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE 'null' END || ',"status":"' || o_orderstatus || '"}'), 1, 24) AS id FROM orders""",
    "result_fingerprints": """WITH i AS (SELECT l_orderkey, 'c' || l_linenumber AS claim_id, min(l_linestatus) AS a, min(l_returnflag) AS e FROM lineitem GROUP BY ALL)
SELECT l_orderkey, sha256('{"policy_hash":"p1","results":[' || string_agg('{"actual":"' || a || '","claim_id":"' || claim_id || '","expected":"' || e || '","passed":' || CASE WHEN a = e THEN 'true' ELSE 'false' END || ',"severity":' || CASE WHEN l_orderkey % 2 = 0 THEN '"critical"' ELSE 'null' END || '}', ',' ORDER BY claim_id) || '],"suite_hash":"s1"}') AS fingerprint FROM i GROUP BY l_orderkey""",
    "claim_policy": _JUDGED + "SELECT * FROM v",
    "claim_overall": _JUDGED + "SELECT l_orderkey, CASE WHEN bool_or(verdict = 'BLOCK') THEN 'BLOCK' WHEN bool_or(verdict = 'NEEDS_REVIEW') THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS overall FROM v GROUP BY l_orderkey",
    "coverage_matrix": _ROWS + "SELECT * FROM m",
    "coverage_rows": _ROWS + """, g AS (SELECT *, CAST(substr(question, 2) AS INT) AS n, status = 'OUT_OF_SCOPE' AS out FROM m WHERE row IS NOT NULL)
, sc AS (SELECT DISTINCT l_orderkey, l_linenumber AS n, l_linenumber % 2 = 0 AS out FROM lineitem WHERE l_linenumber % 3 <> 2 AND l_orderkey % 4 <> 0)
, fl AS (SELECT DISTINCT l_orderkey, unnest(['g' || l_linenumber, 'f' || (l_linenumber % 3) || '.json']) AS path FROM lineitem)
, rf AS (SELECT l_orderkey, row, split_part(unnest(string_split(refs, ',')), '#', 1) AS path FROM g WHERE status IN ('EVIDENCED', 'PARTIAL', 'FAILED'))
SELECT l_orderkey, row, 'unknown status' AS error, status AS what FROM g WHERE status = 'LOST'
UNION ALL SELECT l_orderkey, row, CASE WHEN out THEN 'out-of-scope row not declared' ELSE 'in-scope row not declared' END, question FROM g WHERE status <> 'LOST' AND (l_orderkey, out) IN (SELECT (l_orderkey, out) FROM sc) AND (l_orderkey, n, out) NOT IN (SELECT (l_orderkey, n, out) FROM sc)
UNION ALL SELECT l_orderkey, row, 'evidence missing', path FROM rf WHERE (l_orderkey, path) NOT IN (SELECT (l_orderkey, path) FROM fl)""",
    "grace_stream": _EV + """, r AS (SELECT user_id, event_id, (k % 7) / 20 <= 0.25 AS passes FROM e)
, w AS (SELECT *, count(*) OVER o AS n, sum(passes::INT) OVER o AS good FROM r WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
, t AS (SELECT *, CASE WHEN n < 3 THEN NULL WHEN good >= 3 THEN TRUE WHEN n - good >= 3 THEN FALSE END AS turn FROM w)
SELECT user_id, event_id, passes, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS in_grace FROM t""",
}
