"""Registered queries: chunks of documents as derived artifacts, some of them spoilt by rule; a store after a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import settle
from ..operators import derived, textgate
from .text_jobs import _CHUNKS
from .views import table


def derivation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a snapshot, each chunk of eight lines an artifact with a receipt; every document of several chunks
    has a digest made from its first two. By rule, texts, hashes, ids, indexes, inputs, kinds, transforms are spoilt."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    # chunks and rows are written, as receipts and artifacts are read for many joins
    chunks = settle(textgate.line_chunks(docs.select("doc_id", "text"), 8).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "sha256"))
    d, n = F.col("doc_id"), F.col("chunk")
    x = d + n
    snapshots = docs.where(d % 37 != 3).select(F.concat(F.lit("s"), d).alias("snapshot_id"), F.concat(F.lit("sha256:"), F.sha2(F.when(d % 23 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256)).alias("content_hash"), F.when(d % 41 != 3, F.col("text")).alias("content_text"))
    name = F.concat(F.lit("a"), d, F.lit("-"), n)
    hashed = F.concat(F.lit("sha256:"), F.when(x % 19 == 3, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")))
    pieces = chunks.select(name.alias("id"), F.lit("source_chunk").alias("artifact_type"), F.concat(F.lit("s"), d).alias("snapshot"), F.array().cast("array<string>").alias("inputs"), F.when(x % 29 == 3, "t2").when(x % 53 == 3, "t9").otherwise("t1").alias("transform"), hashed.alias("hash"), F.when(x % 31 == 3, n + 1000).otherwise(n).alias("index"), x.alias("x"))
    digests = chunks.where("chunk = 1").select(F.concat(F.lit("z"), d).alias("id"), F.lit("digest"), F.lit(None).cast("string"), F.array(F.concat(F.lit("a"), d, F.lit("-0")), F.concat(F.lit("a"), d, F.when(d % 17 == 3, "-9999").otherwise("-1"))), F.lit("t2"), F.lit("sha256:d"), F.lit(None).cast("long"), (d + 1).alias("x"))
    every = pieces.union(digests)
    y = F.col("x")
    kind = F.when(y % 43 == 3, "derived.artifact.staled").when(y % 47 == 3, "derived.artifact.moved").otherwise("derived.artifact.created")
    quoted = lambda items: F.concat(F.lit("["), F.array_join(F.transform(items, lambda i: F.concat(F.lit('"'), i, F.lit('"'))), ","), F.lit("]"))
    claimed = F.when(y % 59 == 3, ',"transform":{"code_hash":"c","config_hash":"g","name":"other","runtime_hash":"r","transform_id":"t1","version":"1"}').otherwise("")
    sources = F.when(F.col("snapshot").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.when(y % 61 == 3, "s-none").otherwise(F.col("snapshot"))))
    said = F.when(y % 67 == 3, "sha256:said").otherwise(F.col("hash"))
    head = F.concat(F.lit('{"derivation_verification_level":"DV2","input_artifact_ids":'), quoted(F.col("inputs")), F.lit(',"kind":"'), kind, F.lit('","metadata":{"receipt_schema_version":"'), F.when(y % 71 == 3, "2").otherwise("1"), F.lit('"'), claimed, F.lit('},"output_hash":"'), said)
    tail = F.concat(F.lit('","source_snapshot_ids":'), quoted(sources), F.lit(',"status":"verified","subject_id":"'), "id", F.lit('","transform_id":"'), "transform", F.lit('"}'))
    rid = F.concat(F.lit("drcpt_"), F.substring(F.sha2(F.concat(head, tail, F.when(y % 73 == 3, "x").otherwise("")), 256), 1, 24))
    rows = settle(every.withColumn("head", head).withColumn("tail", tail).withColumn("rid", rid).withColumn("kind", kind))
    raw = F.when(y % 79 == 3, "[1]").when(y % 83 == 3, F.concat("head", "tail")).otherwise(F.concat(F.lit('{"created_at":"c","receipt_id":"'), "rid", F.lit('",'), F.expr("substr(head, 2)"), "tail"))
    receipts = rows.select(F.col("rid").alias("receipt_id"), "kind", F.col("id").alias("subject_id"), F.lit("DV2").alias("level"), F.when(y % 89 == 3, "failed").otherwise("verified").alias("status"), F.lit("c").alias("created_at"), raw.alias("raw"))
    artifacts = rows.where("x % 97 <> 3").select(F.col("id").alias("artifact_id"), "artifact_type", F.col("snapshot").alias("source_snapshot_id"), F.when((F.size("inputs") > 0) & (y % 13 == 3), F.slice("inputs", 1, 1)).otherwise(F.col("inputs")).alias("input_artifact_ids"), F.col("transform").alias("transform_id"), F.col("hash").alias("output_hash"), F.when(y % 101 == 3, "drcpt_other").otherwise(F.col("rid")).alias("receipt_id"), F.when(y % 11 == 3, "stale").otherwise("active").alias("status"), F.lit(8).cast("long").alias("max_lines"), F.col("index").alias("chunk_index"))
    transforms = spark.createDataFrame([("t1", "line_chunker", "1", "c", "g", "r"), ("t2", "digester", "1", "c", "g", "r")], "transform_id string, name string, version string, code_hash string, config_hash string, runtime_hash string")
    tombstones = pieces.where("x % 103 = 3").select(F.col("id").alias("artifact_id"))
    found = derived.verify_derivations(receipts, artifacts, snapshots, transforms, tombstones)
    return found.select("subject_id", "receipt_id", "level", "status", F.array_join("errors", "; ").alias("errors"))


def store_after_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artifacts of orders after a plan that brings orders in, changes some, and marks some stale or buried."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    row = lambda status, receipt: [F.concat(F.lit("a"), k).alias("artifact_id"), F.concat(F.lit("s"), c).alias("snapshot_id"), F.lit(status).alias("status"), F.concat(F.lit(receipt), k).alias("receipt_id"), F.lit("DV2").alias("level")]
    nothing = {n: spark.createDataFrame([], f"{key} string") for n, (key, _) in derived.STORE.items() if n != "artifacts"}
    store = nothing | {"artifacts": o.where(k % 3 > 0).select(*row("active", "old"))}
    changes = o.where(k % 5 > 1).select(*row("active", "new"), (k % 7).alias("n"))
    marks = o.where(k % 11 == 4).select(F.concat(F.lit("a"), k).alias("artifact_id"), F.lit("stale").alias("status"), F.lit(4).cast("long").alias("n")).union(o.where(k % 13 == 4).select(F.concat(F.lit("a"), k), F.lit("tombstoned"), F.lit(5).cast("long")))
    return derived.applied(store, {"artifacts": changes}, marks)["artifacts"]


QUERIES = {"derivation_levels": derivation_levels, "store_after_plan": store_after_plan}
ORACLES = {
    "derivation_levels": _CHUNKS
    + """, e AS (
  SELECT doc_id + chunk AS x, doc_id AS d, 'a' || doc_id || '-' || chunk AS id, 'source_chunk' AS type, 's' || doc_id AS snap, CAST([] AS VARCHAR[]) AS inputs, CASE WHEN (doc_id + chunk) % 29 = 3 THEN 't2' WHEN (doc_id + chunk) % 53 = 3 THEN 't9' ELSE 't1' END AS tr,
    'sha256:' || CASE WHEN (doc_id + chunk) % 19 = 3 THEN sha256('other') ELSE sha256 END AS hash, 'sha256:' || sha256 AS made, (doc_id + chunk) % 31 <> 3 OR EXISTS (SELECT 1 FROM chunks c2 WHERE c2.doc_id = chunks.doc_id AND c2.chunk = chunks.chunk + 1000) AS inside FROM chunks WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id + 1, doc_id, 'z' || doc_id, 'digest', NULL, ['a' || doc_id || '-0', 'a' || doc_id || CASE WHEN doc_id % 17 = 3 THEN '-9999' ELSE '-1' END], 't2', 'sha256:d', NULL, NULL FROM chunks WHERE chunk = 1 AND doc_id IS NOT NULL
), r AS (
  SELECT *, CASE WHEN x % 43 = 3 THEN 'derived.artifact.staled' WHEN x % 47 = 3 THEN 'derived.artifact.moved' ELSE 'derived.artifact.created' END AS kind, CASE WHEN x % 67 = 3 THEN 'sha256:said' ELSE hash END AS said,
    CASE WHEN snap IS NULL THEN [] WHEN x % 61 = 3 THEN ['s-none'] ELSE [snap] END AS snaps FROM e
), t AS (
  SELECT *, '{"derivation_verification_level":"DV2","input_artifact_ids":[' || coalesce(array_to_string(list_transform(inputs, lambda i: '"' || i || '"'), ','), '') || '],"kind":"' || kind || '","metadata":{"receipt_schema_version":"' || CASE WHEN x % 71 = 3 THEN '2' ELSE '1' END || '"' ||
    CASE WHEN x % 59 = 3 THEN ',"transform":{"code_hash":"c","config_hash":"g","name":"other","runtime_hash":"r","transform_id":"t1","version":"1"}' ELSE '' END || '},"output_hash":"' || said || '","source_snapshot_ids":[' || coalesce(array_to_string(list_transform(snaps, lambda i: '"' || i || '"'), ','), '') ||
    '],"status":"verified","subject_id":"' || id || '","transform_id":"' || tr || '"}' AS payload FROM r
), a AS (SELECT id, x % 11 <> 3 AND NOT (type = 'source_chunk' AND x % 103 = 3) AS ok FROM t WHERE x % 97 <> 3
), lost AS (SELECT id, unnest(inputs) AS i FROM t
), bad_inputs AS (SELECT lost.id, list(CASE WHEN a.id IS NULL THEN 'input artifact not found: ' ELSE 'input artifact is not admissible: ' END || i) AS l FROM lost LEFT JOIN a ON a.id = lost.i WHERE a.id IS NULL OR NOT a.ok GROUP BY lost.id
), g AS (
  SELECT t.*, 'drcpt_' || substr(sha256(payload || CASE WHEN x % 73 = 3 THEN 'x' ELSE '' END), 1, 24) AS rid, x % 79 <> 3 AND x % 83 <> 3 AS whole, coalesce(l, []) AS l FROM t LEFT JOIN bad_inputs ON bad_inputs.id = t.id
), h AS (
  SELECT *, list_filter([
    CASE WHEN x % 79 = 3 THEN 'receipt_json must decode to an object' END,
    CASE WHEN x % 79 <> 3 AND x % 83 = 3 THEN 'receipt_json missing fields: created_at, receipt_id' END,
    CASE WHEN whole AND x % 89 = 3 THEN 'receipt_json status does not match receipts row' END,
    CASE WHEN whole AND kind = 'derived.artifact.moved' THEN 'unknown receipt kind' END,
    CASE WHEN whole AND x % 71 = 3 THEN 'unsupported receipt_schema_version' END,
    CASE WHEN whole AND rid <> 'drcpt_' || substr(sha256(payload), 1, 24) THEN 'receipt_id does not match canonical receipt payload' END,
    CASE WHEN whole AND len(snaps) > 0 AND (x % 61 = 3 OR d % 37 = 3) THEN 'source snapshot not found: ' || snaps[1] END,
    CASE WHEN whole AND x % 97 = 3 THEN 'subject artifact not found' END,
    CASE WHEN whole AND tr = 't9' THEN 'transform not found' END], lambda m: m IS NOT NULL) || CASE WHEN whole THEN l ELSE [] END AS ground FROM g
), i AS (
  SELECT *, list_filter([
    CASE WHEN kind = 'derived.artifact.created' AND x % 101 = 3 THEN 'artifact receipt_id does not match receipt' END,
    CASE WHEN said <> hash THEN 'artifact output_hash does not match receipt' END,
    CASE WHEN kind = 'derived.artifact.created' AND len(inputs) > 0 AND x % 13 = 3 THEN 'artifact input_artifact_ids do not match receipt' END,
    CASE WHEN x % 59 = 3 AND tr <> 't1' THEN 'receipt transform transform_id does not match committed transform' END,
    CASE WHEN x % 59 = 3 THEN 'receipt transform name does not match committed transform' END,
    CASE WHEN kind <> 'derived.artifact.created' OR type <> 'source_chunk' THEN NULL WHEN d % 37 = 3 THEN 'source snapshot not found' WHEN d % 41 = 3 THEN 'source snapshot does not contain recomputable content_text'
      WHEN d % 23 = 3 THEN 'source snapshot content_text hash does not match content_hash' WHEN tr = 't2' THEN 'unsupported transform for recompute: digester' WHEN NOT inside THEN 'artifact chunk_index is outside recomputed chunk range' WHEN made <> hash THEN 'recomputed output hash does not match artifact' END],
    lambda m: m IS NOT NULL) AS later FROM h
)
SELECT id AS subject_id, rid AS receipt_id, CASE WHEN len(ground) > 0 THEN 'DV0' WHEN kind = 'derived.artifact.created' AND type = 'source_chunk' THEN CASE WHEN len(later) = 0 THEN 'DV2' ELSE 'DV1' END WHEN len(later) = 0 THEN 'DV1' ELSE 'DV0' END AS level,
  CASE WHEN len(ground) + CASE WHEN len(ground) > 0 THEN 0 ELSE len(later) END = 0 THEN 'verified' ELSE 'failed' END AS status, coalesce(array_to_string(list_sort(CASE WHEN len(ground) > 0 THEN ground ELSE later END), '; '), '') AS errors FROM i
""",
    "store_after_plan": """
SELECT 'a' || k AS artifact_id, 's' || c AS snapshot_id, CASE WHEN k % 5 > 1 THEN 'new' ELSE 'old' END || k AS receipt_id, 'DV2' AS level,
  CASE WHEN k % 13 = 4 AND (k % 5 <= 1 OR k % 7 < 5) THEN 'tombstoned' WHEN k % 13 <> 4 AND k % 11 = 4 AND (k % 5 <= 1 OR k % 7 < 4) THEN 'stale' ELSE 'active' END AS status
FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders) WHERE k % 3 > 0 OR k % 5 > 1
""",
}
