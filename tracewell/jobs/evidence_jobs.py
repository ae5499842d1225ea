"""Registered queries: items as references to evidence in orders and suppliers, digests of packs, documents as questionnaires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence
from .views import table


def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are packs, their orders receipts; every item refers to something of its order's pack, some to nothing."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda letter, n: F.concat(F.lit(letter), n)
    raw = F.concat(F.lit('{"a":{"n":'), k % 7 - 2, F.lit(',"list":[{"ok":'), F.when(k % 3 == 0, "true").otherwise("false"), F.lit('},"'), F.when(k % 4 == 0, " Yes ").otherwise("maybe"), F.lit('",null]},"x/y":"'), "o_orderstatus", F.lit('"}'))
    receipts = o.where(k % 23 != 4).select(name("p", c).alias("pack_id"), name("r", k).alias("receipt_id"), raw.alias("raw"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    packs = cust.where("c % 29 <> 4").select(name("p", F.col("c")).alias("pack_id"), F.concat(F.lit('{"passed":'), F.when(F.col("c") % 2 == 0, "true").otherwise("false"), F.lit("}")).alias("report"), F.when(F.col("c") % 5 == 0, "ok").otherwise("long text").alias("transcript"))
    files = cust.where("c % 31 <> 4").select(name("p", F.col("c")).alias("pack_id"), F.lit("f").alias("path"), F.concat(F.lit('{"bytes":'), F.col("c"), F.lit("}")).alias("entry"))
    p = F.col("l_partkey")
    kind = F.when(p % 10 < 7, "RECEIPT").when(p % 10 == 7, "REPORT_SECTION").when(p % 10 == 8, "PACK_TRANSCRIPT").when(p % 50 == 9, "LETTER").otherwise("FILE_HASH")
    pointers = ("a.n", "/a/list/0/ok", "a.list.1", "/x~1y", "a.list.2", "a.list.9", "", "passed", "text", "bytes")
    pointer = F.element_at(F.array(*map(F.lit, pointers)), (p % 10 + 1).cast("int"))
    refs = i.join(o.select(k.alias("l_orderkey"), c), "l_orderkey").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ref_id"), name("p", c).alias("pack_id"), kind.alias("evidence_kind"), name("r", F.col("l_orderkey")).alias("receipt_id"), F.when(p % 20 == 9, "f").otherwise("g").alias("path"), pointer.alias("pointer"))
    found = evidence.resolve_refs(refs, packs, receipts, files)
    return found.groupBy("evidence_kind", "pointer", "status", "value_type", "affirmative", F.coalesce("number", F.lit(-99.0)).alias("number")).agg(F.count("*").alias("n"))


def pack_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as packs, whose files are every third of their orders."""
    o = table(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    packs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pack_id"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("manifest_sha256"))
    files = o.where("o_orderkey % 3 = 0").select(c.cast("string").alias("pack_id"), F.concat(F.lit("f"), "o_orderkey").alias("path"), F.sha2("o_orderstatus", 256).alias("sha256"))
    return evidence.pack_index(packs, files, o.select(c.cast("string").alias("pack_id")))


def markdown_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questionnaires; of some, every seventh line becomes a fence, a heading or an item with an id."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    mark = lambda x, i: F.when(i % 7 == 2, F.when(F.col("doc_id") % 3 == 0, F.lit("```")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("# "), x)).otherwise(F.concat(F.lit("- Q"), i, F.lit(": "), x))).otherwise(x)
    text = F.array_join(F.transform(F.split("text", "\n"), mark), "\n")
    found = evidence.questions_of_markdown(d.select(F.col("doc_id").alias("file"), F.translate(text, "\r\x0b\x0c\x1c\x1d\x1e\x85  ", "").alias("text")))
    return found.select("file", "line", "question_id", F.sha2("question_text", 256).alias("text_sha256"), "type_hint")


QUERIES = {f.__name__: f for f in (evidence_refs, pack_digests, markdown_questions)}
ORACLES = {
    "evidence_refs": """
WITH i AS (
  SELECT l_partkey AS p, o_orderkey AS k, o_custkey AS c, o_orderstatus AS st FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), r AS (
  SELECT *, CASE WHEN p % 10 < 7 THEN 'RECEIPT' WHEN p % 10 = 7 THEN 'REPORT_SECTION' WHEN p % 10 = 8 THEN 'PACK_TRANSCRIPT' WHEN p % 50 = 9 THEN 'LETTER' ELSE 'FILE_HASH' END AS evidence_kind,
    ['a.n', '/a/list/0/ok', 'a.list.1', '/x~1y', 'a.list.2', 'a.list.9', '', 'passed', 'text', 'bytes'][p % 10 + 1] AS pointer,
    c % 29 <> 4 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = c) AS known FROM i
), s AS (
  SELECT *, CASE WHEN NOT known THEN 'pack_not_found' WHEN evidence_kind = 'LETTER' THEN 'unknown_evidence_kind' WHEN evidence_kind = 'RECEIPT' AND k % 23 = 4 THEN 'receipt_not_found'
    WHEN evidence_kind = 'FILE_HASH' AND (p % 20 <> 9 OR c % 31 = 4) THEN 'file_hash_target_not_found' WHEN p % 10 = 5 THEN 'target_pointer_not_found' ELSE 'ok' END AS status FROM r
)
SELECT evidence_kind, pointer, status,
  CASE WHEN status = 'ok' THEN CASE p % 10 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' WHEN 2 THEN 'string' WHEN 3 THEN 'string' WHEN 4 THEN 'null' WHEN 6 THEN 'object' WHEN 7 THEN 'boolean' WHEN 8 THEN 'string' ELSE 'number' END END AS value_type,
  status = 'ok' AND CASE p % 10 WHEN 0 THEN k % 7 > 2 WHEN 1 THEN k % 3 = 0 WHEN 2 THEN k % 4 = 0 WHEN 7 THEN c % 2 = 0 WHEN 8 THEN c % 5 = 0 WHEN 9 THEN c > 0 ELSE FALSE END AS affirmative,
  CASE WHEN status = 'ok' AND p % 10 = 0 THEN CAST(k % 7 - 2 AS DOUBLE) WHEN status = 'ok' AND p % 10 = 9 THEN CAST(c AS DOUBLE) ELSE -99.0 END AS number, count(*) AS n
FROM s GROUP BY ALL
""",
    "pack_digests": """
SELECT CAST(c_custkey AS VARCHAR) AS pack_id, sha256('{"files":[' || coalesce((SELECT string_agg('{"path":"f' || o_orderkey || '","sha256":"' || sha256(o_orderstatus) || '"}', ',' ORDER BY 'f' || o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0), '') || '],"manifest_sha256":"' || sha256(CAST(c_custkey AS VARCHAR)) || '","pack_id":"' || c_custkey || '"}') AS digest,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS receipts FROM customer
""",
    "markdown_questions": r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), x AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM d
), y AS (
  SELECT doc_id, i, trim(regexp_replace(CASE WHEN (i - 1) % 7 <> 2 THEN raw WHEN doc_id % 3 = 0 THEN '```' WHEN doc_id % 3 = 1 THEN '# ' || raw ELSE '- Q' || (i - 1) || ': ' || raw END, '[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', '', 'g'), E' \t 　') AS t FROM x
), z AS (
  SELECT *, sum(CASE WHEN starts_with(t, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM y
), w AS (
  SELECT doc_id, i, CASE WHEN regexp_matches(t, '^(?:[-*]|\d+[.)])\s+(.*)$') THEN trim(regexp_extract(t, '^(?:[-*]|\d+[.)])\s+(.*)$', 1)) ELSE t END AS t FROM z WHERE NOT starts_with(t, '```') AND fences % 2 = 0 AND t <> '' AND NOT starts_with(t, '#')
), v AS (
  SELECT *, regexp_matches(t, '^(Q\d+|q\d+|[A-Za-z_][A-Za-z0-9_\-]*):\s+(.*)$') AS own FROM w
), n AS (
  SELECT *, sum(CASE WHEN own THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM v
), q AS (
  SELECT doc_id AS file, i AS line, CASE WHEN own THEN regexp_extract(t, '^(Q\d+|q\d+|[A-Za-z_][A-Za-z0-9_\-]*):\s+(.*)$', 1) WHEN n < 1000 THEN 'q' || lpad(CAST(CAST(n AS BIGINT) AS VARCHAR), 3, '0') ELSE 'q' || CAST(n AS BIGINT) END AS question_id,
    trim(CASE WHEN own THEN regexp_extract(t, '^(Q\d+|q\d+|[A-Za-z_][A-Za-z0-9_\-]*):\s+(.*)$', 2) ELSE t END) AS text FROM n
)
SELECT file, line, question_id, sha256(text) AS text_sha256, CASE WHEN regexp_matches(lower(text), '^(do|does|is|are|can|will|have|has) ') THEN 'yes_no' WHEN regexp_matches(lower(text), 'how many|number|count|%|latency|cost') THEN 'numeric' ELSE 'free_text' END AS type_hint
FROM q WHERE text <> ''
""",
}
