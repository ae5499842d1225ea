"""Registered queries: coverage, comparability, texts and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import shared_folder
from ..operators import comparability, coverage, textgate
from ..sources.receipts import from_events
from ..streaming import streams
from .audit_jobs import _PAIRS, _pairs
from .views import RECEIPTS, receipts, sql, table

CONTRACTS = [
    ("v1", 1, "models", "exact", "INVALIDATING", "INSTRUMENT_IDENTITY", "REQUIRED", None),
    ("v1", 2, "calls", "within_threshold", "DEGRADING", "SAMPLE", "REQUIRED", 25.0),
    ("v1", 3, "providers", "content_hash", "INVALIDATING", "INSTRUMENT_IDENTITY", "REQUIRED", None),
    ("v1", 4, "first_error", "version_match", "INFORMATIONAL", "OUTCOME", "OPTIONAL", None),
    ("v1", 5, "operator", "exact", "INFORMATIONAL", "OUTCOME", "OPTIONAL", None),
    ("v2", 1, "models", "exact", "DEGRADING", "INSTRUMENT_IDENTITY", "REQUIRED", None),
    ("v2", 2, "calls", "within_threshold", "DEGRADING", "SAMPLE", "REQUIRED", 5.0),
    ("v2", 3, "tokens", "within_threshold", "INVALIDATING", "SAMPLE", "REQUIRED", 4000.0),
]
DOMAINS = ["*.example.com", "example.org", "docs.*.net", "*"]


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each pack in long form: ref, field, type, value."""
    r = receipts(spark, sf_dir).where("type = 'model_call'")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    one = r.groupBy("pack_id").agg(names(F.when(F.col("k") % 19 < 12, F.col("model_id"))).alias("models"), names("provider").alias("providers"), F.count("*").cast("string").alias("calls"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("first_error"), F.sum("input_tokens").cast("string").alias("tokens"))
    fields = {"models": "STRING", "providers": "STRING", "calls": "BIGINT", "first_error": "STRING", "tokens": "BIGINT"}
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("type"), F.col(f).alias("value")) for f, t in fields.items()]))
    return one.select(F.col("pack_id").alias("ref"), long.alias("x")).select("ref", "x.*").where("field <> 'calls' or cast(substring(ref, 3) as int) % 5 <> 4")


def _bundle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("pair_id", F.col("pack_a").alias("baseline"), F.col("pack_b").alias("candidate"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparability.compare(_bundle_pairs(spark, sf_dir), bundles(spark, sf_dir), comparability.contract_table(spark, CONTRACTS))


def contract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)


def contract_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparability.verdicts(_compared(spark, sf_dir))


def contract_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = comparability.verdicts(_compared(spark, sf_dir))
    side = lambda v: found.where(F.col("contract") == v).select("pair_id", F.col("verdict").alias(f"{v}_verdict"))
    return side("v1").join(side("v2"), "pair_id").withColumn("flipped", F.col("v1_verdict") != F.col("v2_verdict"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order items as call sites of a repository (their supplier)."""
    items = table(spark, sf_dir, "lineitem")
    level = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    path = F.concat(F.when(F.col("l_partkey") % 5 == 0, "tests/").otherwise("src/"), F.lit("m"), F.col("l_partkey") % 30, F.lit(".py"))
    framework = F.when(F.col("l_orderkey") % 6 == 0, "langchain").when(F.col("l_orderkey") % 6 == 1, "openai")
    return items.groupBy(F.concat(F.lit("repo"), "l_suppkey").alias("project"), path.alias("path"), (F.col("l_orderkey") % 400).alias("line")).agg(F.max(level).alias("confidence"), F.max(framework).alias("framework"), F.bool_or(F.col("l_linestatus") == "F").alias("instrumented"))


def coverage_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.contract(_findings(spark, sf_dir))


def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    seen = found.where("line % 3 <> 0").select("project", coverage.callsite_id(F.col("path"), F.col("line")).alias("callsite_id"))
    return coverage.verify(coverage.contract(found), seen).withColumn("pct", F.round("pct", 6))


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.scan_summary(_findings(spark, sf_dir))


def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.gap_report(_findings(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


def scan_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.study(coverage.scan_summary(_findings(spark, sf_dir)))


def top_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.top_repositories(_findings(spark, sf_dir))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textgate.line_chunks(table(spark, sf_dir, "documents"), 8).drop("text")


def index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents against the index of those that were there before."""
    chunks = textgate.line_chunks(table(spark, sf_dir, "documents"), 8).select("doc_id", "chunk", "sha256")
    was = chunks.where("doc_id % 7 <> 1").withColumn("sha256", F.when((F.col("doc_id") + F.col("chunk")) % 5 == 0, F.lit("old")).otherwise(F.col("sha256")))
    now = chunks.where("doc_id % 11 <> 2")
    return textgate.plan_index(now, was, ["chunk", "sha256"], "doc_id")


def claim_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations after the one before them, with markers from the turn's number."""
    c = table(spark, sf_dir, "conversations")
    old = F.concat(F.element_at(F.array(*map(F.lit, ("an experimental draft", "it may work locally", "a suggestion", "risk  reduced here", "observed"))), (F.col("turn") % 5 + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    new = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.element_at(F.array(*map(F.lit, ("Production-ready and reliable", "it will always work", "you should", "SAFE, because", "it led\tto all"))), (F.col("conv_id") % 5 + 1).cast("int")))
    pairs = c.select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), old.alias("before"), new.alias("after"))
    return textgate.claim_transitions(pairs, "turn_id", "before", "after")


def url_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", textgate.match_domain(F.col("url"), DOMAINS).alias("pattern"))


def question_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(textgate.question_hint(F.col("text")).alias("hint"), textgate.claim_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("turns"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a file source reads folders; a pattern also takes the one file of a small table
    return from_events(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))


def _landed(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    path = f"{shared_folder(spark)}/tracewell-{uuid.uuid4().hex}/stream"
    streams.run_available(stream, path, mode)
    return spark.read.schema(stream.schema).parquet(path)


def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows of the stream: those that end before the last event less the watermark."""
    landed = _landed(spark, streams.usage(_stream(spark, sf_dir), "1 hour"))
    return landed.select(F.unix_seconds(F.col("window.start")).alias("start_s"), "model_id", "calls", "total_tokens", F.round("cost_usd", 6).alias("cost_usd"), "errors")


def deny_rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _landed(spark, streams.deny_rates(_stream(spark, sf_dir), "6 hours"))
    return landed.select(F.unix_seconds(F.col("window.start")).alias("start_s"), "total", "denied")


def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _landed(spark, streams.dedup(_stream(spark, sf_dir), "100 days"))
    return landed.groupBy("pack_id").agg(F.count("*").alias("receipts"), F.count_distinct("receipt_id").alias("ids"))


QUERIES = {f.__name__: f for f in (contract_fields, contract_verdicts, contract_flips, coverage_contract, coverage_check, scan_summary, gap_report, scan_study, top_repositories, line_chunks, index_plan, claim_transitions, url_allowlist, question_hints, usage_stream, deny_rate_stream, dedup_stream)}

_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in CONTRACTS)
_COMPARED = _PAIRS + f""", one AS (
  SELECT pack_id, array_to_string(list_sort(list(DISTINCT model_id) FILTER (k % 19 < 12)), ',') AS models, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, count(*)::VARCHAR AS calls, arg_min(error, seq) FILTER (error IS NOT NULL) AS first_error, sum(input_tokens)::VARCHAR AS tokens FROM calls GROUP BY pack_id
), b AS (SELECT pack_id AS ref, 'models' AS field, models AS v FROM one UNION ALL SELECT pack_id, 'providers', providers FROM one UNION ALL SELECT pack_id, 'calls', calls FROM one WHERE CAST(substr(pack_id, 3) AS INT) % 5 <> 4 UNION ALL SELECT pack_id, 'first_error', first_error FROM one UNION ALL SELECT pack_id, 'tokens', tokens FROM one
), con(contract, ord, field, rule, severity, grp, requirement, threshold) AS (VALUES {_VALUES}
), j AS (SELECT p.pair_id, con.*, x.v AS av, y.v AS bv, x.ref IS NOT NULL AND y.ref IS NOT NULL AS has FROM pairs p CROSS JOIN con LEFT JOIN b x ON x.ref = pack_a AND x.field = con.field LEFT JOIN b y ON y.ref = pack_b AND y.field = con.field
), cmpd AS (SELECT pair_id, contract, ord, field, severity, grp, CASE WHEN NOT has THEN CASE WHEN requirement = 'REQUIRED' THEN 'missing' ELSE 'absent' END WHEN coalesce(CASE WHEN rule = 'within_threshold' THEN abs(TRY_CAST(av AS DOUBLE) - TRY_CAST(bv AS DOUBLE)) <= threshold ELSE av = bv END, FALSE) THEN 'matched' ELSE 'mismatched' END AS state FROM j
), ver AS (SELECT *, CASE WHEN invalidating > 0 THEN 'DENIED' WHEN degrading > 0 AND missing = 0 THEN 'DOWNGRADED' WHEN missing > 0 THEN 'UNDETERMINED' ELSE 'SATISFIED' END AS verdict FROM (
  SELECT pair_id, contract, count_if(state = 'mismatched' AND severity = 'INVALIDATING')::BIGINT AS invalidating, count_if(state = 'mismatched' AND severity = 'DEGRADING')::BIGINT AS degrading, count_if(state = 'missing')::BIGINT AS missing, count_if(state = 'matched')::BIGINT AS matched, count_if(state = 'mismatched' AND grp = 'INSTRUMENT_IDENTITY')::BIGINT AS instrument_changes FROM cmpd GROUP BY ALL))
"""

_FOUND = """WITH fnd AS (SELECT 'repo' || l_suppkey AS project, CASE WHEN l_partkey % 5 = 0 THEN 'tests/' ELSE 'src/' END || 'm' || (l_partkey % 30) || '.py' AS path, l_orderkey % 400 AS line,
  max(CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END) AS confidence, max(CASE l_orderkey % 6 WHEN 0 THEN 'langchain' WHEN 1 THEN 'openai' END) AS framework, bool_or(l_linestatus = 'F') AS instrumented FROM lineitem GROUP BY ALL)
, sites AS (SELECT DISTINCT project, substr(sha256(path || ':' || line), 1, 12) AS callsite_id, path, line FROM fnd WHERE confidence <> 'low' AND coalesce(framework, '') NOT IN ('langchain', 'litellm'))
, scan AS (SELECT project, count(*) AS sites_total, count_if(instrumented)::BIGINT AS instrumented, count_if(NOT instrumented)::BIGINT AS uninstrumented, count_if(NOT instrumented AND confidence = 'high')::BIGINT AS high, count_if(NOT instrumented AND confidence = 'medium')::BIGINT AS medium, count_if(NOT instrumented AND confidence = 'low')::BIGINT AS low FROM fnd GROUP BY project)
"""

_CHUNKS = """WITH ln AS (SELECT doc_id, string_split_regex(regexp_replace(text, '(\\r\\n|[\\n\\r])$', ''), '\\r\\n|[\\n\\r]') AS l FROM documents WHERE text <> '')
, ch AS (SELECT doc_id, unnest(range(0, len(l), 8)) AS at_, l FROM ln)
, chunks AS (SELECT doc_id, (at_ // 8)::INT AS chunk, (at_ + 1)::INT AS start_line, least(at_ + 8, len(l))::INT AS end_line, sha256(array_to_string(l[at_ + 1:at_ + 8], chr(10))) AS sha256 FROM ch)
"""

ORACLES = {
    "contract_fields": sql(_COMPARED + "SELECT * FROM cmpd"),
    "contract_verdicts": sql(_COMPARED + "SELECT * FROM ver"),
    "contract_flips": sql(_COMPARED + "SELECT a.pair_id, a.verdict AS v1_verdict, b.verdict AS v2_verdict, a.verdict <> b.verdict AS flipped FROM ver a JOIN ver b ON a.pair_id = b.pair_id AND a.contract = 'v1' AND b.contract = 'v2'"),
    "coverage_contract": _FOUND + "SELECT * FROM sites",
    "coverage_check": _FOUND + """, seen AS (SELECT DISTINCT project, substr(sha256(path || ':' || line), 1, 12) AS callsite_id FROM fnd WHERE line % 3 <> 0), want AS (SELECT DISTINCT project, callsite_id FROM sites)
SELECT project, count_if(w.callsite_id IS NOT NULL AND s.callsite_id IS NOT NULL)::BIGINT AS covered, count_if(s.callsite_id IS NULL)::BIGINT AS uncovered, count_if(w.callsite_id IS NULL)::BIGINT AS extra,
  round(CASE WHEN count(w.callsite_id) = 0 THEN 1 ELSE count_if(w.callsite_id IS NOT NULL AND s.callsite_id IS NOT NULL) / count(w.callsite_id) END, 6) AS pct FROM want w FULL JOIN seen s USING (project, callsite_id) GROUP BY project""",
    "scan_summary": _FOUND + "SELECT * FROM scan",
    "gap_report": _FOUND + """, g AS (SELECT project, count(*) AS counted, count_if(instrumented)::BIGINT AS covered, count_if(path NOT LIKE 'tests/%' AND NOT instrumented)::BIGINT AS production_gaps, count_if(path LIKE 'tests/%' AND NOT instrumented)::BIGINT AS test_gaps FROM fnd WHERE confidence <> 'low' GROUP BY project)
SELECT e.project, e.findings, coalesce(counted, 0) AS counted, coalesce(covered, 0) AS covered, coalesce(production_gaps, 0) AS production_gaps, coalesce(test_gaps, 0) AS test_gaps, round(CASE WHEN counted > 0 THEN covered / counted * 100 ELSE 0 END, 6) AS pct FROM (SELECT project, count(*) AS findings FROM fnd GROUP BY project) e LEFT JOIN g USING (project)""",
    "scan_study": _FOUND + "SELECT count(*) AS repositories, sum(sites_total)::BIGINT AS sites, sum(instrumented)::BIGINT AS instrumented, sum(high)::BIGINT AS high, count_if(sites_total > 0 AND instrumented = 0)::BIGINT AS none, count_if(instrumented > 0 AND instrumented < sites_total)::BIGINT AS partial, count_if(sites_total > 0 AND instrumented = sites_total)::BIGINT AS \"full\" FROM scan",
    "top_repositories": _FOUND + """, r AS (SELECT project, high, uninstrumented AS n FROM scan WHERE uninstrumented > 0 ORDER BY high DESC, project LIMIT 10)
, o AS (SELECT f.*, r.high, r.n, row_number() OVER (PARTITION BY project ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, path, line) AS nth FROM fnd f JOIN r USING (project) WHERE NOT instrumented)
SELECT project, nth, path, line, confidence, high, greatest(n - 5, 0) AS remaining FROM o WHERE nth <= 5""",
    "line_chunks": _CHUNKS + "SELECT * FROM chunks",
    "index_plan": _CHUNKS + """, was AS (SELECT DISTINCT doc_id, chunk, CASE WHEN (doc_id + chunk) % 5 = 0 THEN 'old' ELSE sha256 END AS sha256 FROM chunks WHERE doc_id % 7 <> 1), now AS (SELECT DISTINCT doc_id, chunk, sha256 FROM chunks WHERE doc_id % 11 <> 2)
SELECT doc_id, chunk, sha256, CASE WHEN w.o IS NULL THEN 'add' WHEN n.o IS NOT NULL THEN 'keep' WHEN doc_id IN (SELECT doc_id FROM now) THEN 'stale' ELSE 'tombstone' END AS action FROM (SELECT *, 1 AS o FROM now) n FULL JOIN (SELECT *, 1 AS o FROM was) w USING (doc_id, chunk, sha256)""",
    "url_allowlist": "WITH h AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages) SELECT page_id, CASE WHEN host = '' OR host IS NULL THEN NULL WHEN host = 'example.com' OR host LIKE '%.example.com' THEN '*.example.com' WHEN host = 'example.org' THEN 'example.org' WHEN host LIKE 'docs.%.net' THEN 'docs.*.net' ELSE '*' END AS pattern FROM h",
    "question_hints": """SELECT CASE WHEN regexp_matches(t, '^(do|does|is|are|can|will|have|has) ') THEN 'yes_no' WHEN regexp_matches(t, 'how many|number|count|%|latency|cost') THEN 'numeric' WHEN t IS NULL THEN 'free_text' ELSE 'free_text' END AS hint,
  CASE WHEN regexp_matches(t, 'soc 2|iso|certif|attest') THEN 'CERTIFICATION' WHEN regexp_matches(t, 'incident|breach|outage|security event') THEN 'INCIDENT' WHEN regexp_matches(t, 'metric|count|number|latency|token|cost') THEN 'METRIC' WHEN regexp_matches(t, 'commit|roadmap|guarantee|promise') THEN 'COMMITMENT' WHEN regexp_matches(t, 'gdpr|dpa|legal|contract|privacy law') THEN 'LEGAL' WHEN regexp_matches(t, 'process|policy|procedure|review') THEN 'PROCESS' ELSE 'TECH_CONTROL' END AS kind, count(*) AS turns
FROM (SELECT lower(trim(text)) AS t FROM conversations) GROUP BY ALL""",
    "usage_stream": "WITH RECURSIVE " + RECEIPTS.strip() + """, w AS (SELECT *, epoch_us(ts) // 3600000000 * 3600 AS start_s FROM calls), last AS (SELECT max(epoch_us(ts)) - 600000000 AS mark FROM events)
SELECT start_s, model_id, count(*) AS calls, sum(all_tokens)::BIGINT AS total_tokens, round(sum(cost_usd), 6) AS cost_usd, count_if(failed)::BIGINT AS errors FROM w, last WHERE (start_s + 3600) * 1000000 <= mark GROUP BY ALL""",
    "deny_rate_stream": "WITH RECURSIVE " + RECEIPTS.strip() + """, w AS (SELECT *, epoch_us(ts) // 21600000000 * 21600 AS start_s FROM receipts), last AS (SELECT max(epoch_us(ts)) - 600000000 AS mark FROM events)
SELECT start_s, count(*) AS total, count_if(NOT coalesce(allowed, TRUE) OR coalesce(policy_verdict = 'deny', FALSE))::BIGINT AS denied FROM w, last WHERE (start_s + 21600) * 1000000 <= mark GROUP BY start_s""",
    "dedup_stream": sql("\nSELECT pack_id, count(DISTINCT receipt_id) AS receipts, count(DISTINCT receipt_id) AS ids FROM receipts GROUP BY pack_id"),
}
