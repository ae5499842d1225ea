"""Registered queries: packs built from the event stream, some spoilt by rule, verified from their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import settle
from ..operators import packs
from .views import table

NOW, AGE = "2024-01-31 00:00:00", 8.0


def _quoted(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))


def pack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_id, path, content): each user's events are a pack of four files. By the user's number modulo 20 something is
    changed after the manifest was made: bytes, lines, files, hashes, signatures, paths, the manifest's own fields."""
    e = table(spark, sf_dir, "events")
    u, k = F.col("user_id"), F.regexp_extract("props", "([0-9]+)", 1)
    name = F.concat(F.lit("r_"), F.when(u % 20 == 12, F.pmod(k.cast("long"), F.lit(50))).otherwise(F.col("event_id")))
    line = F.concat(F.lit('{"receipt_id":"'), name, F.lit('","seq":'), "event_id", F.lit(',"signature":"s'), k, F.lit('","timestamp":"'), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit('","type":"'), "event_type", F.lit('"}'))
    p = e.select(u, F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), line.alias("line")).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]).alias("lines"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ended"))
    m = u % 20
    text = lambda a: F.concat(F.array_join(a, "\n"), F.lit("\n"))
    p = p.select("user_id", "lines", "ended", F.concat(F.lit("t_"), u).alias("pack_id"), F.size("lines").alias("n"), text(F.col("lines")).alias("good"))
    head = F.sha2(F.regexp_replace(F.element_at("lines", -1), '"signature":"[^"]*",', ""), 256)
    p = p.withColumn("head", head).withColumn("sha", F.sha2("good", 256))
    claim = F.when(m == 15, "FAIL").otherwise("PASS")
    attest = lambda n: F.concat(F.lit("{"), _quoted("head_hash", F.col("head")), F.lit(',"n_receipts":'), n, F.lit(","), _quoted("pack_id", F.col("pack_id")), F.lit(","), _quoted("receipt_integrity", claim), F.lit(","), _quoted("timestamp_end", F.col("ended")), F.lit("}"))
    p = p.withColumn("attested", attest(F.col("n"))).withColumn("attested_sha", F.sha2("attested", 256))
    sig, key = F.base64(F.concat(F.lit("signature of "), "pack_id")), F.base64(F.concat(F.lit("key of "), "pack_id"))
    entry = lambda path, sha, n: F.concat(F.lit('{"bytes":'), n, F.lit(","), _quoted("path", path), F.lit(","), _quoted("sha256", sha), F.lit("}"))
    where = F.when(m == 10, "../receipt_pack.jsonl").when(m == 18, "a/../receipt_pack.jsonl").otherwise("receipt_pack.jsonl")
    fields = [
        F.concat(F.lit('"attestation":'), F.when(m == 4, attest(F.col("n") + 1)).otherwise(F.col("attested"))),
        _quoted("attestation_sha256", F.col("attested_sha")),
        F.lit('"claim_set_hash":"c","claim_set_id":"c","expected_files":["receipt_pack.jsonl","verify_report.json","verify_transcript.md"]'),
        F.concat(F.lit('"files":['), entry(where, F.col("sha"), F.length("good")), F.lit(","), entry(F.lit("verify_report.json"), F.sha2(F.lit("{}"), 256), F.lit("2")), F.lit("]")),
        F.lit('"hash_alg":"sha256","manifest_version":"1"'),
        _quoted("pack_id", F.col("pack_id")),
        _quoted("pack_root_sha256", F.when(m == 5, F.col("sha")).otherwise(F.col("attested_sha"))),
        F.concat(F.lit('"pack_version":"1","receipt_count_expected":'), "n"),
        _quoted("signature", F.when(m == 6, "").otherwise(sig)),
        F.lit('"signature_alg":"ed25519","signature_scope":"all","signer_id":"s"'),
        _quoted("signer_pubkey", key),
        _quoted("signer_pubkey_sha256", F.sha2(F.concat(F.lit("key of "), F.when(m == 9, F.lit("another")).otherwise(F.col("pack_id"))), 256)),
        F.when(m != 16, '"suite_hash":"s"').when(u % 40 == 16, '"suite":"s"'),
    ]
    manifest = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.when(m == 17, "").otherwise("}"))
    lines = F.col("lines")
    bad = lambda extra: F.concat(lines, F.array(F.lit(extra)))
    body = (
        F.when(m == 1, F.encode(F.regexp_replace("good", "^(.*?)signature", "$1sigNature"), "UTF-8"))
        .when(m == 2, F.encode(F.when(F.col("n") > 1, text(F.slice(lines, 1, F.col("n") - 1))).otherwise(""), "UTF-8"))
        .when(m == 11, F.encode(text(bad('{"receipt_id":')), "UTF-8"))
        .when(m == 13, F.encode(text(bad('{"receipt_id":"x","type":"t","timestamp":"2024-01-01","né":1}')), "UTF-8"))
        .when(m == 14, F.encode(text(bad('{"receipt_id":"x","timestamp":"soon"}')), "UTF-8"))
        .when(m == 19, F.concat(F.encode("good", "UTF-8"), F.unhex(F.lit("FF"))))
        .otherwise(F.encode("good", "UTF-8"))
    )
    detached = F.concat(F.lit("signature of "), F.when(m == 7, "another").otherwise(F.col("pack_id")))
    of = lambda path, content, keep: F.when(keep, F.struct(F.lit(path).alias("path"), content.alias("content")))
    always = F.lit(True)
    files = [of("pack_manifest.json", F.encode(manifest, "UTF-8"), always), of("receipt_pack.jsonl", body, m != 3), of("verify_report.json", F.encode(F.lit("{}"), "UTF-8"), always), of("verify_transcript.md", F.encode(F.lit("#"), "UTF-8"), (m != 3) | (u % 40 == 3)), of("pack_signature.sig", F.encode(detached, "UTF-8"), m != 8)]
    return p.select("pack_id", F.explode(F.array_compact(F.array(*files))).alias("f")).select("pack_id", "f.*")


def pack_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written, as each check of a pack reads its files anew
    return packs.verify(settle(pack_files(spark, sf_dir)), NOW, max_age_hours=AGE)


def pack_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = settle(pack_files(spark, sf_dir))
    return packs.stage_results(files, packs.verify(files, NOW, max_age_hours=AGE))


def pack_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pack_files(spark, sf_dir).where("path = 'pack_manifest.json'")
    n = F.regexp_extract("pack_id", "[0-9]+", 0).cast("long")
    rows = files.select(F.concat(F.lit("packs/"), "pack_id").alias("path"), (n * 7919 % 101).alias("modified"), F.col("content").cast("string").alias("raw"))
    return packs.catalog(rows, rows.where("modified % 10 = 3").select("path")).drop("started")


def pack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer writes of all events, packs of twenty users each, with each line's place and hash."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    raw = F.to_json(F.struct(F.when(u % 3 > 0, F.concat(F.lit("t_"), u)).alias("_trace_id"), F.lit("run").alias("run_id"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 7).alias("seq"), F.concat(F.lit("r_"), "event_id").alias("receipt_id"), F.lit("x").alias("signature"), F.struct(F.lit("y").alias("signature"), F.col("event_type").alias("a")).alias("payload")))
    rows = packs.canonical_receipts(e.select(F.concat(F.lit("p_"), u % 20).alias("pack_id"), raw.alias("raw")))
    return rows.select("pack_id", "trace", "seq", "receipt_id", F.sha2("line", 256).alias("line_sha256"))


_SQL = r"""
WITH ev AS (
  SELECT user_id AS u, event_id, ts, '{"receipt_id":"r_' || CASE WHEN user_id % 20 = 12 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 50 ELSE event_id END || '","seq":' || event_id ||
    ',"signature":"s' || regexp_extract(props, '([0-9]+)', 1) || '","timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '","type":"' || event_type || '"}' AS line FROM events
), p0 AS (
  SELECT u, list(line ORDER BY event_id) AS lines, count(*) AS n, max(ts) AS ended, u % 20 AS m FROM ev GROUP BY u
), p AS (
  SELECT *, 't_' || u AS pack_id, array_to_string(lines, chr(10)) || chr(10) AS good,
    CASE m WHEN 2 THEN lines[:n-1] WHEN 11 THEN lines || ['{"receipt_id":'] WHEN 13 THEN lines || ['{"receipt_id":"x","type":"t","timestamp":"2024-01-01","né":1}'] WHEN 14 THEN lines || ['{"receipt_id":"x","timestamp":"soon"}']
      WHEN 1 THEN [replace(lines[1], 'signature', 'sigNature')] || lines[2:] ELSE lines END AS real_lines FROM p0
), q AS (
  SELECT *, CASE WHEN len(real_lines) = 0 THEN '' ELSE array_to_string(real_lines, chr(10)) || chr(10) END AS body, sha256(good) AS sha,
    '{"head_hash":"' || sha256(regexp_replace(lines[n], '"signature":"[^"]*",', '')) || '","n_receipts":' AS a1,
    ',"pack_id":"' || pack_id || '","receipt_integrity":"' || CASE WHEN m = 15 THEN 'FAIL' ELSE 'PASS' END || '","timestamp_end":"' || strftime(ended, '%Y-%m-%d %H:%M:%S.%f') || '"}' AS a2 FROM p
), line AS (
  SELECT u, unnest(real_lines) AS line, generate_subscripts(real_lines, 1) AS i FROM q WHERE m NOT IN (3, 19)
), j AS (
  SELECT u, i, line, json_valid(line) AS ok FROM line
), good_lines AS (
  SELECT u, i, line, json_extract_string(line, '$.receipt_id') AS id, json_extract_string(line, '$.type') AS type, json_extract_string(line, '$.timestamp') AS told FROM j WHERE ok
), faults AS (
  SELECT u, count(*) FILTER (WHERE coalesce(id, '') = '') + count(*) FILTER (WHERE coalesce(type, '') = '') + count(*) FILTER (WHERE coalesce(told, '') = '') + count(*) FILTER (WHERE TRY_CAST(told AS TIMESTAMP) IS NULL)
    + count(*) FILTER (WHERE line <> CAST(line AS VARCHAR) OR regexp_matches(line, '"[^"]*[^\x00-\x7F][^"]*":')) + count(id) - count(DISTINCT id) AS faults FROM good_lines GROUP BY u
), b AS (
  SELECT u, count(*) AS n_real, bool_and(ok) AS parsed, min(i) FILTER (WHERE NOT ok) AS first_bad,
    arg_max_null(CASE WHEN NOT regexp_matches(line, '"[^"]*[^\x00-\x7F][^"]*":') THEN sha256(regexp_replace(line, '"signature":"[^"]*",', '')) END, i) AS head FROM j GROUP BY u
), r AS (
  SELECT q.*, coalesce(n_real, 0) AS n_real, m = 19 OR NOT coalesce(parsed, TRUE) AS broken, first_bad, coalesce(faults, 0) AS faults,
    CASE WHEN coalesce(n_real, 0) = 0 OR first_bad = 1 THEN sha256('empty') WHEN coalesce(parsed, TRUE) THEN head END AS real_head,
    m = 16 OR m = 17 AS stopped,
    CASE WHEN m = 3 THEN NULL WHEN m = 19 THEN sha256(encode(good) || '\xFF'::BLOB) ELSE sha256(body) END AS real_sha,
    CASE WHEN m = 19 THEN octet_length(encode(good)) + 1 ELSE octet_length(encode(body)) END AS real_size,
    CASE m WHEN 10 THEN '../receipt_pack.jsonl' WHEN 18 THEN 'a/../receipt_pack.jsonl' ELSE 'receipt_pack.jsonl' END AS path,
    epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ended) AS age
  FROM q LEFT JOIN b ON b.u = q.u LEFT JOIN faults ON faults.u = q.u
), found AS (
  SELECT pack_id, 'validate_schema' AS stage, 'error' AS severity, 'E_MANIFEST_TAMPER' AS code, unnest(CASE WHEN m = 17 THEN ['pack_manifest.json'] WHEN u % 40 = 16 THEN ['suite_hash', 'suite'] ELSE ['suite_hash'] END) AS field FROM r WHERE stopped
  UNION ALL SELECT pack_id, 'validate_paths', 'error', 'E_PATH_ESCAPE', path FROM r WHERE m = 10
  UNION ALL SELECT pack_id, 'validate_file_hashes', 'error', 'E_MANIFEST_TAMPER', path FROM r WHERE NOT stopped AND m <> 10 AND (real_sha IS NULL OR real_sha <> sha)
  UNION ALL SELECT pack_id, 'validate_file_hashes', 'warning', 'W_SIZE', path FROM r WHERE NOT stopped AND m NOT IN (3, 10) AND real_size <> octet_length(encode(good))
  UNION ALL SELECT pack_id, 'validate_file_hashes', 'error', 'E_MANIFEST_TAMPER', 'verify_transcript.md' FROM r WHERE m = 3 AND u % 40 <> 3
  UNION ALL SELECT pack_id, 'validate_receipts', 'error', 'E_MANIFEST_TAMPER', 'receipt_pack.jsonl' FROM r WHERE m = 19
  UNION ALL SELECT pack_id, 'validate_receipts', 'error', 'E_MANIFEST_TAMPER', 'receipt_pack.jsonl:' || first_bad FROM r WHERE NOT stopped AND first_bad IS NOT NULL
  UNION ALL SELECT pack_id, 'validate_receipts', 'error', 'E_PACK_OMISSION_DETECTED', 'receipt_count_expected' FROM r WHERE NOT stopped AND NOT broken AND n_real <> n
  UNION ALL SELECT pack_id, 'validate_receipts', 'error', 'E_MANIFEST_TAMPER', 'receipt_integrity' FROM r WHERE NOT stopped AND (CASE WHEN NOT broken AND faults = 0 THEN 'PASS' ELSE 'FAIL' END) <> CASE WHEN m = 15 THEN 'FAIL' ELSE 'PASS' END
  UNION ALL SELECT pack_id, 'validate_receipts', 'error', 'E_MANIFEST_TAMPER', 'head_hash' FROM r WHERE NOT stopped AND real_head IS DISTINCT FROM sha256(regexp_replace(lines[n], '"signature":"[^"]*",', ''))
  UNION ALL SELECT pack_id, 'validate_receipts', 'failed', 'W_RECEIPTS', 'receipt_pack.jsonl' FROM r WHERE NOT stopped AND NOT broken AND faults > 0
  UNION ALL SELECT pack_id, 'validate_attestation', 'error', 'E_MANIFEST_TAMPER', 'attestation_sha256' FROM r WHERE NOT stopped AND sha256(a1 || CASE WHEN m = 4 THEN n + 1 ELSE n END || a2) <> sha256(a1 || n || a2)
  UNION ALL SELECT pack_id, 'verify_signature', 'error', 'E_PACK_SIG_INVALID', 'signature' FROM r WHERE m = 6
  UNION ALL SELECT pack_id, 'verify_signature', 'error', 'E_PACK_SIG_INVALID', 'pack_signature.sig' FROM r WHERE m IN (7, 8)
  UNION ALL SELECT pack_id, 'verify_signature', 'error', 'E_PACK_SIG_INVALID', 'signer_pubkey_sha256' FROM r WHERE sha256('key of ' || CASE WHEN m = 9 THEN 'another' ELSE pack_id END) <> sha256('key of ' || pack_id)
  UNION ALL SELECT pack_id, 'check_root_invariant', 'error', 'E_MANIFEST_TAMPER', 'pack_root_sha256' FROM r WHERE CASE WHEN m = 5 THEN sha ELSE sha256(a1 || n || a2) END <> sha256(a1 || n || a2)
  UNION ALL SELECT pack_id, 'check_time_and_binding', 'error', 'E_PACK_STALE', 'timestamp_end' FROM r WHERE NOT stopped AND age > 8 * 3600000000
)
"""

QUERIES = {"pack_findings": pack_findings, "pack_stages": pack_stages, "pack_catalog": pack_catalog, "pack_lines": pack_lines}
ORACLES = {
    "pack_findings": _SQL + "SELECT * FROM found",
    "pack_stages": _SQL
    + """SELECT r.pack_id, s.stage, NOT EXISTS (SELECT 1 FROM found f WHERE f.pack_id = r.pack_id AND f.stage = s.stage AND f.severity <> 'warning') AS passed
FROM r, (SELECT unnest(['validate_schema', 'validate_paths', 'validate_file_hashes', 'validate_receipts', 'validate_attestation', 'verify_signature', 'check_root_invariant', 'check_time_and_binding']) AS stage) s
WHERE NOT r.stopped OR s.stage = 'validate_schema'""",
    "pack_catalog": _SQL
    + """SELECT pack_id, 'packs/' || pack_id AS path, CASE WHEN m = 4 THEN n + 1 ELSE n END AS n_receipts, CASE WHEN m = 15 THEN 'FAIL' ELSE 'PASS' END AS receipt_integrity, 'N/A' AS claim_check, 's' AS signer_id,
  u * 7919 % 101 % 10 = 3 AS is_baseline, row_number() OVER (ORDER BY u * 7919 % 101 DESC, 'packs/' || pack_id) AS place FROM r WHERE m <> 17""",
    "pack_lines": """
SELECT 'p_' || (user_id % 20) AS pack_id, CASE WHEN user_id % 3 > 0 THEN 't_' || user_id ELSE 'run' END AS trace, CASE WHEN event_id % 5 > 0 THEN event_id % 7 ELSE 0 END AS seq, 'r_' || event_id AS receipt_id,
  sha256('{' || CASE WHEN user_id % 3 > 0 THEN '"_trace_id":"t_' || user_id || '",' ELSE '' END || '"payload":{"a":"' || event_type || '","signature":"y"},"receipt_id":"r_' || event_id || '","run_id":"run"' || CASE WHEN event_id % 5 > 0 THEN ',"seq":' || (event_id % 7) ELSE '' END || '}') AS line_sha256
FROM events""",
}
