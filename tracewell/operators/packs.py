"""Evidence packs as files: canonical receipts, the writer, the catalog, and verification of a whole pack from its bytes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stages import settle
from ..sources.receipts import SCHEMA, parse_time
from .integrity import canonical, receipt_errors

# Top-level fields that are no part of what is hashed, by projection.
PROJECTIONS = {
    "v0": ("signatures", "signature", "cose_signature", "receipt_hash", "anchor"),
    "receipt-core-v2": ("verification_bundle", "signatures", "trust_anchors", "signature", "signer_id", "signer_pubkey_sha256", "cose_signature", "receipt_hash", "anchor"),
    "manifest": ("signature", "pack_root_sha256"),
}
# What a manifest must hold, and what else it may hold.
MANIFEST_FIELDS = ("pack_id", "pack_version", "manifest_version", "hash_alg", "attestation", "attestation_sha256", "suite_hash", "claim_set_id", "claim_set_hash", "receipt_count_expected", "files", "expected_files", "signer_id", "signer_pubkey", "signer_pubkey_sha256", "signature_alg", "signature_scope", "signature", "pack_root_sha256")
MANIFEST_MAY = ("redaction_policy_sha256",)
STAGES = ("validate_schema", "validate_paths", "validate_file_hashes", "validate_receipts", "validate_attestation", "verify_signature", "check_root_invariant", "check_time_and_binding")

_ATTESTATION = "receipt_integrity string, claim_check string, head_hash string, n_receipts long, timestamp_start string, timestamp_end string, pack_id string, ci_binding struct<commit_sha:string>"
_MANIFEST = f"pack_id string, attestation struct<{_ATTESTATION.replace(' string', ':string').replace(' long', ':bigint').replace('ci_binding struct', 'ci_binding:struct')}>, attestation_sha256 string, receipt_count_expected long, files array<struct<path:string,sha256:string,bytes:bigint>>, expected_files array<string>, signer_id string, signer_pubkey string, signer_pubkey_sha256 string, signature string, pack_root_sha256 string"
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def _ascii_names(value) -> bool:
    if isinstance(value, dict):
        return all(k.isascii() and _ascii_names(v) for k, v in value.items())
    return all(map(_ascii_names, value)) if isinstance(value, list) else True


def projected(raw: Column, projection: str = "v0", member: str | None = None) -> Column:
    """Canonical JSON of a text without the top-level fields that a projection leaves out, or of one member of it whole.

    Null where there is no object, or it can't be made canonical; for receipts also where a name is not ASCII."""
    drop, names = PROJECTIONS[projection], projection != "manifest" and member is None

    @F.pandas_udf(T.StringType())
    def form(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = json.loads(text)
                if not isinstance(value, dict) or (names and not _ascii_names(value)):
                    return None
                value = value[member] if member else {k: v for k, v in value.items() if k not in drop}
                return canonical(value)
            except (TypeError, ValueError, KeyError):
                return None

        return texts.map(one)

    return form(raw)


def normal_path(path: Column) -> Column:
    """A path with ``.`` and ``..`` resolved; null where it leaves its folder."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    away = F.array(F.lit("/"))  # never joins a path again once it left
    step = lambda a, p: F.when(F.array_contains(a, "/"), away).when(p == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(away)).otherwise(F.concat(a, F.array(p)))
    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~F.startswith(path, F.lit("/")) & ~F.array_contains(done, "/"), F.array_join(done, "/"))


def _error(when: Column, stage: str, code: str, field: Column | str, severity: str = "error") -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.when(when, F.struct(F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), field.alias("field")))


def _receipts(files: DataFrame) -> DataFrame:
    """What the receipts of each pack come to: lines, the first bad one, faults and the head's hash."""
    body = files.where("path = 'receipt_pack.jsonl'").select("pack_id", F.col("content").cast("string").alias("text"))
    readable = F.is_valid_utf8("text")
    rows = body.where(readable).select("pack_id", F.posexplode(F.split("text", _LINE_END, -1)).alias("at", "raw")).where(r"not raw rlike '(?U)^\\s*$'")
    rows = rows.select("pack_id", (F.col("at") + 1).cast("long").alias("line_no"), "raw", F.expr("try_parse_json(raw)").isNull().alias("bad"), projected(F.col("raw")).alias("canonical"))
    parsed = rows.withColumn("r", F.from_json("raw", SCHEMA)).select("pack_id", "line_no", "r.*")
    faults = receipt_errors(parsed, ["pack_id", "line_no"]).groupBy("pack_id").agg(F.count("*").alias("faulty"))
    twice = parsed.where("receipt_id <> ''").groupBy("pack_id", "receipt_id").count().groupBy("pack_id").agg(F.sum(F.col("count") - 1).alias("twice"))
    whole = rows.groupBy("pack_id").agg(
        F.count("*").alias("n"),
        F.min("line_no").alias("first_line"),
        F.min(F.when(F.col("bad"), F.col("line_no"))).alias("first_bad"),
        F.count_if(F.col("canonical").isNull()).alias("uncanonical"),
        F.max_by(F.sha2("canonical", 256), "line_no").alias("head"),
    )
    return body.select("pack_id", (~readable).alias("unreadable")).join(whole, "pack_id", "left").join(faults, "pack_id", "left").join(twice, "pack_id", "left")


def verify(files: DataFrame, now: str, max_age_hours: float | None = None, max_future_hours: float = 24.0, require_ci: bool = False, commit: str | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """(pack_id, stage, severity, code, field): everything that is wrong with each pack, from the bytes of its files.

    files: (pack_id, path, content), paths within the pack. A manifest that can't be read, lacks a field or has one too
    many gives that finding only. Else: listed files must stay in the pack, exist and have their SHA-256 (another size is
    a warning); expected files must exist; receipts must be as many as said, and must, checked one by one, come to the
    integrity and the head hash that the attestation claims (no receipts: the hash of ``empty``); the attestation must have
    its hash; the signature must be given as base64, equal the detached one, and belong to the key whose fingerprint is
    given; the root must be the attestation's hash; then age, time in the future and CI binding. Ed25519 itself is outside:
    ``signatures`` (pack_id, signature_ok) may bring its results. A folder without a manifest is no pack.

    A pack's receipts are lines, spread over tasks; a pack comes to one row of sums.
    """
    raw = files.where("path = 'pack_manifest.json'").select("pack_id", F.col("content").cast("string").alias("raw"))
    keys = F.json_object_keys("raw")
    wrong = F.when(keys.isNull(), F.array(F.lit("pack_manifest.json"))).otherwise(F.concat(F.array_except(F.array(*map(F.lit, MANIFEST_FIELDS)), keys), F.array_except(keys, F.array(*map(F.lit, MANIFEST_FIELDS + MANIFEST_MAY)))))
    found = raw.withColumn("wrong", wrong)
    schema = found.select("pack_id", F.explode("wrong").alias("field")).select("pack_id", F.lit("validate_schema").alias("stage"), F.lit("error").alias("severity"), F.lit("E_MANIFEST_TAMPER").alias("code"), "field")
    packs = found.where("size(wrong) = 0").select("pack_id", F.from_json("raw", _MANIFEST).alias("m"), projected(F.col("raw"), "manifest", "attestation").alias("attested"))

    have = files.select("pack_id", F.col("path").alias("normal"), F.sha2("content", 256).alias("real"), F.length("content").cast("long").alias("size"))
    listed = packs.select("pack_id", F.explode("m.files").alias("f")).select("pack_id", "f.*", normal_path(F.col("f.path")).alias("normal")).join(have, ["pack_id", "normal"], "left")
    outside, missing = F.col("normal").isNull(), F.col("real").isNull()
    of_files = F.array_compact(
        F.array(
            _error(outside, "validate_paths", "E_PATH_ESCAPE", F.col("path")),
            _error(~outside & missing, "validate_file_hashes", "E_MANIFEST_TAMPER", F.col("path")),
            _error(F.col("real") != F.nullif("sha256", F.lit("")), "validate_file_hashes", "E_MANIFEST_TAMPER", F.col("path")),
            _error(F.col("size") != F.col("bytes"), "validate_file_hashes", "W_SIZE", F.col("path"), "warning"),
        )
    )
    listed = listed.select("pack_id", F.explode(of_files).alias("e")).select("pack_id", "e.*")
    expected = packs.select("pack_id", F.explode("m.expected_files").alias("path")).withColumn("normal", normal_path(F.col("path"))).join(have.drop("size"), ["pack_id", "normal"], "left")
    said = listed.where("severity = 'error'").select("pack_id", F.col("field").alias("path")).distinct().withColumn("said", F.lit(True))
    expected = expected.join(said, ["pack_id", "path"], "left").select("pack_id", F.explode(F.array_compact(F.array(_error(outside, "validate_paths", "E_PATH_ESCAPE", F.col("path")), _error(~outside & missing & F.col("said").isNull(), "validate_file_hashes", "E_MANIFEST_TAMPER", F.col("path"))))).alias("e")).select("pack_id", "e.*")

    detached = files.where("path = 'pack_signature.sig'").select("pack_id", F.col("content").alias("detached"))
    rows = packs.join(_receipts(files), "pack_id", "left").join(detached, "pack_id", "left")
    rows = rows.join(signatures, "pack_id", "left") if signatures is not None else rows.withColumn("signature_ok", F.lit(None).cast("boolean"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    unreadable = F.coalesce("unreadable", F.lit(False))
    broken = unreadable | F.col("first_bad").isNotNull()
    sound = ~broken & (zero("faulty") + zero("twice") + zero("uncanonical") == 0)
    none_parsed = F.when(unreadable, True).when(F.col("first_bad").isNotNull(), F.col("first_bad") == F.col("first_line")).otherwise(zero("n") == 0)
    head = F.when(none_parsed, F.sha2(F.lit("empty"), 256)).when(~broken, F.col("head"))
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    signed, signature = given("m.signature"), F.try_to_binary("m.signature", F.lit("base64"))
    usable = signed & signature.isNotNull()
    fingerprint = F.sha2(F.try_to_binary("m.signer_pubkey", F.lit("base64")), 256)
    drift = given("m.signer_pubkey") & given("m.signer_pubkey_sha256") & (fingerprint != F.col("m.signer_pubkey_sha256"))
    when = F.coalesce(*[F.nullif(f"m.attestation.{c}", F.lit("")) for c in ("timestamp_end", "timestamp_start")])
    hours = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(parse_time(when))) / 3.6e9
    claimed = F.col("m.attestation.receipt_integrity")
    rules = [
        _error(unreadable, "validate_receipts", "E_MANIFEST_TAMPER", "receipt_pack.jsonl"),
        _error(F.col("first_bad").isNotNull(), "validate_receipts", "E_MANIFEST_TAMPER", F.concat(F.lit("receipt_pack.jsonl:"), F.col("first_bad"))),
        _error(~broken & (zero("n") != F.col("m.receipt_count_expected")), "validate_receipts", "E_PACK_OMISSION_DETECTED", "receipt_count_expected"),
        _error(given("m.attestation.receipt_integrity") & (claimed != F.when(sound, "PASS").otherwise("FAIL")), "validate_receipts", "E_MANIFEST_TAMPER", "receipt_integrity"),
        _error(given("m.attestation.head_hash") & ~head.eqNullSafe(F.col("m.attestation.head_hash")), "validate_receipts", "E_MANIFEST_TAMPER", "head_hash"),
        _error(~broken & ~sound, "validate_receipts", "W_RECEIPTS", "receipt_pack.jsonl", "failed"),
        _error(given("m.attestation_sha256") & (F.sha2("attested", 256) != F.col("m.attestation_sha256")), "validate_attestation", "E_MANIFEST_TAMPER", "attestation_sha256"),
        _error(~signed | signature.isNull(), "verify_signature", "E_PACK_SIG_INVALID", "signature"),
        _error(signed & F.col("detached").isNull(), "verify_signature", "E_PACK_SIG_INVALID", "pack_signature.sig"),
        _error(usable & (F.col("detached") != signature), "verify_signature", "E_PACK_SIG_INVALID", "pack_signature.sig"),
        _error(usable & drift, "verify_signature", "E_PACK_SIG_INVALID", "signer_pubkey_sha256"),
        _error(usable & (~given("m.signer_pubkey") | (~drift & ~F.coalesce("signature_ok", F.lit(True)))), "verify_signature", "E_PACK_SIG_INVALID", "signer_pubkey"),
        _error(given("m.pack_root_sha256") & given("m.attestation_sha256") & (F.col("m.pack_root_sha256") != F.col("m.attestation_sha256")), "check_root_invariant", "E_MANIFEST_TAMPER", "pack_root_sha256"),
        _error(hours < -max_future_hours if max_future_hours > 0 else F.lit(False), "check_time_and_binding", "E_TIMESTAMP_INVALID", "timestamp_end"),
    ]
    if max_age_hours is not None:
        rules.append(_error(parse_time(when).isNull(), "check_time_and_binding", "E_TIMESTAMP_INVALID", "timestamp_end"))
        rules.append(_error(hours > max_age_hours, "check_time_and_binding", "E_PACK_STALE", "timestamp_end"))
    binding = F.col("m.attestation.ci_binding")
    if require_ci:
        rules.append(_error(binding.isNull(), "check_time_and_binding", "E_CI_BINDING_MISSING", "ci_binding"))
    if commit is not None:
        rules.append(_error(binding.isNotNull() & ~binding["commit_sha"].eqNullSafe(F.lit(commit)), "check_time_and_binding", "E_CI_BINDING_MISMATCH", "ci_binding.commit_sha"))
    rest = rows.select("pack_id", F.explode(F.array_compact(F.array(*rules))).alias("e")).select("pack_id", "e.*")
    return schema.unionByName(listed).unionByName(expected).unionByName(rest)


def stage_results(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(pack_id, stage, passed) of every pack; packs whose manifest fails its schema have that stage only. A warning fails
    nothing; receipts with faults fail their stage though the pack may claim so."""
    packs = files.where("path = 'pack_manifest.json'").select("pack_id").distinct()
    # looked up twice, so what is found is written, not found again
    failed = settle(findings.where("severity <> 'warning'").select("pack_id", "stage").distinct()).withColumn("passed", F.lit(False))
    stopped = failed.where("stage = 'validate_schema'").select("pack_id", F.lit(True).alias("stopped"))
    rows = packs.join(stopped, "pack_id", "left").select("pack_id", "stopped", F.explode(F.array(*map(F.lit, STAGES))).alias("stage")).where("stage = 'validate_schema' or stopped is null")
    return rows.join(failed, ["pack_id", "stage"], "left").select("pack_id", "stage", F.coalesce("passed", F.lit(True)).alias("passed"))


def catalog(manifests: DataFrame, baselines: DataFrame) -> DataFrame:
    """(pack_id, path, n_receipts, receipt_integrity, claim_check, signer_id, started, is_baseline, place), newest first by
    place. manifests: (path, modified, raw); baselines: (path). A manifest that can't be read is left out."""
    m = manifests.where(F.expr("try_parse_json(raw)").isNotNull()).select("path", "modified", F.from_json("raw", _MANIFEST).alias("m"))
    marked = baselines.select("path").distinct().withColumn("is_baseline", F.lit(True))
    other = lambda c, value: F.coalesce(F.col(c), F.lit(value))
    # one row a pack; the folder's order is over all of them, as its lines are numbered
    place = F.row_number().over(Window.orderBy(F.desc("modified"), "path"))
    return m.join(marked, "path", "left").select(
        other("m.pack_id", "unknown").alias("pack_id"), "path", other("m.attestation.n_receipts", 0).alias("n_receipts"), other("m.attestation.receipt_integrity", "unknown").alias("receipt_integrity"), other("m.attestation.claim_check", "N/A").alias("claim_check"),
        other("m.signer_id", "unknown").alias("signer_id"), other("m.attestation.timestamp_start", "").alias("started"), other("is_baseline", False).alias("is_baseline"), place.alias("place"),
    )


def canonical_receipts(receipts: DataFrame) -> DataFrame:
    """(pack_id, trace, seq, receipt_id, line) of (pack_id, raw): what is written of each receipt and what it is ordered by."""
    keys = F.from_json("raw", "_trace_id string, run_id string, seq long, receipt_id string")
    first = lambda *names: F.coalesce(*[F.col(f"k.{n}") for n in names], F.lit(""))
    rows = receipts.select("pack_id", keys.alias("k"), projected(F.col("raw")).alias("line"))
    return rows.select("pack_id", first("_trace_id", "run_id").alias("trace"), F.coalesce("k.seq", F.lit(0)).alias("seq"), first("receipt_id").alias("receipt_id"), "line")


def write_packs(receipts: DataFrame, path: str) -> None:
    """Write each pack's receipts (pack_id, raw) as canonical lines in the order of (trace, seq, receipt_id, line).

    A folder ``pack_id=...`` holds a pack's files; read in the order of their names they are the pack. Ranges of this
    order are the tasks, so that a pack of any size is spread and nothing is gathered. A task that runs again writes the
    same lines; a folder appears whole when the job commits, and a second run replaces exactly the packs it writes.
    Receipts that can't be made canonical stop the job.
    """
    order = ["pack_id", "trace", "seq", "receipt_id", "line"]
    rows = canonical_receipts(receipts)
    rows = rows.withColumn("line", F.when(F.col("line").isNotNull(), F.col("line")).otherwise(F.raise_error(F.lit("a receipt has no canonical form"))))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("pack_id", F.col("line").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pack_id").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(pack_id, path, content) of packs' files below ``path``; the pack is the folder below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = "^.*?" + re.escape(path.rstrip("/").rpartition("/")[2]) + "/([^/]+)/(.+)$"
    return files.select(F.regexp_extract("path", below, 1).alias("pack_id"), F.regexp_extract("path", below, 2).alias("path"), "content")
