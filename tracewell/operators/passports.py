"""Passports of packs: drafts minted from verification reports and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Claims of a passport: id, topic, what is asserted, section of the report; labels of the reliance classes.
CLAIMS = (
    ("C-001", "Offline verifiability", "The proof artifact can be verified offline without network access.", "integrity"),
    ("C-002", "Receipt integrity", "All receipts in the proof pack pass hash-chain integrity verification.", "hash_chain"),
    ("C-003", "Claim verification", "All attestation claims in the proof pack were evaluated.", "claims"),
)
RELIANCE = {"R3": "Signed, full coverage, all claims pass", "R2": "Signed, all core claims pass", "R1": "Signed, partial verification", "R0": "Unsigned or minimal evidence"}
FORM = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"


def reliance_class(claims: Column, signed: Column) -> Column:
    """R3 to R0 of an array of claims (result, claim_type) and whether the passport is signed; no claims all pass."""
    passed = F.forall(claims, lambda c: F.coalesce(c["result"] == "pass", F.lit(False)))
    covered = F.exists(claims, lambda c: F.coalesce(c["claim_type"] == "coverage", F.lit(False)))
    sure = F.coalesce(signed, F.lit(False))
    return F.when(sure & passed & covered, "R3").when(sure & passed, "R2").when(sure, "R1").otherwise("R0")


def mint(packs: DataFrame, now: str, valid_days: int = 30) -> DataFrame:
    """One unsigned draft per pack: claims with evidence, their summary, window and reliance.

    packs: pack_id, report and manifest (JSON texts), now in the session's time zone, which is UTC. The pack that references name is that of the
    report's attestation. A report that is missing, unreadable or no object gives no claims and ``error`` report_missing; a manifest likewise leaves
    the pack unreferenced and the window at the time of issue. Every row is judged by itself: no shuffle."""
    at = F.lit(now).cast("timestamp")
    issued = F.date_format(at, FORM)
    rows = packs.select("pack_id", F.try_parse_json("report").alias("r"), F.try_parse_json("manifest").alias("m"))
    whole = lambda v: F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("OBJECT"))
    get = lambda v, name: F.try_variant_get(v, f"$.attestation.{name}", "string")
    of_report, of_manifest = whole("r"), whole("m")
    result = lambda value: F.when(F.coalesce(value == "PASS", F.lit(False)), "pass").otherwise("fail")
    integrity, checked = get("r", "receipt_integrity"), F.coalesce(get("r", "claim_check"), F.lit("N/A"))
    results = (result(integrity), result(integrity), result(checked))
    claim = lambda c, value: F.struct(
        F.lit(c[0]).alias("claim_id"), F.lit(c[1]).alias("topic"), F.lit("integrity").alias("claim_type"), F.lit("proof_pack").alias("applies_to"), F.lit(c[2]).alias("assertion"), value.alias("result"),
        F.lit("machine_verified").alias("evidence_type"), F.lit("core").alias("proof_tier"), F.concat(F.lit("proof_pack/"), F.coalesce(get("r", "pack_id"), F.lit("")), F.lit(f"/verify_report.json#{c[3]}")).alias("evidence_ref"),
    )
    made = [claim(c, value) for c, value in zip(CLAIMS, results, strict=True)]
    claims = F.when(of_report, F.when(checked == "N/A", F.array(*made[:2])).otherwise(F.array(*made))).otherwise(F.array(*made[:0]).cast(_ARRAY))
    rows = rows.select("pack_id", "m", "r", of_report.alias("read"), of_manifest.alias("listed"), claims.alias("claims"))
    total = F.size("claims")
    human = F.size(F.filter("claims", lambda c: c["evidence_type"] == "human_attested"))
    passed = F.size(F.filter("claims", lambda c: (c["proof_tier"] == "core") & (c["result"] == "pass")))
    core = F.size(F.filter("claims", lambda c: c["proof_tier"] == "core"))
    summary = F.struct(total.alias("total_claims"), (total - human).alias("machine_verified"), human.alias("human_attested"), F.concat_ws("/", passed, core).alias("core_claims_passed"), F.coalesce(get("r", "pack_root_sha256"), F.lit("")).alias("proof_pack_hash"))
    level = reliance_class(F.col("claims"), F.lit(False))
    edge = lambda name: F.when(F.col("listed"), F.coalesce(get("m", name), issued)).otherwise(issued)
    return rows.select(
        "pack_id", issued.alias("issued_at"), F.date_format(at + F.make_dt_interval(F.lit(valid_days)), FORM).alias("valid_until"), edge("timestamp_start").alias("window_start"), edge("timestamp_end").alias("window_end"),
        F.when(F.col("listed"), F.concat(F.lit("sha256:"), F.coalesce(get("m", "pack_root_sha256"), F.lit("")))).alias("pack_ref"), "claims", F.when(F.col("read"), summary).alias("evidence_summary"),
        level.alias("reliance"), _label(level).alias("reliance_label"), F.concat(total - human, F.lit(" machine / "), human, F.lit(" human")).alias("evidence_mix"), F.when(~F.col("read"), "report_missing").alias("error"),
    )


_ARRAY = "array<struct<" + ",".join(f"{n}:string" for n in ("claim_id", "topic", "claim_type", "applies_to", "assertion", "result", "evidence_type", "proof_tier", "evidence_ref")) + ">>"


def _label(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, label in RELIANCE.items():
        out = F.when(level == name, label).otherwise(out)
    return out
