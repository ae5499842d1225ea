"""Verdicts, scores, locks, passports, claim chains and required checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ancestry import grounded

MODES = ("permissive", "balanced", "strict")


def verdict_matrix(passports: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """(passport, mode, verdict, reason): the first rule that holds, for each policy mode.

    passports: signature_valid, schema_valid, content_hash_valid (may be null), governance_status,
    event_integrity, freshness_status."""
    rows = passports.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    strict, permissive = F.col("mode") == "strict", F.col("mode") == "permissive"
    soft = F.when(strict, "FAIL").otherwise("WARN")
    hard = F.when(permissive, "WARN").otherwise("FAIL")
    status = F.col("governance_status")
    rules = [
        (~F.col("signature_valid"), F.lit("FAIL"), "signature invalid"),
        (~F.coalesce("schema_valid", F.lit(False)), F.lit("FAIL"), "schema invalid"),
        (~F.col("content_hash_valid"), F.lit("FAIL"), "content hash mismatch"),
        (status == "revoked", F.lit("FAIL"), "revoked"),
        (F.col("event_integrity") == "some_invalid", soft, "events invalid"),
        (status == "superseded", soft, "superseded"),
        (status == "challenged", hard, "challenged"),
        (F.col("freshness_status") == "stale", hard, "stale"),
        (F.col("signature_valid").isNull(), soft, "unsigned"),
    ]
    verdict, reason = F.lit("PASS"), F.lit("clean")
    for when, what, why in reversed(rules):
        verdict, reason = F.when(when, what).otherwise(verdict), F.when(when, F.lit(why)).otherwise(reason)
    return rows.withColumn("verdict", verdict).withColumn("reason", reason)


# Weights of the readiness score, and the least score of each grade.
WEIGHTS = {"coverage": 39, "lockfile": 17, "ci_gate": 22, "receipts": 22}
GRADES = [("A", 90), ("B", 80), ("C", 70), ("D", 60)]


def _grade(score: Column) -> Column:
    out = F.lit("F")
    for g, least in reversed(GRADES):
        out = F.when(score >= least, g).otherwise(out)
    return out


def readiness(facts: DataFrame) -> DataFrame:
    """Points, score and grade of each repository; without receipts no better than D.

    facts: sites_total, instrumented, lock_present, lock_valid, lock_stale, has_run, has_verify,
    has_lock, has_ref, receipt_files. Points are rounded half up, to one digit."""
    w = WEIGHTS
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("instrumented") / F.col("sites_total")))
    coverage = F.round(F.when(F.col("sites_total") <= 0, w["coverage"] * 0.5).otherwise(w["coverage"] * ratio), 1)
    lock = F.when(F.col("lock_present") & F.col("lock_valid") & ~F.col("lock_stale"), float(w["lockfile"])).when(F.col("lock_present"), round(w["lockfile"] * 0.45, 1)).otherwise(0.0)
    run, verify, held, ref = (F.col(c) for c in ("has_run", "has_verify", "has_lock", "has_ref"))
    ci = F.when(run & verify & held, float(w["ci_gate"])).when(run & verify, round(w["ci_gate"] * 0.7, 1)).when(verify & ref, round(w["ci_gate"] * 0.5, 1)).when(ref, round(w["ci_gate"] * 0.25, 1)).otherwise(0.0)
    receipts = F.when(F.col("receipt_files") > 0, float(w["receipts"])).otherwise(0.0)
    rows = facts.withColumns({"coverage_points": coverage, "lock_points": lock, "ci_points": ci, "receipt_points": receipts})
    rows = rows.withColumn("raw_score", F.round(F.col("coverage_points") + F.col("lock_points") + F.col("ci_points") + F.col("receipt_points"), 1))
    capped = (F.col("receipt_files") == 0) & (F.col("raw_score") >= 70)
    score = F.when(capped, 69.9).otherwise(F.col("raw_score"))
    return rows.withColumn("score", score).withColumn("grade", _grade(F.col("score")))


def fastest_path(scored: DataFrame, by: str) -> DataFrame:
    """(by, part, gap): what a repository has most points to gain from."""
    parts = {"coverage": "coverage_points", "lockfile": "lock_points", "ci_gate": "ci_points", "receipts": "receipt_points"}
    gaps = F.array(*[F.struct((F.lit(float(WEIGHTS[p])) - F.col(c)).alias("gap"), F.lit(-i).alias("i"), F.lit(p).alias("part")) for i, (p, c) in enumerate(parts.items())])
    best = F.array_max(gaps)
    return scored.select(by, best.part.alias("part"), F.round(best.gap, 1).alias("gap")).where("gap > 0")


def score_gate(scored: DataFrame, baseline: DataFrame, by: str, least: float) -> DataFrame:
    """PASS or FAIL: below ``least``, or below the baseline."""
    rows = scored.select(by, "score").join(baseline.select(by, F.col("score").alias("was")), by, "left")
    return rows.withColumn("regressed", F.coalesce(F.col("score") < F.col("was"), F.lit(False))).withColumn("result", F.when((F.col("score") < least) | F.col("regressed"), "FAIL").otherwise("PASS"))


def lock_errors(manifests: DataFrame, lock: dict, by: str = "pack_id") -> DataFrame:
    """(by, field): where manifests differ from a lock. What the lock lacks counts as a difference."""
    allowed = lock.get("allowed_fingerprints") or []
    error = lambda when, field: F.when(when, F.lit(field))
    differs = lambda c, v: F.lit(True) if not v else F.coalesce(F.col(c) != v, F.lit(True))
    rules = [error(differs("pack_format_version", lock.get("pack_format_version")), "pack_format_version"), error(differs("claim_set_hash", lock.get("claim_set_hash")), "claim_set_hash")]
    if lock.get("mode") == "allowlist":
        rules.append(error(F.lit(True), "signer_policy") if not allowed else error(~F.coalesce(F.col("signer").isin(*allowed), F.lit(False)), "signer"))
    number = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    if lock.get("version_min"):
        rules.append(error(number(F.col("version")) < number(F.lit(lock["version_min"])), "version_min"))
    if lock.get("version_max"):
        rules.append(error(number(F.col("version")) >= number(F.lit(lock["version_max"])), "version_max"))
    return manifests.select(by, F.explode(F.array_compact(F.array(*rules))).alias("field"))


def passport_states(passports: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """REVOKED, SUPERSEDED, CHALLENGED, STALE or FRESH. passports: (passport_id, valid_until); events: (passport_id, kind)."""
    has = lambda k: F.bool_or(F.col("kind") == k).alias(k)
    seen = events.groupBy("passport_id").agg(has("revocation"), has("supersession"), has("challenge"), F.count_if(F.col("kind") == "challenge").alias("challenges"))
    state = F.when(F.col("revocation"), "REVOKED").when(F.col("supersession"), "SUPERSEDED").when(F.col("challenge"), "CHALLENGED").when(F.col("valid_until") < F.lit(now).cast("timestamp"), "STALE").otherwise("FRESH")
    return passports.join(seen, "passport_id", "left").select("passport_id", state.alias("state"), F.coalesce("challenges", F.lit(0)).alias("challenges"))


def passport_claims(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """(pair_id, claim_id, a_result, b_result, status): a claim that goes is a regression too."""
    side = lambda s: claims.join(pairs.select(F.col(f"passport_{s}").alias("passport_id"), "pair_id"), "passport_id").select("pair_id", "claim_id", F.col("result").alias(f"{s}_result"))
    rank = lambda c: F.when(c == "pass", 3).when(c == "present", 2).when(c == "partial", 1).otherwise(0)
    a, b = F.col("a_result"), F.col("b_result")
    status = F.when(a.isNull(), "new").when(b.isNull(), "removed").when(rank(b) < rank(a), "regressed").when(rank(b) > rank(a), "improved").otherwise("unchanged")
    return side("a").join(side("b"), ["pair_id", "claim_id"], "full").withColumn("status", status)


def manifest_problems(manifest: DataFrame, files: DataFrame, expected: DataFrame) -> DataFrame:
    """(pack_id, path, problem): files of a manifest that escape, are missing, or differ in hash or size; expected ones it lacks.

    manifest: (pack_id, path, sha256, bytes); files: (pack_id, path, sha256, length)."""
    actual = files.select("pack_id", "path", F.col("sha256").alias("real"), "length")
    rows = manifest.join(actual, ["pack_id", "path"], "left")
    escapes = F.startswith("path", F.lit("/")) | F.array_contains(F.split("path", "/"), "..")
    problem = F.when(escapes, "escape").when(F.col("real").isNull(), "missing").when(F.col("real") != F.col("sha256"), "hash").when(F.col("length") != F.col("bytes"), "size")
    lacking = expected.join(manifest.select("pack_id", "path"), ["pack_id", "path"], "left_anti").select("pack_id", "path", F.lit("not in manifest").alias("problem"))
    return rows.withColumn("problem", problem).where("problem is not null").select("pack_id", "path", "problem").union(lacking)


def support_chain(assertions: DataFrame, changes: DataFrame, genesis: str = "ASSERTED") -> DataFrame:
    """(change_id, check): changes of support without a claim, before it, whose prior status is not
    what the chain has, or that follow a retraction. Changes go by (timestamp, change_id) within a claim."""
    order = Window.partitionBy("claim_id").orderBy("ts", "change_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = changes.withColumn("expected", F.coalesce(F.last(F.nullif("new_status", F.lit("")), ignorenulls=True).over(order), F.lit(genesis)))
    claims = assertions.groupBy("claim_id").agg(F.max_by("ts", "line_no").alias("claim_ts"))
    rows = rows.join(claims, "claim_id", "left")
    check = lambda when, name: F.when(when, F.lit(name))
    found = F.array_compact(F.array(check(F.col("claim_ts").isNull(), "claim_exists"), check(F.col("ts") < F.col("claim_ts"), "after_assertion"), check(~F.col("prior_status").eqNullSafe(F.col("expected")), "prior_mismatch"), check(F.col("expected") == "RETRACTED", "retracted_terminal")))
    return rows.select("change_id", F.explode(found).alias("check"))


def duplicate_pairs(contradictions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Open contradictions about two claims that an earlier open one is about already."""
    still = contradictions.join(resolved.select("contradiction_id").distinct(), "contradiction_id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("claim_a", "claim_b").orderBy("line_no"))
    return still.withColumn("nth", nth).where("nth > 1").select("contradiction_id", "claim_a", "claim_b")


def required_checks(heads: DataFrame, required: list[str], observed: DataFrame, good: tuple[str, ...] = ("success", "neutral", "skipped")) -> DataFrame:
    """(head, name, status) of every required check at every head. observed: (head, name, conclusion or null)."""
    wanted = heads.select("head", F.explode(F.array(*map(F.lit, required))).alias("name"))
    seen = observed.groupBy("head", "name").agg(F.count_if(F.col("conclusion") != "").alias("done"), F.count_if((F.col("conclusion") != "") & ~F.lower("conclusion").isin(*good)).alias("bad"))
    some = observed.select("head").distinct().withColumn("any", F.lit(True))
    rows = wanted.join(seen, ["head", "name"], "left").join(some, "head", "left")
    status = F.when(F.col("done").isNull(), F.when(F.col("any"), "NAME_MISMATCH_POSSIBLE").otherwise("NOT_OBSERVED_YET")).when(F.col("done") == 0, "OBSERVED_PENDING").when(F.col("bad") > 0, "OBSERVED_FAIL").otherwise("OBSERVED_PASS")
    return rows.select("head", "name", status.alias("status"))


def admissible(artifacts: DataFrame, inputs: DataFrame) -> DataFrame:
    """(artifact_id, admissible): active artifacts all of whose inputs, and theirs, are so, at any depth.

    artifacts: (artifact_id, active); inputs: (artifact_id, input_id). An artifact on a ring has no ground to stand
    on, nor has one whose input is not among the artifacts."""
    known = artifacts.select(F.col("artifact_id").alias("node"), F.col("active").alias("open"))
    lost = inputs.select(F.col("input_id").alias("node")).distinct().join(known, "node", "left_anti").select("node", F.lit(False).alias("open"))
    good = grounded(known.union(lost), inputs.select(F.col("artifact_id").alias("node"), F.col("input_id").alias("on")))
    good = good.select(F.col("node").alias("artifact_id"), F.lit(True).alias("a"))
    return artifacts.select("artifact_id").join(good, "artifact_id", "left").select("artifact_id", F.coalesce("a", F.lit(False)).alias("admissible"))


def previous_pack(packs: DataFrame, by: str = "parent", order: str = "mtime") -> DataFrame:
    """(pack_id, previous): the pack just before in the same folder."""
    return packs.select("pack_id", F.lag("pack_id").over(Window.partitionBy(by).orderBy(order, "pack_id")).alias("previous"))


def newest_traces(receipts: DataFrame, n: int = 20) -> DataFrame:
    """The n traces that were last written, with their receipts."""
    return receipts.groupBy("trace_id").agg(F.count("*").alias("receipts"), F.max("seq").alias("last_seq")).orderBy(F.desc("last_seq")).limit(n)

