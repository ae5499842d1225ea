"""Rules of decisions, obligations and packs; completeness of episodes; step graphs; signers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import settle
from .ancestry import grounded

# Dispositions that a verdict allows; verdicts of an advisory authority; order of proof tiers.
DISPOSITIONS = {"APPROVE": ["execute"], "REFUSE": ["block", "escalate"], "DEFER": ["defer_with_obligation", "escalate"], "ABSTAIN": ["escalate", "no_action"], "ROLLBACK": ["compensate", "execute"], "CONFLICT": ["escalate"]}
ADVISORY = ["APPROVE", "REFUSE", "DEFER", "ABSTAIN"]


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def _found(rows: DataFrame, key: str, rules: list[tuple[Column, str]], name: str) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(when, F.lit(text)) for when, text in rules]))
    return rows.select(key, F.explode(hits).alias(name))


def decision_rules(decisions: DataFrame, key: str = "receipt_id") -> DataFrame:
    """(key, rule): the invariants and forbidden states that a decision violates.

    decisions: verdict, disposition, authority_class, delegated_from, supersedes, abstention_reason,
    obligations_created, evidence_sufficient, evidence_gaps, provenance_complete, provenance_gaps
    (counts), tier_achieved, tier_minimum (ranks), signature, signer, confidence."""
    verdict, disposition, kind = F.col("verdict"), F.col("disposition"), F.col("authority_class")
    allowed = F.create_map(*[x for v, d in DISPOSITIONS.items() for x in (F.lit(v), F.array(*map(F.lit, d)))])
    lacks = F.col("evidence_sufficient") == F.lit(False)
    rules = [
        (~F.array_contains(allowed[verdict], disposition), "I-1 disposition"),
        ((verdict == "ABSTAIN") & _blank("abstention_reason"), "I-1 abstention_reason"),
        ((verdict == "ROLLBACK") & _blank("supersedes"), "I-1 supersedes"),
        ((disposition == "defer_with_obligation") & (F.coalesce("obligations_created", F.lit(0)) == 0), "I-1 obligations_created"),
        ((kind == "ADVISORY") & ~verdict.isin(*ADVISORY), "I-2 verdict"),
        ((kind == "OVERRIDING") & _blank("delegated_from"), "I-2 delegated_from"),
        (lacks & (verdict == "APPROVE"), "I-3 approve"),
        (lacks & (verdict == "REFUSE") & (F.coalesce("evidence_gaps", F.lit(0)) == 0), "I-3 evidence_gaps"),
        ((verdict == "APPROVE") & (F.col("tier_achieved") < F.col("tier_minimum")), "I-4 tier"),
        (~_blank("supersedes") & (F.col("supersedes") == F.col(key)), "I-5 supersedes"),
        (F.col("provenance_complete") & (F.coalesce("provenance_gaps", F.lit(0)) > 0), "I-6 gaps"),
        (~F.col("provenance_complete") & (F.coalesce("provenance_gaps", F.lit(0)) == 0), "I-6 no gaps"),
        (~_blank("signature") & _blank("signer"), "I-7 signer"),
        ((F.col("confidence") == "high") & lacks, "forbidden confidence"),
        ((verdict == "APPROVE") & (disposition == "block"), "forbidden approve block"),
        ((verdict == "REFUSE") & (disposition == "execute"), "forbidden refuse execute"),
        ((kind == "ADVISORY") & (verdict == "ROLLBACK"), "forbidden advisory rollback"),
    ]
    return _found(decisions, key, rules, "rule")


def obligation_rules(obligations: DataFrame, key: str = "obligation_id") -> DataFrame:
    """(key, error): unknown status, severity or type, and what a status needs and lacks."""
    status = F.col("status")
    unknown = lambda c, *known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    rules = [
        (unknown("status", "open", "discharged", "waived", "escalated"), "unknown status"),
        (unknown("severity", "HIGH", "MEDIUM", "LOW"), "unknown severity"),
        (unknown("obligation_type", "override_review"), "unknown type"),
        ((status == "discharged") & _blank("discharge_receipt_id"), "no receipt"),
        ((status == "waived") & _blank("waiver_reason"), "no reason"),
        ((status == "escalated") & _blank("escalated_to"), "no target"),
    ]
    return _found(obligations, key, rules, "error")


def pack_freshness(packs: DataFrame, now: str, max_age_hours: float, max_future_hours: float = 24.0, commit: str | None = None, need_binding: bool = False) -> DataFrame:
    """(pack_id, code): packs without a readable end, too old, too far ahead, or bound to another commit. packs: ended, commit_sha."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("ended")) / 3_600_000_000
    unbound = _blank("commit_sha")
    rules = [(F.col("ended").isNull(), "E_TIMESTAMP_INVALID"), (age > max_age_hours, "E_PACK_STALE"), (-age > max_future_hours, "E_TIMESTAMP_INVALID")]
    if need_binding or commit:
        rules.append((unbound, "E_CI_BINDING_MISSING"))
    if commit:
        rules.append((~unbound & (F.col("commit_sha") != commit), "E_CI_BINDING_MISMATCH"))
    return _found(packs, "pack_id", rules, "code")


def episode_completeness(obligations: DataFrame, receipts: DataFrame) -> DataFrame:
    """(episode_id, obligations, missing, completeness): obligations whose expected receipt types were all seen.

    obligations: (episode_id, obligation_id, expected array<string>); without expected types one counts as met."""
    seen = receipts.select("episode_id", "type").distinct().withColumn("seen", F.lit(True))
    wanted = obligations.select("episode_id", "obligation_id", F.explode_outer("expected").alias("type"))
    met = wanted.join(seen, ["episode_id", "type"], "left").groupBy("episode_id", "obligation_id").agg(F.bool_and(F.col("type").isNull() | F.coalesce("seen", F.lit(False))).alias("met"))
    out = met.groupBy("episode_id").agg(F.count("*").alias("obligations"), F.count_if(~F.col("met")).alias("missing"))
    return out.withColumn("completeness", (F.col("obligations") - F.col("missing")) / F.col("obligations"))


def step_graphs(steps: DataFrame, depends: DataFrame) -> DataFrame:
    """(episode_id, finding): duplicate steps, unknown dependencies, no terminal step that emits, cycles.

    steps: (episode_id, step_id, opcode); depends: (episode_id, step_id, on). Steps that are not grounded, at any
    depth, lie on or behind a cycle. Only episodes whose edges lead both up and down in the order of ids are looked at for it."""
    keys = ["episode_id", "step_id"]
    counted = settle(steps.groupBy(*keys).agg(F.count("*").alias("n"), F.min("opcode").alias("opcode")))
    twice = counted.where("n > 1").select("episode_id", F.lit("duplicate step").alias("finding"))
    known = counted.select("episode_id", F.col("step_id").alias("on"), F.lit(True).alias("here"))
    edges = settle(depends.select(*keys, "on").distinct().join(known, ["episode_id", "on"], "left").select(*keys, "on", "here"))
    unknown = edges.where("here is null").select("episode_id", F.lit("unknown dependency").alias("finding"))
    edges = edges.where("here").drop("here")
    ends = counted.join(edges.select("episode_id", F.col("on").alias("step_id")), keys, "left_anti")
    emits = ends.where("opcode = 'EMIT_OUTPUT'").select("episode_id")
    silent = counted.select("episode_id").distinct().join(emits, "episode_id", "left_anti").select("episode_id", F.lit("no terminal output").alias("finding"))
    doubtful = _may_turn(edges)
    step = lambda name: F.struct(F.col("episode_id"), F.col(name).alias("step_id"))
    asked = settle(counted.join(doubtful, "episode_id", "left_semi").select(step("step_id").alias("node")))
    among = edges.join(doubtful, "episode_id", "left_semi").select(step("step_id").alias("node"), step("on").alias("on"))
    firm = grounded(asked.withColumn("open", F.lit(True)), among)
    cyclic = asked.join(firm, "node", "left_anti").select("node.episode_id", F.lit("cycle").alias("finding"))
    return twice.union(unknown).union(silent).union(cyclic).distinct()


def _may_turn(edges: DataFrame) -> DataFrame:
    """(episode_id) of the episodes that may hold a cycle: of its edges, one leads up in the order of ids and one
    down, or one to itself."""
    up, down, self = (F.bool_or(F.expr(f"`on` {sign} step_id")) for sign in (">", "<", "="))
    return edges.groupBy("episode_id").agg(((up & down) | self).alias("turns")).where("turns").select("episode_id")


def authorize(artifacts: DataFrame, registry: DataFrame, grants: DataFrame) -> DataFrame:
    """(artifact_id, status): authorized, recognized, revoked or unrecognized.

    artifacts: (artifact_id, fingerprint, signer_id, artifact_class, purpose); a signer is looked up by
    fingerprint, and by id only where there is none. registry and grants are declared tables."""
    by_print = registry.select("fingerprint", F.col("signer_id").alias("found"), F.col("lifecycle").alias("state"))
    by_id = registry.select("signer_id", F.col("signer_id").alias("found_id"), F.col("lifecycle").alias("state_id"))
    rows = artifacts.join(F.broadcast(by_print), "fingerprint", "left").join(F.broadcast(by_id), "signer_id", "left")
    blank = _blank("fingerprint")
    rows = rows.withColumn("who", F.when(blank, F.col("found_id")).otherwise(F.col("found"))).withColumn("life", F.when(blank, F.col("state_id")).otherwise(F.col("state")))
    fits = lambda a, b: F.col(a).isin("*") | (F.col(a) == F.col(b))
    granted = F.broadcast(grants.select(F.col("signer_id").alias("who"), F.col("artifact_class").alias("gc"), F.col("purpose").alias("gp")))
    hit = rows.join(granted, "who").where(fits("gc", "artifact_class") & fits("gp", "purpose")).select("artifact_id").distinct().withColumn("granted", F.lit(True))
    status = F.when(F.col("who").isNull(), "unrecognized").when(F.col("life") == "revoked", "revoked").when(F.col("granted"), "authorized").otherwise("recognized")
    return rows.join(hit, "artifact_id", "left").select("artifact_id", status.alias("status"))
