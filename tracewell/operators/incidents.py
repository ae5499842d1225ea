"""Events of receipts, causal chains, and where a run first diverged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import settle
from .ancestry import ancestors

# Verdicts that deny.
DENYING = ("deny", "denied", "block", "blocked")


def classify(receipts: DataFrame) -> DataFrame:
    """Receipts with severity and summary."""
    kind, name = F.col("type"), lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    failed = (kind == "model_call") & F.coalesce(F.col("error") != "", F.lit(False))
    blocked = (kind == "guardian_verdict") & F.coalesce(F.col("verdict").isin(*DENYING), F.lit(False))
    denied = (kind == "mcp_tool_call") & (F.coalesce(F.col("policy_verdict") == "deny", F.lit(False)) | F.coalesce(F.col("outcome") == "denied", F.lit(False)))
    tokens = F.concat(F.lit(" ("), F.coalesce("input_tokens", F.lit(0)), F.lit("+"), F.coalesce("output_tokens", F.lit(0)), F.lit(" tokens)"))
    summary = (
        F.when(failed, F.concat(F.lit("Model call FAILED: "), name("model_id"), F.lit(" -- "), "error"))
        .when(kind == "model_call", F.concat(F.lit("Model call: "), name("model_id"), tokens))
        .when(blocked, F.concat(F.lit("Guardian: DENY "), name("action")))
        .when(kind == "guardian_verdict", F.concat(F.lit("Guardian: ALLOW "), name("action")))
        .when(denied, F.concat(F.lit("Tool DENIED: "), name("tool_name")))
        .when(kind == "mcp_tool_call", F.concat(F.lit("Tool call: "), name("tool_name")))
        .otherwise(F.concat(kind, F.lit(": "), F.substring("receipt_id", 1, 12)))
    )
    return receipts.withColumn("severity", F.when(failed | blocked | denied, "critical").otherwise("normal")).withColumn("summary", summary)


def summary(classified: DataFrame, by: list[str]) -> DataFrame:
    """Events, critical events and types of each group."""
    return classified.groupBy(*by).agg(F.count("*").alias("events"), F.count_if(F.col("severity") == "critical").alias("critical"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def chains(receipts: DataFrame, starts: DataFrame, by: str = "pack_id", depth: int | None = None) -> DataFrame:
    """(by, receipt_id, step, ancestor): parents of every start, step by step, until one is missing or
    comes again, or ``depth`` is reached if one is given. Steps double from round to round."""
    named = receipts.where("receipt_id <> ''").groupBy(by, "receipt_id").agg(F.max("parent_receipt_id").alias("parent"))
    node = lambda c: F.struct(F.col(by).alias("by"), F.col(c).alias("id"))
    nodes = named.select(node("receipt_id").alias("node"), node("parent").alias("parent"))
    known = settle(nodes).where("parent.id <> ''").join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
    first = starts.select(node("receipt_id").alias("node")).distinct()
    up = ancestors(known.select("node", "parent"), first, depth).union(first.select("node", F.lit(0).cast("long"), F.col("node").alias("ancestor")))
    return up.select(F.col("node.by").alias(by), F.col("node.id").alias("receipt_id"), F.col("step").cast("int").alias("step"), F.col("ancestor.id").alias("ancestor"))


def first_divergence(classified: DataFrame, pairs: DataFrame, by: str = "pack_id") -> DataFrame:
    """(baseline, current, kind, seq, what): the first call of a model that the baseline never used, else the first critical event."""
    used = classified.where("type = 'model_call'").select(F.col(by).alias("baseline"), "model_id").distinct()
    now = classified.select(F.col(by).alias("current"), "seq", "model_id", "severity", "type", "summary").join(pairs, "current")
    fresh = now.where("type = 'model_call'").join(used, ["baseline", "model_id"], "left_anti").groupBy("baseline", "current").agg(F.min(F.struct("seq", F.col("model_id").alias("what"))).alias("m"))
    bad = now.where("severity = 'critical'").groupBy("baseline", "current").agg(F.min(F.struct("seq", F.col("summary").alias("what"))).alias("c"))
    both = pairs.join(fresh, ["baseline", "current"], "left").join(bad, ["baseline", "current"], "left").where("m is not null or c is not null")
    picked = F.when(F.col("m").isNotNull(), F.struct(F.lit("new_model").alias("kind"), "m.seq", "m.what")).otherwise(F.struct(F.lit("critical_event").alias("kind"), "c.seq", "c.what"))
    return both.select("baseline", "current", picked.alias("p")).select("baseline", "current", "p.*")
