"""Two packs side by side: models, totals, gates, claims, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import usage


def percent(a: Column, b: Column) -> Column:
    """Change from a to b in percent; infinite from 0."""
    return F.when(a == 0, F.when(b > 0, float("inf")).otherwise(0.0)).otherwise((b - a) / a * 100)


def _sides(rows: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """rows (pack_id, keys, values) of both packs of each pair, values with suffixes _a and _b."""
    values = [c for c in rows.columns if c not in ("pack_id", *keys)]
    side = lambda s, x: rows.join(pairs.select(F.col(x).alias("pack_id"), "pair_id"), "pack_id").select("pair_id", *keys, *[F.col(c).alias(f"{c}_{s}") for c in values])
    return side("a", "pack_a").join(side("b", "pack_b"), ["pair_id", *keys], "full")


def models(receipts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, model_id, calls and cost of either side, status)."""
    per_model = usage.calls(receipts).groupBy("pack_id", "model_id").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"))
    both = _sides(per_model, pairs, ["model_id"])
    return both.withColumn("status", F.when(F.col("calls_a").isNull(), "added").when(F.col("calls_b").isNull(), "removed").otherwise("changed")).fillna(0, ["calls_a", "calls_b", "cost_a", "cost_b"])


def totals(receipts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, calls, tokens, cost, errors, p50 and p95 of either side)."""
    counted = usage.summary(receipts, ["pack_id"]).select("pack_id", "model_calls", "total_tokens", "cost_usd", "errors")
    timed = usage.latencies(receipts, ["pack_id"]).select("pack_id", "p50", "p95")
    return _sides(counted.join(timed, "pack_id", "left"), pairs, [])


def gates(compared: DataFrame, cost_pct: float, p95_pct: float, errors: int, strict: bool = False) -> DataFrame:
    """(pair_id, gate, actual, passed, skipped): a gate without data is skipped, and fails if ``strict``."""
    rise = lambda c: percent(F.col(f"{c}_a").cast("double"), F.col(f"{c}_b").cast("double"))

    def gate(name: str, actual: Column, most: float) -> Column:
        skipped = actual.isNull()
        known = F.when(actual != float("inf"), actual)
        return F.struct(F.lit(name).alias("gate"), known.alias("actual"), F.coalesce(actual <= most, F.lit(not strict)).alias("passed"), skipped.alias("skipped"))

    rules = F.array(gate("cost_pct", rise("cost_usd"), cost_pct), gate("p95_pct", rise("p95"), p95_pct), gate("errors", F.col("errors_b").cast("double"), errors))
    return compared.select("pair_id", F.explode(rules).alias("g")).select("pair_id", "g.*")


def claims(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, claim_id, passed_a, passed_b, status): regressed only from passed to failed."""
    both = _sides(results.select("pack_id", "claim_id", "passed"), pairs, ["claim_id"])
    a, b = F.col("passed_a"), F.col("passed_b")
    return both.withColumn("status", F.when(a.isNull(), "new").when(b.isNull(), "removed").when(a & ~b, "regressed").when(~a & b, "improved").otherwise("unchanged"))


def traces(receipts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, common, only_a, only_b): receipt ids of both traces. pairs: (pair_id, trace_a, trace_b)."""
    ids = receipts.where("receipt_id <> ''").select("trace_id", "receipt_id").distinct()
    side = lambda s: ids.join(pairs.select(F.col(f"trace_{s}").alias("trace_id"), "pair_id"), "trace_id").select("pair_id", "receipt_id", F.lit(True).alias(s))
    both = side("a").join(side("b"), ["pair_id", "receipt_id"], "full")
    count = lambda when, name: F.count_if(when).alias(name)
    return both.groupBy("pair_id").agg(count(F.col("a") & F.col("b"), "common"), count(F.col("a") & F.col("b").isNull(), "only_a"), count(F.col("b") & F.col("a").isNull(), "only_b"))
