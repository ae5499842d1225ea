"""Usage of model calls: totals, breakdowns, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import cost


def calls(receipts: DataFrame) -> DataFrame:
    """The model calls, with counted tokens and cost. A total of 0 falls back to the sum."""
    rows = receipts.where("type = 'model_call'").withColumn("model_id", F.coalesce(F.nullif("model_id", F.lit("")), F.lit("unknown")))
    rows = rows.withColumn("in_tokens", F.coalesce("input_tokens", F.lit(0))).withColumn("out_tokens", F.coalesce("output_tokens", F.lit(0)))
    rows = rows.withColumn("all_tokens", F.coalesce(F.nullif("total_tokens", F.lit(0)), F.col("in_tokens") + F.col("out_tokens")))
    return rows.withColumn("cost_usd", cost(F.col("model_id"), F.col("in_tokens"), F.col("out_tokens"))).withColumn("failed", F.coalesce(F.col("error") != "", F.lit(False)))


def _totals() -> list[Column]:
    return [F.count("*").alias("calls"), F.sum("in_tokens").alias("input_tokens"), F.sum("out_tokens").alias("output_tokens"), F.sum("all_tokens").alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"), F.count_if("failed").alias("errors")]


def summary(receipts: DataFrame, by: list[str]) -> DataFrame:
    """Totals of all receipts and of the model calls of each group."""
    every = receipts.withColumn("is_call", F.col("type") == "model_call")
    priced = calls(receipts).groupBy(*by).agg(*_totals(), F.min("timestamp").alias("time_start"), F.max("timestamp").alias("time_end"))
    counted = every.groupBy(*by).agg(F.count("*").alias("receipts"))
    zero = ["calls", "input_tokens", "output_tokens", "total_tokens", "cost_usd", "errors"]
    joined = counted.join(priced, by, "left").fillna(0, zero).withColumnRenamed("calls", "model_calls")
    return joined.withColumn("error_rate", F.when(F.col("model_calls") > 0, F.col("errors") / F.col("model_calls")).otherwise(0.0))


def breakdown(receipts: DataFrame, by: list[str], provider_default: str = "unknown") -> DataFrame:
    """(group, dimension, value, totals) for model, provider and call site in one pass.

    Each call adds to its model, its provider (named ``provider_default`` when it has none) and,
    if it has one, its call site.
    """
    dims = F.array(F.struct(F.lit("model").alias("dimension"), F.col("model_id").alias("value")), F.struct(F.lit("provider").alias("dimension"), F.coalesce("provider", F.lit(provider_default)).alias("value")), F.struct(F.lit("callsite").alias("dimension"), F.nullif("callsite_id", F.lit("")).alias("value")))
    totals = ["in_tokens", "out_tokens", "all_tokens", "cost_usd", "failed"]
    rows = calls(receipts).select(*by, *totals, F.explode(dims).alias("d")).select(*by, *totals, "d.*").where("value is not null")
    return rows.groupBy(*by, "dimension", "value").agg(*_totals())


def finish_reasons(receipts: DataFrame, by: list[str]) -> DataFrame:
    """Calls by finish reason."""
    return calls(receipts).groupBy(*by, F.coalesce(F.nullif("finish_reason", F.lit("")), F.lit("unknown")).alias("finish_reason")).agg(F.count("*").alias("calls"))


def order_statistics(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact order statistics: the value at index min(int(n * share), n - 1) of each group, and n, mean, least and greatest.

    Values are counted first, so that a hot group is a list of its distinct values and not of its rows.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    placed = counted.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(whole))
    picks = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * s), F.col("n") - 1), F.col(value))).alias(name) for name, s in shares.items()]
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *picks, (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def latencies(receipts: DataFrame, by: list[str]) -> DataFrame:
    """p50, p95, p99, mean, least and greatest latency of model calls, in whole milliseconds."""
    rows = calls(receipts).withColumn("ms", F.col("latency_ms").cast("long"))
    return order_statistics(rows, by, "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def pack_summary(receipts: DataFrame, by: list[str]) -> DataFrame:
    """Receipts by type, and the distinct models and providers, of each group."""
    kinds = receipts.groupBy(*by, "type").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("receipts"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", "n"))), ",").alias("types"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    models = calls(receipts).groupBy(*by).agg(names("model_id").alias("models"), names("provider").alias("providers"), F.sum("all_tokens").alias("total_tokens"))
    return kinds.join(models, by, "left")
