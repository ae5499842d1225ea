"""Fixed windows of usage and the drift between neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .usage import calls, order_statistics

# Least calls of a window; (warning, alert) of each rule.
MIN_CALLS = 3
COST, LATENCY, ERRORS = (0.50, 1.00), (0.50, 1.00), (0.05, 0.15)


def windows(receipts: DataFrame, hours: int = 24, by: list[str] = ()) -> DataFrame:
    """Usage in windows of ``hours`` that start at the earliest call's hour; empty windows are absent.

    (by, window_no, window_start, n_calls, cost_usd, errors, p50, models array, dominant): the
    dominant model has most calls, the one seen first if several have.
    """
    by = list(by)
    rows = calls(receipts).where("ts is not null")
    start = rows.groupBy(*by).agg(F.date_trunc("hour", F.min("ts")).alias("origin"))
    joined = rows.join(start, by) if by else rows.crossJoin(F.broadcast(start))  # one row
    seconds = hours * 3600
    at = joined.withColumn("window_no", F.floor((F.unix_micros("ts") - F.unix_micros("origin")) / (seconds * 1_000_000)))
    at = at.withColumn("window_start", F.timestamp_seconds(F.unix_seconds("origin") + F.col("window_no") * seconds))
    keys = [*by, "window_no"]
    totals = at.groupBy(*keys, "window_start").agg(F.count("*").alias("n_calls"), F.sum("cost_usd").alias("cost_usd"), F.count_if("failed").alias("errors"))
    per_model = at.groupBy(*keys, "model_id").agg(F.count("*").alias("c"), F.min(F.struct("ts", "receipt_id")).alias("seen"))
    models = per_model.groupBy(*keys).agg(F.array_sort(F.collect_set("model_id")).alias("models"), F.min(F.struct((-F.col("c")).alias("c"), "seen", "model_id")).alias("m")).withColumn("dominant", F.col("m.model_id")).drop("m")
    p50 = order_statistics(at, keys, "latency_ms", {"p50": 0.5}).select(*keys, "p50")
    return totals.join(models, keys).join(p50, keys, "left")


def flags(found: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, window_no, flag, severity, before, after) between neighbouring windows of at least
    MIN_CALLS calls each: model swap, cost spike, latency drift, error spike."""
    order = Window.partitionBy(*by).orderBy("window_no")
    now = F.struct("n_calls", (F.col("cost_usd") / F.col("n_calls")).alias("cpc"), (F.col("errors") / F.col("n_calls")).alias("rate"), "p50", "models", "dominant")
    rows = found.withColumn("b", now).withColumn("a", F.lag("b").over(order)).where((F.col("a.n_calls") >= MIN_CALLS) & (F.col("b.n_calls") >= MIN_CALLS))
    grade = lambda change, levels: F.when(change >= levels[1], "alert").when(change >= levels[0], "warning")
    relative = lambda c: F.when(F.col(f"a.{c}") > 0, (F.col(f"b.{c}") - F.col(f"a.{c}")) / F.col(f"a.{c}"))
    replaced = (F.size(F.array_except("a.models", "b.models")) > 0) & (F.size(F.array_except("b.models", "a.models")) > 0)
    text = lambda c: F.col(c).cast("string")
    rule = lambda name, severity, a, b: F.struct(F.lit(name).alias("flag"), severity.alias("severity"), a.alias("before"), b.alias("after"))
    rules = F.array(
        rule("model_swap", F.when(F.col("a.dominant") != F.col("b.dominant"), F.when(replaced, "alert").otherwise("warning")), text("a.dominant"), text("b.dominant")),
        rule("cost_spike", grade(relative("cpc"), COST), F.format_string("%.6f", "a.cpc"), F.format_string("%.6f", "b.cpc")),
        rule("latency_drift", grade(relative("p50"), LATENCY), F.format_string("%.1f", "a.p50"), F.format_string("%.1f", "b.p50")),
        rule("error_spike", grade(F.col("b.rate") - F.col("a.rate"), ERRORS), F.format_string("%.4f", "a.rate"), F.format_string("%.4f", "b.rate")),
    )
    return rows.select(*by, "window_no", F.explode(F.filter(rules, lambda r: r.severity.isNotNull())).alias("r")).select(*by, "window_no", "r.*")
