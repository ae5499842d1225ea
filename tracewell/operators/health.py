"""Stability readings and their hysteresis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Least coherence, most tension, least dignity, most volatility; readings that must agree.
COHERENCE, TENSION, DIGNITY, VOLATILITY, READINGS = 0.75, 0.25, 0.15, 0.35, 3


def status(readings: DataFrame) -> DataFrame:
    """Readings, clamped to 0..1, with a column for each check and for all."""
    rows = readings
    for c in ("coherence", "tension", "dignity", "volatility"):
        rows = rows.withColumn(c, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))))
    checks = {"coherence_ok": F.col("coherence") >= COHERENCE, "tension_ok": F.col("tension") <= TENSION, "tension_decreasing": F.col("tension_derivative") <= 0, "dignity_ok": F.col("dignity") >= DIGNITY, "volatility_ok": F.col("volatility") <= VOLATILITY}
    rows = rows.withColumns(checks)
    whole = F.lit(True)
    for c in checks:
        whole = whole & F.col(c)
    return rows.withColumn("passes", whole)


def hysteresis(checked: DataFrame, key: str, order: str, readings: int = READINGS, unanimous: bool = True) -> DataFrame:
    """``in_grace`` after each reading: it turns on, and off, once the last ``readings`` agree (or most of them do)."""
    last = Window.partitionBy(key).orderBy(order).rowsBetween(-(readings - 1), Window.currentRow)
    rows = checked.withColumn("n", F.count("*").over(last)).withColumn("good", F.sum(F.col("passes").cast("int")).over(last))
    need = readings if unanimous else readings // 2 + 1
    turn = F.when(F.col("n") < readings, None).when(F.col("good") >= need, True).when(F.col("n") - F.col("good") >= need, False)
    sofar = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("in_grace", F.coalesce(F.last(turn, ignorenulls=True).over(sofar), F.lit(False))).drop("n", "good")
