"""Declared claims against receipts, debt and posture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Why a critical claim is capped, by the state of its falsifier.
CAPS = {"absent": "capped: no named falsifier", "named": "capped: falsifier named but not executed", "executed_failed": "capped: falsifier execution disproved claim"}


def claim_table(spark: SparkSession, claims: list[dict]) -> DataFrame:
    """Declared claims: claim_id, check, receipt_type, field, expected, min_count, severity, falsifier."""
    names = ["claim_id", "check", "receipt_type", "field", "expected", "min_count", "severity", "falsifier"]
    return spark.createDataFrame([tuple(c.get(n) for n in names) for c in claims], "claim_id string, check string, receipt_type string, field string, expected string, min_count long, severity string, falsifier string")


def check(receipts: DataFrame, claims: list[dict], by: str = "pack_id") -> DataFrame:
    """(by, claim_id, severity, falsifier, passed, actual, first_evidence): every claim for every pack.

    One aggregation over the receipts holds two counts and the first id for each claim, so that
    receipts and claims are never paired. A claim about a
    field fails where no receipt has the type; unknown checks fail.
    """
    kind = F.col("type")
    aggregates: list[Column] = [F.count("*").alias("all")]

    rows = receipts
    for i, c in enumerate(claims):
        match = kind == c.get("receipt_type")
        bad = match & ~F.coalesce(F.col(c["field"]).cast("string") == str(c["expected"]), F.lit(False)) if c["check"] == "field_value_matches" else match
        aggregates += [F.count_if(match).alias(f"m{i}"), F.count_if(bad).alias(f"b{i}"), F.min_by("receipt_id", F.when(bad, F.col("line_no"))).alias(f"e{i}")]
    counted = rows.groupBy(by).agg(*aggregates)

    def result(i: int, c: dict) -> Column:
        m, b = F.col(f"m{i}"), F.col(f"b{i}")
        passed = {"receipt_type_present": m > 0, "no_receipt_type": m == 0, "receipt_count_ge": F.col("all") >= (c.get("min_count") or 0), "field_value_matches": (m > 0) & (b == 0)}.get(c["check"], F.lit(False))
        actual = F.when(F.lit(c["check"] == "receipt_count_ge"), F.col("all")).when(F.lit(c["check"] == "field_value_matches"), b).otherwise(m)
        shown = F.col(f"e{i}") if c["check"] != "receipt_count_ge" else F.lit(None).cast("string")
        return F.struct(F.lit(c["claim_id"]).alias("claim_id"), F.lit(c.get("severity", "critical")).alias("severity"), F.lit(c.get("falsifier", "not_required")).alias("falsifier"), passed.alias("passed"), actual.alias("actual"), shown.alias("first_evidence"))

    return counted.select(by, F.explode(F.array(*[result(i, c) for i, c in enumerate(claims)])).alias("r")).select(by, "r.*")


def evidence(receipts: DataFrame, receipt_type: str, by: str = "pack_id", n: int = 5) -> DataFrame:
    """(by, ids): the first n receipt ids of a type in line order; rows are ranked before they are gathered."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy("line_no"))
    rows = receipts.where(F.col("type") == receipt_type).select(by, "line_no", "receipt_id").withColumn("nth", nth).where(F.col("nth") <= n)
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "receipt_id"))), lambda x: x.receipt_id), ",").alias("ids"))


def rollup(results: DataFrame, by: str = "pack_id") -> DataFrame:
    """Passed, failed and capped claims; overall holds unless a critical claim failed."""
    cap = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    rows = results.withColumn("tier_cap", F.when(F.col("severity") == "critical", cap[F.col("falsifier")]))
    return rows.groupBy(by).agg(F.count("*").alias("claims"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("tier_cap").isNotNull()).alias("capped"), (F.count_if(~F.col("passed") & (F.col("severity") == "critical")) == 0).alias("overall"))


def debt(results: DataFrame, by: str = "pack_id") -> DataFrame:
    """(by, claim_id, source, weight): critical claims that failed, and those without a named test."""
    failed = (F.col("severity") == "critical") & ~F.col("passed")
    item = lambda when, source, weight: F.when(when, F.struct(F.lit(source).alias("source"), F.lit(weight).alias("weight")))
    rules = F.array_compact(F.array(item(failed, "missing_evidence", "severe"), item((F.col("falsifier") == "absent") | ((F.col("severity") == "critical") & F.col("falsifier").isin("named", "executed_failed")), "missing_falsifier", "moderate")))
    return results.select(by, "claim_id", F.explode(rules).alias("d")).select(by, "claim_id", "d.*")


def posture(results: DataFrame, by: str = "pack_id") -> DataFrame:
    """blocked is left to risks; incomplete with failed claims or severe debt, capped if some are, else verified."""
    rolled = rollup(results, by)
    severe = debt(results, by).where("weight = 'severe'").groupBy(by).agg(F.count("*").alias("severe_debt"))
    rows = rolled.join(severe, by, "left").fillna(0, ["severe_debt"])
    return rows.withColumn("disposition", F.when((F.col("failed") > 0) | (F.col("severe_debt") > 0), "incomplete").when(F.col("capped") > 0, "supported_but_capped").otherwise("verified"))
