"""Call sites of a contract against the sites that receipts show; scan reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def callsite_id(path: Column, line: Column) -> Column:
    """First 12 hex digits of SHA-256 of path:line."""
    return F.substring(F.sha2(F.concat_ws(":", path, line), 256), 1, 12)


def contract(findings: DataFrame, skip: tuple[str, ...] = ("langchain", "litellm")) -> DataFrame:
    """Sites that a contract covers: findings of other than low confidence, without the skipped frameworks."""
    kept = findings.where((F.col("confidence") != "low") & ~F.coalesce(F.col("framework").isin(*skip), F.lit(False)))
    return kept.select("project", callsite_id(F.col("path"), F.col("line")).alias("callsite_id"), "path", "line").distinct()


def verify(sites: DataFrame, receipts: DataFrame, by: str = "project") -> DataFrame:
    """(by, covered, uncovered, extra, pct): contract sites against the sites of receipts; an empty contract is whole."""
    wanted = sites.select(by, "callsite_id").distinct().withColumn("w", F.lit(True))
    seen = receipts.where("callsite_id <> ''").select(by, "callsite_id").distinct().withColumn("s", F.lit(True))
    both = wanted.join(seen, [by, "callsite_id"], "full")
    counts = both.groupBy(by).agg(F.count_if(F.col("w") & F.col("s")).alias("covered"), F.count_if(F.col("w") & F.col("s").isNull()).alias("uncovered"), F.count_if(F.col("w").isNull()).alias("extra"))
    total = F.col("covered") + F.col("uncovered")
    return counts.withColumn("pct", F.when(total == 0, 1.0).otherwise(F.col("covered") / total))


def scan_summary(findings: DataFrame, by: str = "project") -> DataFrame:
    """Sites, instrumented sites, and uninstrumented ones by confidence."""
    bare = ~F.col("instrumented")
    level = lambda c: F.count_if(bare & (F.col("confidence") == c)).alias(c)
    return findings.groupBy(by).agg(F.count("*").alias("sites_total"), F.count_if("instrumented").alias("instrumented"), F.count_if(bare).alias("uninstrumented"), level("high"), level("medium"), level("low"))


def is_test(path: Column) -> Column:
    """Does a folder or file name of the path mark tests?"""
    return F.exists(F.split(path, "/"), lambda p: p.isin("test", "tests", "testing", "test_utils") | F.startswith(p, F.lit("test_")) | F.endswith(p, F.lit("_test.py")))


def gap_report(findings: DataFrame, by: str = "project") -> DataFrame:
    """Coverage of the high and medium findings, split by production and test code."""
    counts = findings.where("confidence in ('high', 'medium')")
    rows = counts.withColumn("test", is_test(F.col("path")))
    one = rows.groupBy(by).agg(F.count("*").alias("counted"), F.count_if("instrumented").alias("covered"), F.count_if(~F.col("test") & ~F.col("instrumented")).alias("production_gaps"), F.count_if(F.col("test") & ~F.col("instrumented")).alias("test_gaps"))
    every = findings.groupBy(by).agg(F.count("*").alias("findings"))
    out = every.join(one, by, "left").fillna(0)
    return out.withColumn("pct", F.when(F.col("counted") > 0, F.col("covered") / F.col("counted") * 100).otherwise(0.0))


def study(summaries: DataFrame) -> DataFrame:
    """One row over all repositories: totals, and how many are covered not at all, in part and wholly."""
    i, n = F.col("instrumented"), F.col("sites_total")
    return summaries.agg(F.count("*").alias("repositories"), F.sum(n).alias("sites"), F.sum(i).alias("instrumented"), F.sum("high").alias("high"), F.count_if((n > 0) & (i == 0)).alias("none"), F.count_if((i > 0) & (i < n)).alias("partial"), F.count_if((n > 0) & (i == n)).alias("full"))


def top_repositories(findings: DataFrame, n: int = 10, sites: int = 5, by: str = "project") -> DataFrame:
    """The n repositories with most uninstrumented high-confidence sites, their first sites in order, and how many more there are."""
    bare = findings.where("not instrumented")
    ranked = bare.groupBy(by).agg(F.count_if(F.col("confidence") == "high").alias("high"), F.count("*").alias("all")).orderBy(F.desc("high"), by).limit(n)
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    order = Window.partitionBy(by).orderBy(rank, "path", "line")
    first = bare.join(F.broadcast(ranked), by).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sites)  # n rows
    return first.select(by, "nth", "path", "line", "confidence", "high", F.greatest(F.col("all") - sites, F.lit(0)).alias("remaining"))
