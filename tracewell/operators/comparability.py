"""Contracts of comparability over pairs of evidence bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "contract string, ord int, field string, rule string, severity string, grp string, requirement string, threshold double"


def contract_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Parity fields of one or more contracts."""
    return spark.createDataFrame(rows, FIELDS)


def matched():
    """Does a field match? Types must agree where no rule says otherwise, and null never matches."""
    a, b = F.col("a_value"), F.col("b_value")
    exact = (F.col("a_type") == F.col("b_type")) & (a == b)
    lines = lambda c: F.sha2(F.regexp_replace(c, "\r\n?", "\n"), 256)
    hashed = lambda c: F.startswith(c, F.lit("sha256:"))
    proper = lambda c: c.rlike("^sha256:[0-9a-fA-F]{64}$")
    content = F.when(hashed(a) != hashed(b), F.lit(False)).when(hashed(a), proper(a) & proper(b) & (F.lower(a) == F.lower(b))).otherwise(lines(a) == lines(b))
    near = F.when(F.col("threshold").isNull(), exact).otherwise(F.abs(F.expr("try_cast(a_value as double)") - F.expr("try_cast(b_value as double)")) <= F.col("threshold"))
    rule = F.when(F.col("rule") == "content_hash", content).when(F.col("rule") == "version_match", F.trim(a) == F.trim(b)).when(F.col("rule") == "within_threshold", near).otherwise(exact)
    return F.coalesce(rule, F.lit(False))


def compare(pairs: DataFrame, bundles: DataFrame, contracts: DataFrame) -> DataFrame:
    """(pair_id, contract, ord, field, severity, state): matched, mismatched, missing, or absent where a
    field that is not required lacks. pairs: (pair_id, baseline, candidate); bundles: (ref, field, type, value).

    The contract is a declared list of a few dozen fields, so it goes to each pair."""
    rows = pairs.crossJoin(F.broadcast(contracts))
    side = lambda s, x: bundles.select(F.col("ref").alias(x), "field", F.col("type").alias(f"{s}_type"), F.col("value").alias(f"{s}_value"), F.lit(True).alias(f"{s}_has"))
    rows = rows.join(side("a", "baseline"), ["baseline", "field"], "left").join(side("b", "candidate"), ["candidate", "field"], "left")
    lacks = F.col("a_has").isNull() | F.col("b_has").isNull()
    state = F.when(lacks, F.when(F.col("requirement") == "REQUIRED", "missing").otherwise("absent")).when(matched(), "matched").otherwise("mismatched")
    return rows.select("pair_id", "contract", "ord", "field", "severity", "grp", state.alias("state"))


def verdicts(compared: DataFrame) -> DataFrame:
    """(pair_id, contract, counts, verdict, instrument): an invalidating mismatch denies, whatever is missing;
    a degrading one downgrades only if nothing required is missing."""
    bad = lambda s: F.count_if((F.col("state") == "mismatched") & (F.col("severity") == s))
    rows = compared.groupBy("pair_id", "contract").agg(bad("INVALIDATING").alias("invalidating"), bad("DEGRADING").alias("degrading"), F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "matched").alias("matched"), F.count_if((F.col("grp") == "INSTRUMENT_IDENTITY") & (F.col("state") == "mismatched")).alias("instrument_changes"))
    verdict = F.when(F.col("invalidating") > 0, "DENIED").when((F.col("degrading") > 0) & (F.col("missing") == 0), "DOWNGRADED").when(F.col("missing") > 0, "UNDETERMINED").otherwise("SATISFIED")
    return rows.withColumn("verdict", verdict)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, change) of two contracts' clauses."""
    rank = lambda c: F.when(c == "INVALIDATING", 2).when(c == "DEGRADING", 1).otherwise(0)
    a = old.select("field", F.col("severity").alias("sa"), F.struct("rule", "threshold").alias("ra"))
    b = new.select("field", F.col("severity").alias("sb"), F.struct("rule", "threshold").alias("rb"))
    change = F.when(F.col("ra").isNull(), "added").when(F.col("rb").isNull(), "removed").when(rank(F.col("sb")) < rank(F.col("sa")), "severity_relaxed").when(rank(F.col("sb")) > rank(F.col("sa")), "severity_tightened").when(~F.col("ra").eqNullSafe(F.col("rb")), "rule_changed")
    return a.join(b, "field", "full").withColumn("change", change).where("change is not null").select("field", "change")


def flips(pairs: DataFrame, bundles: DataFrame, contracts: DataFrame, old: str, new: str) -> DataFrame:
    """(pair_id, old_verdict, new_verdict) where two contracts judge a pair differently."""
    found = verdicts(compare(pairs, bundles, contracts))
    side = lambda name, c: found.where(F.col("contract") == name).select("pair_id", F.col("verdict").alias(c))
    return side(old, "old_verdict").join(side(new, "new_verdict"), "pair_id").where("old_verdict <> new_verdict")
