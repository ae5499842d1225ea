"""Agent session logs: what each line is, a report for each log, receipts of web tools, changed lines of texts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plain entry types, and the tools of old rows.
PLAIN, TOOLS = ("session", "model_change", "thinking_level_change"), ("web_search", "web_fetch", "browser")


def _kind(v: Column, path: str) -> Column:
    """Type of what stands at a path of a variant."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))


def recognize(rows: DataFrame) -> DataFrame:
    """rows (log, line_no, raw) with entry_type, role and tools of known lines, or skip, the reason why one is skipped."""
    v = F.try_parse_json(F.col("raw"))
    text = lambda path: F.trim(F.when(_kind(F.col("v"), path) == "STRING", F.try_variant_get("v", path, "string")))
    some = lambda c: F.coalesce(c != "", F.lit(False))
    found = rows.where("trim(raw) <> ''").withColumn("v", v)
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    has_tool = ~_kind(F.col("v"), "$.tool").isin("", "VOID")
    tool, kind, role = text("$.tool"), text("$.type"), text("$.message.role")
    content_list = F.startswith(_kind(F.col("v"), "$.message.content"), F.lit("ARRAY"))
    unapproved = (tool == "browser") & F.coalesce(F.try_variant_get("v", "$.sensitive_action_attempted", "boolean"), F.lit(False)) & _kind(F.col("v"), "$.sensitive_action_approved").isin("", "VOID")
    skip = (
        F.when(F.col("v").isNull(), "json_error")
        .when(~is_object, "invalid_entry")
        .when(has_tool, F.when(~F.coalesce(tool.isin(*TOOLS), F.lit(False)), "unsupported_tool").when(unapproved, "invalid_entry"))
        .when(~some(kind), "invalid_entry")
        .when(kind.isin(*PLAIN), None)
        .when(kind == "custom", F.when(~some(text("$.customType")), "invalid_entry"))
        .when(kind == "message", F.when(~some(role), "invalid_entry").when((role == "assistant") & ~content_list, "invalid_entry"))
        .otherwise("unsupported_entry_type")
    )
    items = F.from_json(F.get_json_object("raw", "$.message.content"), "array<struct<type:string,name:string>>")
    called = F.transform(F.filter(items, lambda x: (x["type"] == "toolCall") & (F.trim(x["name"]) != "")), lambda x: F.trim(x["name"]))
    out = found.withColumn("skip", skip)
    known = F.col("skip").isNull()
    out = out.withColumn("entry_type", F.when(known, F.when(has_tool, "legacy_tool").otherwise(kind)))
    out = out.withColumn("role", F.when(F.col("entry_type") == "message", role))
    none = F.array().cast("array<string>")
    tools = F.when(F.col("entry_type") == "legacy_tool", F.array(tool)).when(F.col("role") == "assistant", F.coalesce(called, none)).otherwise(none)
    return out.withColumn("tools", tools).drop("v")


def report(rows: DataFrame, recognized: DataFrame, previews: int = 5) -> DataFrame:
    """(log, lines, blank, imported, skipped, tool_calls, state, first_skipped): one row for each log."""
    lines = rows.groupBy("log").agg(F.count("*").alias("lines"), F.count_if(F.trim("raw") == "").alias("blank"))
    known = recognized.groupBy("log").agg(F.count_if(F.col("skip").isNull()).alias("imported"), F.count_if(F.col("skip").isNotNull()).alias("skipped"), F.sum(F.size("tools")).alias("tool_calls"))
    nth = F.row_number().over(Window.partitionBy("log").orderBy("line_no"))
    first = recognized.where("skip is not null").withColumn("nth", nth).where(F.col("nth") <= previews)
    shown = first.groupBy("log").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "skip"))), lambda x: F.concat_ws(":", x.line_no, x.skip)), ",").alias("first_skipped"))
    out = lines.join(known, "log", "left").fillna(0).join(shown, "log", "left")
    return out.withColumn("state", F.when(F.col("skipped") > 0, "partial").otherwise("clean"))


def web_receipts(recognized: DataFrame) -> DataFrame:
    """(log, line_no, type, tool): a receipt for each use of a web tool in the known lines."""
    used = recognized.where("skip is null").select("log", "line_no", F.explode("tools").alias("tool")).where(F.col("tool").isin(*TOOLS))
    return used.withColumn("type", F.lit("web_tool"))


def posture_eligible(receipts: DataFrame, required: str = "CLEAN", by: str = "pack_id") -> DataFrame:
    """(by, posture, passed): the last posture snapshot of a pack, by time and then line, ranks as high as required."""
    rank = lambda c: F.when(c == "CLEAN", 3).when(c == "DEBT_OUTSTANDING", 2).when(c == "DEBT_OVERDUE", 1).otherwise(0)
    last = receipts.where("type = 'governance_posture_snapshot'").groupBy(by).agg(F.max_by(F.coalesce("posture", F.lit("UNKNOWN")), F.struct(F.coalesce("evaluated_at", F.lit("")), "line_no")).alias("posture"))
    return receipts.select(by).distinct().join(last, by, "left").withColumn("passed", F.coalesce(rank(F.col("posture")) >= rank(F.lit(required)), F.lit(False)))


_SPANS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("before_from", "before_to", "after_from", "after_to")]))


@F.pandas_udf(_SPANS)
def _changed(before: pd.Series, after: pd.Series) -> pd.Series:
    def one(a, b):
        ops = difflib.SequenceMatcher(a=a.splitlines(), b=b.splitlines(), autojunk=False).get_opcodes()
        return [{"before_from": i, "before_to": j, "after_from": k, "after_to": n} for tag, i, j, k, n in ops if tag != "equal"]

    return pd.Series([one(a or "", b or "") for a, b in zip(before, after, strict=True)])


def changed_spans(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, before_from, before_to, after_from, after_to): runs of lines, counted from 0, that differ.

    Equal texts are left out first; a pair is compared by itself, whatever its length."""
    differ = pairs.where(~F.col(before).eqNullSafe(F.col(after)))
    return differ.select(key, F.explode(_changed(before, after)).alias("s")).select(key, "s.*")
