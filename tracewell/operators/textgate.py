"""Text jobs: line chunks, claims that a new text raises, web addresses, question hints, index plans."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Class, words before, words after, severity.
TRANSITIONS = [
    ("prototype_to_production", ("prototype", "experimental", "draft", "demo"), ("production-ready", "production ready", "production-grade", "production grade"), "high"),
    ("experimental_to_reliable", ("experimental", "prototype", "early"), ("reliable", "robust", "stable", "dependable"), "medium"),
    ("possible_to_guaranteed", ("possible", "may", "might", "could", "potentially"), ("guarantee", "guarantees", "guaranteed", "ensures", "always"), "high"),
    ("may_might_could_to_does_will", ("may", "might", "could"), ("does", "will", "is now", "now provides"), "medium"),
    ("local_to_general", ("local", "locally", "single", "one configured", "one test"), ("all", "every", "general", "generally", "always", "any environment", "across"), "medium"),
    ("demo_to_enterprise", ("demo", "sample", "toy"), ("enterprise", "organization-wide", "company-wide", "production"), "medium"),
    ("suggestion_to_recommendation", ("suggestion", "suggested", "idea", "option"), ("recommend", "recommends", "recommendation", "should"), "medium"),
    ("recommendation_to_policy", ("recommend", "recommendation", "guidance", "should"), ("policy", "must", "required", "approved"), "high"),
    ("partial_support_to_proven", ("partial", "limited", "supports", "some evidence", "early evidence"), ("proves", "proven", "validated", "verified", "confirms"), "high"),
    ("risk_reduced_to_safe", ("risk reduced", "reduced risk", "reduces risk", "safer", "mitigates"), ("safe", "safety guarantee", "hazard-free", "risk-free"), "high"),
    ("observed_to_causal", ("observed", "correlated", "appeared", "associated"), ("caused", "causes", "because", "led to"), "medium"),
]
# A line with one of these is bounded or aspirational and makes no claim.
ALLOW_MARKERS = ("draft", "future work", "future goal", "goal:", "hypothesis", "roadmap", "exploring", "proposal", "aspiration")
# Markers that do not excuse a line with one of the terms below.
GENERIC_MARKERS = ("prototype", "experimental")
HARD_TERMS = ("approved", "guarantee", "guarantees", "guaranteed", "must", "policy", "production-ready", "production ready", "proven", "proves", "safe", "validated", "verified")
#: Characters and pairs that end a line.
LINES = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def lines(text: Column) -> Column:
    """A text's lines; a break at its end starts no line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, f"(?:{LINES})\\z", ""), LINES))


def line_chunks(docs: DataFrame, size: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, start_line, end_line, text, sha256): runs of at most ``size`` lines."""
    rows = docs.select(id_col, lines(F.col(text_col)).alias("lines"))
    # slices are taken inside the row, so no chunk carries its text's other lines
    piece = lambda at: F.struct(at.alias("at"), F.array_join(F.slice("lines", at + 1, size), "\n").alias("text"), F.least(at + size, F.size("lines")).alias("end_line"))
    parts = F.when(F.size("lines") > 0, F.transform(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(size)), piece))
    rows = rows.select(id_col, F.posexplode(parts).alias("chunk", "p"))
    return rows.select(id_col, "chunk", (F.col("p.at") + 1).alias("start_line"), F.col("p.end_line").alias("end_line"), F.col("p.text").alias("text"), F.sha2(F.col("p.text"), 256).alias("sha256"))


def plain(text: Column) -> Column:
    """A text in lower case with single spaces, also for underlines."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), r"(?U)\s+", " "))


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Does a text, in lower case with single spaces, hold one of the terms? Single words must stand alone."""
    parts = [re.escape(t) if " " in t or "-" in t else rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])" for t in terms]
    return plain(text).rlike("|".join(parts))


def boundary_marker(text: Column, markers: tuple[str, ...] = ALLOW_MARKERS) -> Column:
    """The first marker that bounds a line, or null. A generic one does not if the line makes a hard claim."""
    out = F.lit(None).cast("string")
    for m in reversed(markers):
        name = " ".join(m.lower().replace("_", " ").split())
        held = F.contains(plain(text), F.lit(name))
        out = F.when(held & ~has_any(text, HARD_TERMS) if name in GENERIC_MARKERS else held, F.lit(m)).otherwise(out)
    return out


def new_lines(pairs: DataFrame, key: str, before: str, after: str, markers: tuple[str, ...]) -> DataFrame:
    """(key, before, n, line_text, marker): the lines of the new text that are not blank."""
    rows = pairs.select(key, F.col(before).alias("before"), F.posexplode(lines(F.col(after))).alias("n", "line_text")).where("trim(line_text) <> ''")
    return rows.withColumn("marker", boundary_marker(F.col("line_text"), markers))


def non_claims(pairs: DataFrame, key: str, before: str, after: str, markers: tuple[str, ...] = ALLOW_MARKERS) -> DataFrame:
    """(key, line, reason): lines of the new text that a marker bounds, each once."""
    found = new_lines(pairs, key, before, after, markers).where("marker is not null")
    return found.select(key, (F.col("n") + 1).alias("line"), F.concat(F.lit("bounded_or_aspirational_marker:"), "marker").alias("reason")).distinct()


def claim_transitions(pairs: DataFrame, key: str, before: str, after: str, markers: tuple[str, ...] = ALLOW_MARKERS) -> DataFrame:
    """(key, line, transition, severity): lines of the new text that claim more than the old text did,
    but for those that a marker bounds.

    The detectors are evaluated as columns of one row; only the true ones become rows.
    """
    flags = [F.when(has_any(F.col(before), b), F.lit(i)) for i, (_, b, _, _) in enumerate(TRANSITIONS)]
    rows = pairs.withColumn("open", F.array_compact(F.array(*flags))).where("size(open) > 0")
    rows = rows.select(key, "open", F.posexplode(lines(F.col(after))).alias("n", "line_text")).where("trim(line_text) <> ''")
    rows = rows.where(boundary_marker(F.col("line_text"), markers).isNull())
    hits = [F.when(F.array_contains("open", i) & has_any(F.col("line_text"), a), F.struct(F.lit(name).alias("transition"), F.lit(severity).alias("severity"))) for i, (name, _, a, severity) in enumerate(TRANSITIONS)]
    return rows.select(key, (F.col("n") + 1).alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("h")).select(key, "line", "h.*")


def transition_ids(transitions: DataFrame, report: str) -> DataFrame:
    """The transitions with ids cgt_001, cgt_002, ... in each report's order: by file and line, then by transition, then by
    text. A report of one file may come without the column ``file``, and without ``text``."""
    order = Window.partitionBy(report).orderBy(*[c for c in ("file", "line", "transition", "text") if c in transitions.columns])
    return transitions.withColumn("transition_id", F.format_string("cgt_%03d", F.row_number().over(order)))


def glob_match(path: Column, pattern: str) -> Column:
    """Does a whole path match a pattern? A star also matches slashes."""
    return path.rlike("(?s)^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z") + "\\z")


def claim_evidence_paths(paths: DataFrame, patterns: dict[str, list[str]], key: str, path: str = "path") -> DataFrame:
    """(key, requirement, path): the paths of each change that a requirement's patterns find, each once."""
    hits = [F.when(reduce(or_, (glob_match(F.col(path), p) for p in found)), F.lit(name)) for name, found in patterns.items() if found]
    return paths.select(key, F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *hits))).alias("requirement"), F.col(path).alias("path")).distinct()


def apply_policy(transitions: DataFrame, rules: dict[str, tuple[str, str, list[str]]], evidence: DataFrame, key: str, default: str = "NEEDS_REVIEW") -> DataFrame:
    """The transitions with what their rule requires, what of it has no evidence, severity and verdict.

    rules: class -> (verdict, severity or "" for the transition's own, requirements). A rule whose requirements all
    have evidence passes; one without requirements always gives its verdict. Classes without a rule get the default
    verdict and medium severity. A change's evidence is joined as the set of requirements that have any, which is
    no longer than the rules."""
    kind, none = F.col("transition"), F.array().cast("array<string>")
    verdict, severity, requires = (F.when(F.lit(False), x) for x in (F.lit(""), F.lit(""), none))
    for name, (v, s, needed) in rules.items():
        verdict = verdict.when(kind == name, F.lit(v))
        severity = severity.when(kind == name, F.lit(s) if s else F.col("severity"))
        requires = requires.when(kind == name, F.array(*map(F.lit, needed)).cast("array<string>"))
    met = evidence.groupBy(key).agg(F.collect_set("requirement").alias("met"))
    rows = transitions.withColumns({"verdict": verdict.otherwise(default), "severity": severity.otherwise("medium"), "required": requires.otherwise(none)}).join(met, key, "left")
    missing = F.array_except("required", F.coalesce("met", none))
    rows = rows.withColumn("missing", missing)
    passed = (F.size("required") > 0) & (F.size("missing") == 0)
    return rows.withColumn("verdict", F.when(passed, "PASS").otherwise(F.col("verdict"))).drop("met")


def overall_claims(judged: DataFrame, key: str) -> DataFrame:
    """(key, overall): BLOCK, else NEEDS_REVIEW, else PASS, over a change's transitions."""
    any_of = lambda v: F.coalesce(F.bool_or(F.col("verdict") == v), F.lit(False))
    return judged.groupBy(key).agg(F.when(any_of("BLOCK"), "BLOCK").when(any_of("NEEDS_REVIEW"), "NEEDS_REVIEW").otherwise("PASS").alias("overall"))


def match_domain(url: Column, patterns: list[str]) -> Column:
    """The first pattern that an address's host, port included, matches; "*.x" also matches x."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        test = host.rlike("^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z") + "$")
        if p.startswith("*."):
            test = test | (host == p[2:])
        out = F.when(test, F.lit(p)).otherwise(out)
    return F.when(host != "", out)


def plan_index(proposed: DataFrame, active: DataFrame, key: list[str], source: str) -> DataFrame:
    """(source, key, action): chunks to add, chunks that are stale, and those of sources that are gone."""
    p = proposed.select(source, *key).distinct().withColumn("new", F.lit(True))
    a = active.select(source, *key).distinct().withColumn("old", F.lit(True))
    both = p.join(a, [source, *key], "full")
    alive = proposed.select(source).distinct().withColumn("alive", F.lit(True))
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNotNull(), "keep").when(F.col("alive"), "stale").otherwise("tombstone")
    return both.join(alive, source, "left").select(source, *key, action.alias("action"))


def question_hint(text: Column) -> Column:
    """yes_no, numeric or free_text, by the first rule that fits."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike(r"^(do|does|is|are|can|will|have|has) "), "yes_no").when(low.rlike("how many|number|count|%|latency|cost"), "numeric").otherwise("free_text")


# Words of each kind of claim, tried in this order.
KINDS = [
    ("CERTIFICATION", "soc 2|iso|certif|attest"),
    ("INCIDENT", "incident|breach|outage|security event"),
    ("METRIC", "metric|count|number|latency|token|cost"),
    ("COMMITMENT", "commit|roadmap|guarantee|promise"),
    ("LEGAL", "gdpr|dpa|legal|contract|privacy law"),
    ("PROCESS", "process|policy|procedure|review"),
]


def claim_kind(text: Column) -> Column:
    """The kind of claim that a question asks for."""
    out = F.lit("TECH_CONTROL")
    for kind, words in reversed(KINDS):
        out = F.when(F.lower(text).rlike(words), kind).otherwise(out)
    return out
