"""Shapes of decision records, names of JSON members, digests of sets, coverage matrices and their checks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stages import settle
from .integrity import canonical_json

# Fields that a decision must have, and the values that others may have.
REQUIRED = ["receipt_id", "receipt_type", "receipt_version", "timestamp", "decision_type", "decision_subject", "verdict", "authority_id", "authority_class", "authority_scope", "policy_id", "policy_hash", "episode_id", "disposition", "evidence_sufficient", "provenance_complete"]
VERDICTS = ["APPROVE", "REFUSE", "DEFER", "ABSTAIN", "ROLLBACK", "CONFLICT"]
DISPOSITIONS = ["execute", "block", "defer_with_obligation", "escalate", "compensate", "no_action"]
AUTHORITIES = ["ADVISORY", "AUDITING", "BINDING", "MUTATING", "OVERRIDING"]
CONFIDENCE = ["high", "moderate", "low", "minimal"]
TIERS = ["DRAFT", "CHECKED", "TOOL_VERIFIED", "ADVERSARIAL", "CONSTITUTIONAL"]
DISSENT = ["note", "concern", "objection", "block"]
REF_ROLES = ["supporting", "contradicting", "contextual", "superseded"]
REF_TYPES = ["receipt", "claim", "attestation", "witness_bundle", "metric", "external"]
# Columns of a coverage matrix, its statuses, and those that need evidence.
MATRIX = ["Claim / Question", "Status", "Evidence", "Scope", "Notes"]
STATUSES = ["EVIDENCED", "PARTIAL", "FAILED", "HUMAN_ATTESTED", "OUT_OF_SCOPE"]
WITH_EVIDENCE = ["EVIDENCED", "PARTIAL", "FAILED"]


def decision_shape(decisions: DataFrame, versions: list[str], organs: list[str] | None = None, key: str = "receipt_id") -> DataFrame:
    """(key, field, problem): missing fields and unknown values of decisions.

    decisions: the required fields, and confidence, source_organ, proof_tier, dissent_severity and evidence_refs
    (array of ref_type, ref_id, ref_role). A null counts as missing; required texts that are empty are there, but
    have no known value to break. ``organs``: known source organs, not checked if none are given."""
    problem = lambda when, field, text: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(text).alias("problem")))
    unknown = lambda c, known: F.col(c).isNotNull() & ~F.col(c).isin(*known)
    found = [problem(F.col(c).isNull(), c, "missing") for c in REQUIRED]
    found += [problem(~F.col("receipt_type").eqNullSafe("decision_v1"), "receipt_type", "unknown"), problem(~F.coalesce(F.col("receipt_version").isin(*versions), F.lit(False)), "receipt_version", "unknown")]
    found += [problem(unknown(c, ["", *known]), c, "unknown") for c, known in (("verdict", VERDICTS), ("disposition", DISPOSITIONS), ("authority_class", AUTHORITIES))]
    found += [problem(unknown(c, known), c, "unknown") for c, known in (("confidence", CONFIDENCE), ("proof_tier", TIERS), ("dissent_severity", DISSENT))]
    if organs is not None:
        found.append(problem(unknown("source_organ", organs), "source_organ", "unknown"))

    def of_ref(ref: Column, place: Column) -> Column:
        at = lambda c: F.concat(F.lit("evidence_refs["), place, F.lit("]" + c))
        one = lambda when, c, text: F.when(when, F.struct(at(c).alias("field"), F.lit(text).alias("problem")))
        lacks = [one(ref[c].isNull(), "." + c, "missing") for c in ("ref_type", "ref_id", "ref_role")]
        odd = [one(ref[c].isNotNull() & ~ref[c].isin("", *known), "." + c, "unknown") for c, known in (("ref_type", REF_TYPES), ("ref_role", REF_ROLES))]
        return F.array_compact(F.when(ref.isNull(), F.array(one(F.lit(True), "", "no object"))).otherwise(F.array(*lacks, *odd)))

    refs = F.flatten(F.transform(F.coalesce("evidence_refs", F.array()), of_ref))
    return decisions.select(key, F.explode(F.concat(F.array_compact(F.array(*found)), refs)).alias("p")).select(key, "p.*")


@F.pandas_udf(T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType())]))
def foreign_name(raw: pd.Series) -> pd.DataFrame:
    """The first member name of a JSON text, at any depth, with a character beyond ASCII, and where its object is;
    nulls if there is none or the text can't be read."""

    def find(value, path):
        todo = [(value, path)]
        while todo:
            value, path = todo.pop()
            if isinstance(value, str):  # a name that waits for its turn
                if not value.isascii():
                    return path, value
            elif isinstance(value, dict):
                todo += [x for k, v in reversed(value.items()) for x in (((v, f"{path}.{k}"), (k, path)) if isinstance(v, (dict, list)) else ((k, path),))]
            else:
                todo += [(v, f"{path}[{i}]") for i, v in reversed(list(enumerate(value))) if isinstance(v, (dict, list))]
        return None, None

    def one(text):
        try:
            value = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None, None
        return find(value, "$") if isinstance(value, (dict, list)) else (None, None)

    return pd.DataFrame([one(t) for t in raw], columns=["path", "name"], dtype=object)


def canonical_digest(value: Column) -> Column:
    """SHA-256 of a struct's canonical JSON, with its nulls."""
    return F.sha2(canonical_json(F.to_json(value, {"ignoreNullFields": "false"})), 256)


def stable_id(prefix: str, fields: Column, length: int = 24) -> Column:
    """prefix_ and the first digits of the digest of a struct of fields."""
    return F.concat(F.lit(prefix + "_"), F.substring(canonical_digest(fields), 1, length))


def result_fingerprints(results: DataFrame, by: str, policy_hash: str = "", suite_hash: str = "") -> DataFrame:
    """(by, fingerprint): digest of each group's claim results in the order of their ids, under a policy and suite.

    A group's results are as many as the claims that are declared; they become one value."""
    names = ["claim_id", "passed", "expected", "actual", "severity"]
    rows = results.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("results"))
    ordered = F.transform("results", lambda x: F.struct(*[x[n].alias(n) for n in sorted(names)]))
    text = F.to_json(F.struct(F.lit(policy_hash).alias("policy_hash"), ordered.alias("results"), F.lit(suite_hash).alias("suite_hash")), {"ignoreNullFields": "false"})
    rows = rows.select(by, text.alias("raw"))
    # names stand in order, so a text without escapes is canonical as it is; numbers have a canonical form of their own
    plain = F.col("raw").rlike(r"^[\x20-\x5b\x5d-\x7e]*$") if all(isinstance(results.schema[n].dataType, (T.StringType, T.BooleanType)) for n in names) else F.lit(False)
    return rows.select(by, F.sha2(F.coalesce(F.when(plain, F.col("raw")), canonical_json(F.when(~plain, F.col("raw")))), 256).alias("fingerprint"))


# Fixed value: the characters of Unicode's property White_Space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _strip(text: Column, what: str = _WHITE) -> Column:
    return F.btrim(text, F.lit(what))


def _cells(line: Column) -> Column:
    return F.transform(F.split(_strip(line, "|"), r"\|", -1), lambda x: _strip(x))


def matrix_rows(packets: DataFrame, lines: Column, key: str = "packet_id") -> DataFrame:
    """(key, problem, row, question, status, evidence, scope, notes): the rows below the header of each packet's table
    of coverage. A packet whose table can't be read has one row with the first problem and nulls.

    lines: the packet's text as an array of lines. Below the header, one line is skipped; lines outside of a
    table are too."""
    in_table, open_ended = (lambda x: x.startswith("|")), (lambda x: x.startswith("|") & ~x.endswith("|"))
    header = F.array(*map(F.lit, MATRIX))
    rows = packets.select(key, F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: _strip(x)), lambda x: x != "").alias("l"))
    # each line's cells are cut once; none of a line outside of a table
    rows = rows.select(key, F.transform("l", lambda x: F.struct(in_table(x).alias("within"), open_ended(x).alias("opened"), F.when(in_table(x), _cells(x)).alias("cells"))).alias("l"))
    is_header = lambda x: x["within"] & ~x["opened"] & (x["cells"] == header)
    rows = rows.withColumn("at", F.coalesce(F.array_position(F.transform("l", is_header), True), F.lit(0)).cast("int"))
    above = F.when(F.col("at") > 0, F.slice("l", F.lit(1), F.col("at") - 1)).otherwise(F.col("l"))
    rows = rows.withColumn("body", F.when(F.col("at") > 0, F.filter(F.slice("l", F.col("at") + 2, F.size("l")), lambda x: x["within"])))
    fault = F.array_compact(F.transform("body", lambda x: F.when(x["opened"], "invalid row").when(F.size(x["cells"]) != len(MATRIX), "wrong column count")))
    problem = F.when(F.exists(above, lambda x: x["opened"]), "invalid row").when(F.col("at") == 0, "missing header").when(F.size("body") == 0, "no rows").otherwise(F.get(fault, F.lit(0)))
    rows = rows.withColumn("problem", problem)
    names = ["question", "status", "evidence", "scope", "notes"]
    out = rows.select(key, "problem", F.posexplode_outer(F.when(F.col("problem").isNull(), F.transform("body", lambda x: x["cells"]))).alias("row", "c"))
    return out.select(key, "problem", "row", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])


def evidence_refs(cell: Column) -> Column:
    """The references of a cell, which ";" and " and " part, without back quotes."""
    parts = F.flatten(F.transform(F.split(cell, ";"), lambda x: F.split(x, " and ")))
    refs = F.filter(F.transform(parts, lambda x: _strip(_strip(x), "`")), lambda x: x != "")
    return F.when(F.coalesce(cell, F.lit("")).isin("", "None"), F.array().cast("array<string>")).otherwise(refs)


def coverage_rows_check(rows: DataFrame, scope: DataFrame, files: DataFrame, key: str = "packet_id") -> DataFrame:
    """(key, row, error, what): rows of unknown status, questions that their packet's scope does not declare, and
    files of evidence that are not there.

    scope: (key, question, out) with out true if it is declared as out of scope; a packet that declares none of a
    kind allows all. files: (key, path). What comes after "#" in a reference is not followed.

    The rows are written once and not made anew for each of the three checks."""
    rows = settle(rows.where("row is not null").select(key, "row", "question", "status", "evidence"))
    known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    out = rows.where(~known).select(key, "row", F.lit("unknown status").alias("error"), F.col("status").alias("what"))
    asked = rows.where(known).select(key, "row", "question", (F.col("status") == "OUT_OF_SCOPE").alias("out"))
    declared = scope.select(key, "question", "out").distinct()
    kinds = declared.select(key, "out").distinct()
    lost = asked.join(kinds, [key, "out"], "left_semi").join(declared, [key, "question", "out"], "left_anti")
    lost = lost.select(key, "row", F.when(F.col("out"), "out-of-scope row not declared").otherwise("in-scope row not declared").alias("error"), F.col("question").alias("what"))
    refs = rows.where(F.col("status").isin(*WITH_EVIDENCE)).select(key, "row", F.explode(evidence_refs(F.col("evidence"))).alias("ref")).withColumn("path", F.substring_index("ref", "#", 1))
    gone = refs.join(files.select(key, "path").distinct(), [key, "path"], "left_anti").select(key, "row", F.lit("evidence missing").alias("error"), F.col("path").alias("what"))
    return out.union(lost).union(gone)
