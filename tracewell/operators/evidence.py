"""Evidence of answers: references into packs by JSON pointers, what they are worth, and questionnaires as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import canonical_digest
from .textgate import LINES, question_hint

# Words that affirm, hints of answers.
AFFIRMING = ("yes", "true", "pass", "passed", "present", "compliant", "ok")
HINTS = ("yes_no", "free_text", "numeric", "multi_select", "unknown")


def resolve_pointer(value: Column, pointer: Column) -> Column:
    """The part of a variant that a pointer of the row leads to (``a.b.0`` or ``/a/b/0``; ``~1`` is a slash, ``~0`` a tilde),
    as a variant; null where it leads nowhere. An empty pointer is the whole. Digits index lists; everything else, digits
    in objects too, is a name; a name with a double quote is found nowhere."""
    pointer = F.coalesce(pointer, F.lit(""))
    tokens = F.filter(F.split(pointer, F.when(F.startswith(pointer, F.lit("/")), F.lit("/")).otherwise(F.lit("[.]"))), lambda t: t != "")
    clean = F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    digits = "^[0-9]{1,9}$"

    def step(v: Column, t: Column) -> Column:
        # what is no list has no item, and what is no object has no member
        item = F.when(t.rlike(digits), F.get(F.try_variant_get(v, "$", "array<variant>"), F.when(t.rlike(digits), t.cast("int")).otherwise(0)))
        name = F.when(~F.contains(t, F.lit('"')), F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), t))
        return F.coalesce(item, name)

    return F.aggregate(clean, value, step)


def resolve_refs(refs: DataFrame, packs: DataFrame, receipts: DataFrame, files: DataFrame) -> DataFrame:
    """(refs' columns, status, value_type, value, affirmative, number): what each reference to evidence leads to.

    refs: ref_id, pack_id, evidence_kind, receipt_id, path, pointer; packs: pack_id, report (JSON), transcript; receipts:
    pack_id, receipt_id, raw; files: pack_id, path, entry (JSON of a manifest's entry). One row a key in each. status is ok,
    or pack_not_found, receipt_not_found, file_hash_target_not_found, unknown_evidence_kind, target_pointer_not_found.
    value is JSON text. A true, a number above zero, or a word of AFFIRMING affirms; number is null unless the value is one.

    Each kind is an equi-join; only the value that is pointed at leaves its row.
    """
    pack = packs.select("pack_id", F.lit(True).alias("known"), "report", "transcript")
    rows = refs.join(pack, "pack_id", "left")
    is_kind = lambda k: F.col("evidence_kind") == k
    rows = rows.withColumn("asked_receipt", F.when(is_kind("RECEIPT"), F.coalesce("receipt_id", F.lit("")))).withColumn("asked_path", F.when(is_kind("FILE_HASH"), F.coalesce("path", F.lit(""))))
    rows = rows.join(receipts.select("pack_id", F.col("receipt_id").alias("asked_receipt"), F.col("raw").alias("receipt_raw")), ["pack_id", "asked_receipt"], "left")
    rows = rows.join(files.select("pack_id", F.col("path").alias("asked_path"), "entry"), ["pack_id", "asked_path"], "left")
    text = F.when(is_kind("RECEIPT"), F.col("receipt_raw")).when(is_kind("REPORT_SECTION"), F.col("report")).when(is_kind("PACK_TRANSCRIPT"), F.to_json(F.struct(F.coalesce("transcript", F.lit("")).alias("text")))).when(is_kind("FILE_HASH"), F.col("entry"))
    rows = rows.withColumn("found", resolve_pointer(F.try_parse_json(text), F.col("pointer")))
    status = (
        F.when(F.col("known").isNull(), "pack_not_found")
        .when(~F.coalesce(F.col("evidence_kind").isin("RECEIPT", "REPORT_SECTION", "PACK_TRANSCRIPT", "FILE_HASH"), F.lit(False)), "unknown_evidence_kind")
        .when(is_kind("RECEIPT") & F.col("receipt_raw").isNull(), "receipt_not_found")
        .when(is_kind("FILE_HASH") & F.col("entry").isNull(), "file_hash_target_not_found")
        .when(F.col("found").isNull(), "target_pointer_not_found")
        .otherwise("ok")
    )
    rows = rows.withColumn("schema", F.schema_of_variant("found"))
    kind = F.col("schema")
    kind = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(F.startswith(kind, F.lit("ARRAY")), "array").when(F.startswith(kind, F.lit("OBJECT")), "object").otherwise("null")
    rows = rows.withColumn("status", status).withColumn("value_type", F.when(F.col("status") == "ok", kind)).withColumn("number", F.when(F.col("value_type") == "number", F.try_variant_get("found", "$", "double")))
    word = F.lower(F.regexp_replace(F.try_variant_get("found", "$", "string"), r"(?U)^\s+|\s+$", ""))
    affirms = F.when(F.col("value_type") == "boolean", F.try_variant_get("found", "$", "boolean")).when(F.col("value_type") == "number", F.col("number") > 0).when(F.col("value_type") == "string", word.isin(*AFFIRMING)).otherwise(False)
    return rows.select(*refs.columns, "status", "value_type", F.when(F.col("status") == "ok", F.to_json("found")).alias("value"), affirms.alias("affirmative"), "number")


def pack_index(packs: DataFrame, files: DataFrame, receipts: DataFrame) -> DataFrame:
    """(pack_id, digest, receipts): each pack's digest over its id, its files by path and its manifest's SHA-256.

    packs: pack_id, manifest_sha256; files: pack_id, path, sha256 (as many as one manifest lists); receipts: pack_id."""
    listed = files.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("files"))
    counts = receipts.groupBy("pack_id").agg(F.count("*").alias("receipts"))
    rows = packs.join(listed, "pack_id", "left").join(counts, "pack_id", "left")
    none = F.array().cast("array<struct<path:string,sha256:string>>")
    digest = canonical_digest(F.struct(F.coalesce("files", none).alias("files"), "manifest_sha256", "pack_id"))
    return rows.select("pack_id", digest.alias("digest"), F.coalesce("receipts", F.lit(0)).alias("receipts"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def questions_of_markdown(files: DataFrame) -> DataFrame:
    """(file, line, question_id, question_text, type_hint, required_format) of Markdown questionnaires (file, text).

    Blank lines, headings and all between fences of three backticks are skipped; a list mark goes; ``name: text`` gives the id,
    and lines without one are numbered q001, q002, ... in their file, empty ones too. Fences and numbers are running
    sums over a file's lines."""
    raw = files.select("file", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINES)).alias("line", "raw"))
    line = raw.select("file", (F.col("line") + 1).alias("line"), _strip(F.col("raw")).alias("t"))
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.startswith("t", F.lit("```"))
    line = line.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(upto))
    line = line.where(~fence & (F.col("fences") % 2 == 0) & (F.col("t") != "") & ~F.startswith("t", F.lit("#")))
    item = r"^(?:[-*]|\d+[.)])(?U)\s+(.*)$"
    line = line.withColumn("t", F.when(F.col("t").rlike(item), _strip(F.regexp_extract("t", item, 1))).otherwise(F.col("t")))
    named = r"^(Q\d+|q\d+|[A-Za-z_][A-Za-z0-9_\-]*):(?U)\s+(.*)$"
    own = F.col("t").rlike(named)
    line = line.withColumn("own", own).withColumn("n", F.sum(F.when(own, 0).otherwise(1)).over(upto))
    text = _strip(F.when(F.col("own"), F.regexp_extract("t", named, 2)).otherwise(F.col("t")))
    name = F.when(F.col("own"), F.regexp_extract("t", named, 1)).otherwise(F.format_string("q%03d", "n"))
    out = line.select("file", "line", name.alias("question_id"), text.alias("question_text")).where("question_text <> ''")
    return out.withColumn("type_hint", question_hint(F.col("question_text"))).withColumn("required_format", F.lit("text"))


def questions_of_table(rows: DataFrame) -> DataFrame:
    """(file, line, question_id, question_text, type_hint, required_format, error) of questionnaires read from CSV.

    rows: file, line (from 1 in each file) and any of question_id, id, question_text, question, text, type_hint,
    required_format. The first name of each that is not empty counts; a missing id is q and the line's number; an unknown
    hint is ``unknown``. A row without text keeps its line and has an error."""
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns], F.lit(None).cast("string"))
    number = F.format_string("q%03d", "line")
    text = _strip(F.coalesce(first("question_text", "question", "text"), F.lit("")))
    given = F.lower(_strip(F.coalesce(first("type_hint"), question_hint(text))))
    name = F.coalesce(F.nullif(_strip(F.coalesce(first("question_id", "id"), number)), F.lit("")), number)
    form = F.coalesce(F.nullif(_strip(F.coalesce(first("required_format"), F.lit("text"))), F.lit("")), F.lit("text"))
    return rows.select("file", "line", name.alias("question_id"), text.alias("question_text"), F.when(given.isin(*HINTS), given).otherwise("unknown").alias("type_hint"), form.alias("required_format"), F.when(text == "", "empty_question_text").alias("error"))
