"""Integrity of receipts and their order: required fields, duplicates, times, sequence numbers, Merkle roots."""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stages import settle
from ..sources.receipts import parse_time

# The family of each error code.
FAMILIES = {
    "E_PACK_STALE": "stale_evidence",
    "E_TIMESTAMP_INVALID": "stale_evidence",
    "E_SCHEMA_UNKNOWN": "schema_mismatch",
    "E_CANON_MISMATCH": "schema_mismatch",
    "E_DUPLICATE_ID": "schema_mismatch",
    "E_SIG_MISSING": "witness_gap",
    "E_CHAIN_BROKEN": "witness_gap",
    "E_MANIFEST_TAMPER": "tamper_detected",
    "E_PACK_OMISSION_DETECTED": "tamper_detected",
    "E_PACK_SIG_INVALID": "tamper_detected",
    "E_SIG_INVALID": "tamper_detected",
    "E_POLICY_MISSING": "policy_conflict",
    "E_CI_BINDING_MISSING": "policy_conflict",
    "E_CI_BINDING_MISMATCH": "policy_conflict",
    "E_PATH_ESCAPE": "tamper_detected",
}


def _absent(name: str, columns: set[str]) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True)) if name in columns else F.lit(True)


def receipt_errors(receipts: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """(keys, code, field): what is missing or malformed in each receipt."""
    have = set(receipts.columns)
    error = lambda when, code, field: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    rules = [error(_absent(f, have), "E_SCHEMA_UNKNOWN", f) for f in ("receipt_id", "type", "timestamp")]
    rules.append(error(F.col("timestamp").isNotNull() & parse_time(F.col("timestamp")).isNull(), "E_TIMESTAMP_INVALID", "timestamp"))
    if strict:
        rules.append(error(_absent("schema_version", have), "E_SCHEMA_UNKNOWN", "schema_version"))
        rules.append(error(_absent("policy_hash", have) & _absent("governance_hash", have), "E_POLICY_MISSING", "policy_hash"))
        rules.append(error(_absent("signature", have) & _absent("payload_hash", have), "E_SIG_MISSING", "signature"))
    return receipts.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("e")).select(*keys, "e.*")


def families(errors: DataFrame, by: list[str]) -> DataFrame:
    """Errors by family; codes without a family are left out."""
    known = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return errors.withColumn("family", known[F.col("code")]).where("family is not null").groupBy(*by, "family").agg(F.count("*").alias("errors"))


def duplicate_ids(receipts: DataFrame, by: str = "pack_id", order: str = "line_no") -> DataFrame:
    """(by, order, receipt_id) of every receipt whose id came before in its pack."""
    nth = Window.partitionBy(by, "receipt_id").orderBy(order)
    return receipts.where("receipt_id <> ''").select(by, order, "receipt_id").withColumn("nth", F.row_number().over(nth)).where("nth > 1")


def monotonic(receipts: DataFrame, by: str = "pack_id", order: str = "line_no", ties: Sequence[str] = ()) -> DataFrame:
    """Receipts whose timestamp, as text, is less than that of the one before; ``ties`` order receipts of one place."""
    before = F.lag("timestamp").over(Window.partitionBy(by).orderBy(order, *ties))
    rows = receipts.where("timestamp <> ''").withColumn("before", before)
    return rows.where("timestamp < before").select(by, order, "receipt_id")


def trace_findings(receipts: DataFrame, by: str = "trace_id", order: str = "seq", need_id: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """(by, order, level, finding) of every trace: missing type, duplicate or missing id, times that go back or can't be read.
    ``ties`` order receipts of one place."""
    rows = receipts.withColumn("at", parse_time(F.col("timestamp")))
    sofar = Window.partitionBy(by).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    nth = Window.partitionBy(by, "receipt_id").orderBy(order, *ties)
    rows = rows.withColumn("last", F.last("at", ignorenulls=True).over(sofar)).withColumn("nth", F.row_number().over(nth))
    has_id = F.coalesce(F.col("receipt_id") != "", F.lit(False))
    finding = lambda when, level, text: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(text).alias("finding")))
    rules = F.array(
        finding(F.coalesce(F.col("type") == "", F.lit(True)), "error", "missing type"),
        finding(has_id & (F.col("nth") > 1), "error", "duplicate receipt_id"),
        finding(~has_id, "error" if need_id else "warning", "missing receipt_id"),
        finding(F.col("at") < F.col("last"), "error", "time goes back"),
        finding((F.col("timestamp") != "") & F.col("at").isNull(), "warning", "invalid time"),
    )
    return rows.select(by, order, F.explode(F.array_compact(rules)).alias("f")).select(by, order, "f.*")


def sequence_check(receipts: DataFrame, by: str, seq: str, line: str) -> DataFrame:
    """(by, rows, missing, negative, duplicates, falling, state): the store sequence of each file."""
    before = F.lag(seq).over(Window.partitionBy(by).orderBy(line))
    rows = receipts.select(by, seq, line).withColumn("before", before)
    one = rows.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(F.col(seq).isNull()).alias("missing"), F.count_if(F.col(seq) < 0).alias("negative"), F.count_if(F.col(seq) <= F.col("before")).alias("falling"))
    twice = rows.where(F.col(seq).isNotNull()).groupBy(by, seq).count().groupBy(by).agg(F.sum(F.col("count") - 1).alias("duplicates"))
    state = F.when(F.col("missing") == F.col("rows"), "legacy").when(F.col("missing") > 0, "mixed").when((F.col("negative") > 0) | (F.col("falling") > 0) | (F.col("duplicates") > 0), "corrupt").otherwise("sequenced")
    return one.join(twice, by, "left").fillna(0, ["duplicates"]).withColumn("state", state)


def number_rows(receipts: DataFrame, file: str, line: str) -> DataFrame:
    """New store sequence from 0 by (file, line): offsets of ranges of files, of files in their range, then places
    within a file. The ranges are written, as a range partitioning that runs again may cut elsewhere."""
    counts = receipts.groupBy(file).agg(F.count("*").alias("n"))
    ranges = settle(counts.repartitionByRange(file).withColumn("range", F.spark_partition_id()))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a partition is summed in order
    bases = ranges.groupBy("range").agg(F.sum("n").alias("n")).select("range", earlier(Window.orderBy("range")).alias("base"))
    inner = ranges.select(file, "range", earlier(Window.partitionBy("range").orderBy(file)).alias("before"))
    offsets = inner.join(bases, "range").select(file, (F.col("base") + F.col("before")).alias("offset"))
    place = F.row_number().over(Window.partitionBy(file).orderBy(line)) - 1
    return receipts.withColumn("place", place).join(offsets, file).withColumn("store_seq", F.col("offset") + F.col("place")).drop("place", "offset")


def foreign_rows(receipts: DataFrame, by: str, allowed: list[str]) -> DataFrame:
    """(by, line_no, problem): receipts of a type that is not allowed, or of another trace than the pack's first."""
    first = F.first("trace_id").over(Window.partitionBy(by).orderBy("line_no"))
    rows = receipts.select(by, "line_no", "type", "trace_id").withColumn("run", first)
    problem = F.when(~F.col("type").isin(*allowed), "type not allowed").when(F.col("trace_id") != F.col("run"), "other run")
    return rows.withColumn("problem", problem).where("problem is not null").select(by, "line_no", "problem")


def merkle_roots(leaves: DataFrame, by: str, order: str, leaf: str, checkpoint_every: int = 8) -> DataFrame:
    """(by, leaves, root): SHA-256 tree over each group's hex leaves in order; an odd last one pairs with itself.

    Every round halves the rows, so a group of any size needs as many rounds as its size has bits.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    level = leaves.select(by, place.alias("i"), F.col(leaf).alias("h"))
    sizes = level.groupBy(by).agg(F.count("*").alias("leaves"))
    rounds = ((sizes.agg(F.max("leaves")).first()[0] or 1) - 1).bit_length()
    for k in range(rounds):
        width = F.count("*").over(Window.partitionBy(by))
        pairs = level.withColumn("w", width).groupBy(by, F.floor(F.col("i") / 2).alias("j")).agg(F.max("w").alias("w"), F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
        joined = F.sha2(F.concat(F.unhex("a"), F.unhex("b")), 256)
        level = pairs.select(by, F.col("j").alias("i"), F.when(F.col("w") > 1, joined).otherwise(F.col("a")).alias("h"))
        if (k + 1) % checkpoint_every == 0:
            level = settle(level)
    return level.select(by, F.col("h").alias("root")).join(sizes, by)


#: Levels of a tree that are made within one row: a block of 2 ** BITS nodes.
BITS = 8


def _tree_levels(nodes: Column, levels: Column) -> Column:
    """A block's nodes and what they come to, as many levels up as given; a last one without a neighbour pairs with itself."""
    pair = lambda below, j: F.sha2(F.concat(F.unhex(F.get(below, 2 * j)), F.unhex(F.coalesce(F.get(below, 2 * j + 1), F.get(below, 2 * j)))), 256)
    above = lambda below: F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int")), lambda j: pair(below, j))
    steps = F.filter(F.sequence(F.lit(1), F.lit(BITS)), lambda k: k <= levels)
    return F.aggregate(steps, F.array(nodes), lambda made, k: F.concat(made, F.array(above(F.element_at(made, -1)))))


def merkle_proofs(leaves: DataFrame, by: str, order: str, leaf: str) -> DataFrame:
    """(by, place, leaf, proof) of ``rooted_proofs``."""
    return rooted_proofs(leaves, by, order, leaf).drop("root")


def rooted_proofs(leaves: DataFrame, by: str, order: str, leaf: str) -> DataFrame:
    """(by, place, leaf, proof, root): each leaf's siblings from its level up to the root, as hex.

    Leaf by leaf, a proof has as many siblings as its group's size has bits. A row holds a block of 2 ** BITS neighbours,
    of which the proofs within the block are made at once; the roots of a group's blocks are leaves of a tree of their own,
    whose proofs come after. So leaves move twice, whatever the depth, and no proof moves."""
    places = Window.partitionBy(by)
    level = leaves.select(by, (F.row_number().over(places.orderBy(order)) - 1).cast("long").alias("i"), F.col(leaf).alias("h"), F.count("*").over(places).alias("w"))
    several = F.col("w") > 1 << BITS
    levels = F.when(several, BITS).otherwise(F.when(F.col("w") > 1, F.length(F.bin(F.col("w") - 1))).otherwise(0))
    block = F.floor(F.col("i") / (1 << BITS)).alias("block")
    passes = []
    while True:
        packed = level.groupBy(by, block, "w").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("x"))
        packed = settle(packed.select(by, "block", "w", F.col("x.h").alias("nodes")))
        passes.append(packed)
        more = packed.where(several)
        if more.isEmpty():
            break
        level = more.select(by, F.col("block").alias("i"), F.get(F.element_at(_tree_levels(F.col("nodes"), F.lit(BITS)), -1), F.lit(0)).alias("h"), F.ceil(F.col("w") / (1 << BITS)).cast("long").alias("w"))
    above = None
    for packed in reversed(passes):
        rows = packed.withColumn("levels", _tree_levels(F.col("nodes"), levels))
        if above is None:
            rows = rows.withColumn("rest", F.array().cast("array<string>")).withColumn("root", F.get(F.element_at("levels", -1), F.lit(0)))
        else:
            rows = rows.join(above, [by, "block"], "left").withColumn("rest", F.coalesce("rest", F.array())).withColumn("root", F.coalesce("root", F.get(F.element_at("levels", -1), F.lit(0))))
        near = lambda i: F.transform(F.slice("levels", 1, F.size("levels") - 1), lambda made, k: F.coalesce(F.get(made, F.call_function("shiftright", i, k).bitwiseXOR(F.lit(1))), F.get(made, F.call_function("shiftright", i, k))))
        each = F.transform("nodes", lambda h, i: F.struct((F.col("block") * (1 << BITS) + i).alias("place"), h.alias("leaf"), F.concat(near(i), "rest").alias("proof")))
        found = rows.select(by, "root", F.explode(each).alias("x")).select(by, "x.*", "root")
        above = found.select(by, F.col("place").alias("block"), F.col("proof").alias("rest"), "root")
    return found


def merkle_included(leaf: Column, proof: Column, root: Column, place: Column) -> Column:
    """Does a proof lead from the leaf at a place to the root?"""
    start = F.struct(F.unhex(leaf).alias("h"), place.cast("long").alias("i"))
    join = lambda s, x: F.when(s["i"] % 2 == 0, F.concat(s["h"], F.unhex(x))).otherwise(F.concat(F.unhex(x), s["h"]))
    end = F.aggregate(proof, start, lambda s, x: F.struct(F.unhex(F.sha2(join(s, x), 256)).alias("h"), F.floor(s["i"] / 2).cast("long").alias("i")))
    return F.lower(F.hex(end["h"])) == root


def _number(x) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, digits)).rstrip("0") or "0"
    point = len(Decimal(repr(x)).as_tuple().digits) + exponent
    minus = "-" if sign else ""
    if -6 < point <= 21:
        if point <= 0:
            return minus + "0." + "0" * -point + digits
        return minus + (digits + "0" * (point - len(digits)) if point >= len(digits) else digits[:point] + "." + digits[point:])
    e = point - 1
    return minus + digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + "E" + str(e)


def canonical(value) -> str:
    """Canonical JSON: keys in the order of their UTF-16 units, no white space, plain numbers."""
    if value is None:
        return "null"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (bool, int, float)):
        return _number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical(value[k]) for k in keys) + "}"


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null where a text can't be read."""

    def one(text):
        try:
            return canonical(json.loads(text))
        except (TypeError, ValueError):
            return None

    return raw.map(one)


def head_hashes(receipts: DataFrame, by: str = "pack_id", order: str = "line_no", raw: str = "raw") -> DataFrame:
    """(by, head_hash): SHA-256 of the canonical form of each group's last receipt."""
    last = receipts.groupBy(by).agg(F.max_by(raw, order).alias("raw"))
    return last.select(by, F.sha2(canonical_json("raw"), 256).alias("head_hash"))
