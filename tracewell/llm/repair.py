"""Conversation structure repair: the cheapest edits to a well-formed order of roles, by block tables of cost vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stage

# Roles by their first letter: s, u, a, others. Faults: none, truncated, to be deleted. A row's symbol is 3 * role + fault.
SYMBOLS, PAD = 12, 12
_DELETED = 2
# States after a prefix of (s?(ua)+)?: nothing, s, u, a. What a kept role leads to, and what an inserted or changed one does.
_KEEP = [[1, 2, None, None], [None, 2, None, None], [None, None, 3, None], [None, 2, None, None]]
_NEXT = [2, 2, 3, 2]
_END = (0, 4, 2, 0)
BLOCK = 4
#: Rows of a segment, the part of a conversation that is repaired at once.
SEGMENT = 65_536


def _before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Least costs from each state, before a row, given those after it."""
    if symbol == PAD:
        return costs
    role, fault = divmod(symbol, 3)
    row = []
    for q in range(4):
        ways = [3 + costs[q]]
        if fault != _DELETED:
            ways.append(2 + fault + costs[_NEXT[q]])
            if _KEEP[q][role] is not None:
                ways.append(fault + costs[_KEEP[q][role]])
        row.append(min(ways))
    return tuple(min(row[q], 2 + row[_NEXT[q]], 4 + row[_NEXT[_NEXT[q]]]) for q in range(4))


class Tables:
    """All normalised cost vectors that occur, and for each of them and each block of BLOCK symbols the vector before the
    block and what was added."""

    def __init__(self):
        ids, self.vectors, step, added = {_END: 0}, [_END], [], []
        while len(step) < len(self.vectors):
            to, plus = [], []
            for symbol in range(SYMBOLS + 1):
                costs = _before(self.vectors[len(step)], symbol)
                least = min(costs)
                vector = tuple(c - least for c in costs)
                if vector not in ids:
                    ids[vector] = len(ids)
                    self.vectors.append(vector)
                to.append(ids[vector])
                plus.append(least)
            step.append(to)
            added.append(plus)
        self.step, self.added = np.array(step, np.int32), np.array(added, np.int64)
        n, width = len(self.vectors), SYMBOLS + 1
        self.to, self.plus = np.arange(n, dtype=np.int32)[:, None], np.zeros((n, 1), np.int64)
        for _ in range(BLOCK):  # one symbol before what the tables hold
            first = self.step[self.to]  # (vector, rest, symbol)
            self.plus = (self.plus[:, :, None] + self.added[self.to]).transpose(0, 2, 1).reshape(n, -1)
            self.to = first.transpose(0, 2, 1).reshape(n, -1)
        self.places = width ** np.arange(BLOCK - 1, -1, -1)

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, PAD, np.int64)
        padded[: len(symbols)] = symbols
        return padded.reshape(-1, BLOCK) @ self.places


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


@lru_cache(maxsize=200_000)
def _expanded(vector: int, block: int, state: int) -> tuple[str, tuple[str, ...], int]:
    """A block opened again: edits, what each row prints (``u a`` inserted, ``k`` kept, ``U A`` with a new role) and the
    state after it. ``vector`` holds behind the block; its columns come backward, the edits forward: at equal cost the
    ASCII-least goes first."""
    t, width = tables(), SYMBOLS + 1
    symbols = [block // int(p) % width for p in t.places]
    columns = [t.vectors[vector]]
    for symbol in reversed(symbols):
        columns.append(_before(columns[-1], symbol))
    columns.reverse()
    edits, prints = [], []
    for i, symbol in enumerate(symbols):
        said = ""
        if symbol != PAD:
            role, fault = divmod(symbol, 3)
            while True:
                cost, after = columns[i][state], columns[i + 1]
                if cost == 3 + after[state]:
                    edits.append("D")
                    break
                if cost == 2 + columns[i][_NEXT[state]]:
                    state = _NEXT[state]
                    edits.append("I")
                    said += "ua"[state - 2]
                    continue
                kept = _KEEP[state][role]
                if kept is not None and cost == fault + after[kept]:
                    edits.append("K")
                    said, state = said + "k", kept
                else:
                    state = _NEXT[state]
                    edits.append("R")
                    said += "UA"[state - 2]
                break
        prints.append(said)
    return "".join(edits), tuple(prints), state


def _traced(symbols: np.ndarray, base: int, end: int, state: int, last: bool) -> dict:
    t, first = tables(), (symbols & 128) > 0
    codes = t.blocks(symbols & 127)
    behind = np.empty(len(codes), np.int32)
    v = end
    for i in range(len(codes) - 1, -1, -1):
        behind[i] = v
        v = int(t.to[v, codes[i]])
    edits, said, begun = [], [], state
    for block, v in zip(codes.tolist(), behind.tolist(), strict=True):
        e, p, state = _expanded(v, block, state)
        edits.append(e)
        said.extend(p)
    tail = ""
    while last and _END[state]:
        state = _NEXT[state]
        edits.append("I")
        tail += "ua"[state - 2]
    ids = base + np.cumsum(first) - int(first[0])
    prints: dict[int, str] = {}
    for i, code in enumerate(said[: len(symbols)]):
        if code:
            at = int(ids[i])
            prints[at] = prints.get(at, "") + code
    if tail:
        prints[int(ids[-1])] = prints.get(int(ids[-1]), "") + tail
    return {"from": begun, "to": state, "edits": "".join(edits), "prints": [{"id": k, "code": c} for k, c in prints.items()]}


def _fields(conv: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(ddl).fields])


def _arrow(df: DataFrame, columns: list[str], schema: T.StructType, work) -> DataFrame:
    """A narrow pass over rows in order; ``work`` makes dicts from an iterator of dicts, both a batch at a time."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for row in work(row for batch in batches for row in batch.to_pylist()):
            made.append(row)
            if len(made) >= 500:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def _segments(rows: Iterator[dict]) -> Iterator[dict]:
    """Runs of one conversation's symbols of at most SEGMENT rows; for every vector behind a run, that before it."""
    t, held, number = tables(), None, 0

    def closed(s: dict) -> dict:
        symbols = np.frombuffer(bytes(s["symbols"]), np.uint8).astype(np.int64)
        v, cost = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
        for block in t.blocks(symbols & 127)[::-1]:
            cost += t.plus[v, block]
            v = t.to[v, block]
        roles = (symbols & 127) // 3
        return {"conv_id": s["conv_id"], "part": s["part"], "seg": s["seg"], "base": s["base"], "symbols": bytes(s["symbols"]), "illegal": int((~_legal(roles[:-1], roles[1:])).sum()), "head": int(roles[0]), "tail": int(roles[-1]), "before": v.tolist(), "cost": cost.tolist()}

    for row in rows:
        symbol, left = 3 * row["role_class"] + row["fault"], row["n"]
        rest = 3 * row["role_class"] + _DELETED  # further copies of a row are duplicates (or blank) always
        first = True
        while left:
            if held is None or held["part"] != row["part"] or held["conv_id"] != row["conv_id"] or len(held["symbols"]) == SEGMENT:
                if held is not None:
                    yield closed(held)
                number = number + 1 if held is not None and held["part"] == row["part"] else 0
                held = {"conv_id": row["conv_id"], "part": row["part"], "seg": number, "base": row["id"], "symbols": bytearray()}
            if first:
                held["symbols"].append(symbol | 128)
                left, first = left - 1, False
            else:
                take = min(left, SEGMENT - len(held["symbols"]))
                held["symbols"] += bytes([rest]) * take
                left -= take
    if held is not None:
        yield closed(held)


def _legal(a, b):
    return (a == 0) & (b == 1) | (a == 1) & (b == 2) | (a == 2) & (b == 1)


def _behind(rows: Iterator[dict]) -> Iterator[dict]:
    """From each conversation's last segment to its first: the vector behind it; the first also gets the whole cost."""
    t, held, v, cost, illegal = tables(), None, 0, 0, 0

    def out(first: bool) -> dict:
        return {"conv_id": held["conv_id"], "part": held["part"], "seg": held["seg"], "end": held["end"], "last": held["last"], "first": first, "cost": cost + t.vectors[v][0] if first else None, "illegal": illegal if first else None}

    for row in rows:
        last = held is None or held["conv_id"] != row["conv_id"]
        if held is not None:
            yield out(last)
        if last:
            v, cost, illegal = 0, 0, 0
        elif not _legal(row["tail"], held["head"]):
            illegal += 1
        held = {**row, "end": v, "last": last}
        illegal += row["illegal"]
        cost += row["cost"][v]
        v = row["before"][v]
    if held is not None:
        yield out(True)


def _traces(rows: Iterator[dict]) -> Iterator[dict]:
    """The edits of each segment, for every state in which it may begin (a conversation's first begins in one)."""
    for r in rows:
        symbols = np.frombuffer(r["symbols"], np.uint8).astype(np.int64)
        begins = [0] if r["first"] else range(4)
        yield {"conv_id": r["conv_id"], "part": r["part"], "seg": r["seg"], "ways": [_traced(symbols, r["base"], r["end"], q, r["last"]) for q in begins]}


def _chosen(rows: Iterator[dict]) -> Iterator[dict]:
    """From each conversation's first segment to its last: the edits that begin where those before end."""
    before, state = (), 0
    for r in rows:
        if before != (r["conv_id"],):
            before, state = (r["conv_id"],), 0
        way = next(w for w in r["ways"] if w["from"] == state)
        state = way["to"]
        yield {"conv_id": r["conv_id"], "part": r["part"], "seg": r["seg"], "edits": way["edits"], "prints": way["prints"]}


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    """SHA-256 of each conversation's lines in order, one line in memory at a time."""
    held, digest = None, None
    for r in rows:
        if held != (r["conv_id"],):
            if digest is not None:
                yield {"conv_id": held[0], "sha": digest.hexdigest()}
            held, digest = (r["conv_id"],), hashlib.sha256()
        else:
            digest.update(b"\n")
        digest.update(r["line"].encode("utf-8", "surrogatepass"))
    if digest is not None:
        yield {"conv_id": held[0], "sha": digest.hexdigest()}


_WAYS = "array<struct<`from`:int,`to`:int,edits:string,prints:array<struct<id:bigint,code:string>>>>"


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation in
    ``turns`` (conv_id, turn, role, text), read by turn (nulls first; ties by role, then by the SHA-256 of the text).

    A row's first fault counts: blank (white space only), duplicate (role and text stood before), truncated (does not end
    in a full stop, exclamation or question mark). Kept rows cost 0, a changed role 2, a deletion 3 (a must for blank and
    duplicate rows), an inserted user or assistant row without text 2, a truncated row that stays 1 more. ``audit`` are
    the initials of the cheapest edits after which the roles' initials are ``(s?(ua)+)?``, ASCII-least among equals.

    Costs to the end are vectors over four states. Subtracting their least leaves few different ones, so blocks of four
    rows are steps in a table, backward; each block is opened again, backward, to read its edits forward. Rows are
    ordered by ranges over all conversations and cut into segments: for every vector behind a segment its table gives
    that before, so segments of a long conversation are worked on apart and only one row a segment is passed in order.
    Equal rows are one with a count. The SHA-256 of a conversation is one stream by its nature; it holds a line at a time.

    A null role or text is one space; null conversation ids are one conversation; an empty table gives none; further
    columns go; repeated rows are duplicates.
    """
    conv = turns.schema["conv_id"].dataType
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", space("role"), space("text")).withColumn("digest", F.sha2("text", 256))
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    slim = rows.select("conv_id", "turn", "role", "digest", cls.alias("role_class"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    slim = slim.groupBy("conv_id", "turn", "role", "digest", "role_class", "blank", "cut").agg(F.count("*").alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = slim.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"))
    same = [F.col("l.conv_id").eqNullSafe(F.col("f.conv_id")), F.col("l.role") == F.col("f.role"), F.col("l.digest") == F.col("f.digest")]
    told = F.col("first.turn").eqNullSafe(F.col("turn"))
    lines = slim.alias("l").join(firsts.alias("f"), same).select("l.*", (~told).alias("again"))
    fault = F.when(F.col("blank") | F.col("again"), _DELETED).when(F.col("cut"), 1).otherwise(0)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    lines = lines.withColumn("fault", fault).repartitionByRange(*order).sortWithinPartitions(*order)
    lines = stage(lines.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)), "lines")

    solid = lines.withColumn("more", F.when(F.col("blank"), 0).otherwise(F.col("n") - F.when(F.col("again"), 0).otherwise(1)))
    counts = solid.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum("more").alias("duplicate"),
        F.sum(F.when(F.col("fault") == 1, 1).otherwise(0)).cast("long").alias("truncated"),
    )
    segments = _fields(conv, "part long, seg long, base long, symbols binary, illegal long, head int, tail int, `before` array<int>, cost array<bigint>")
    dealt = lines.repartition("part").sortWithinPartitions("id")
    cut = stage(_arrow(dealt, ["conv_id", "part", "id", "role_class", "fault", "n"], segments, _segments), "segments")
    ends = _fields(conv, "part long, seg long, `end` int, `last` boolean, `first` boolean, cost long, illegal long")
    backward = cut.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
    behind = stage(_arrow(backward, ["conv_id", "part", "seg", "illegal", "head", "tail", "before", "cost"], ends, _behind), "behind")
    opened = cut.select("part", "seg", "base", "symbols").join(behind.select("conv_id", "part", "seg", "end", "first", "last"), ["part", "seg"])
    traces = _arrow(opened, ["conv_id", "part", "seg", "base", "symbols", "end", "first", "last"], _fields(conv, f"part long, seg long, ways {_WAYS}"), _traces)
    forward = traces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    chosen = stage(_arrow(forward, ["conv_id", "part", "seg", "ways"], _fields(conv, "part long, seg long, edits string, prints array<struct<id:bigint,code:string>>"), _chosen), "edits")
    pieces = F.array_sort(F.collect_list(F.struct("part", "seg", "edits")))
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda x: x["edits"]), "").alias("audit"))

    prints = chosen.select("seg", F.explode("prints").alias("x")).select("seg", "x.id", "x.code").join(lines.select("id", "conv_id", "turn", "role", "digest"), "id")
    texts = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"))
    same = [F.col("p.conv_id").eqNullSafe(F.col("t.conv_id")), F.col("p.turn").eqNullSafe(F.col("t.turn")), F.col("p.role") == F.col("t.role"), F.col("p.digest") == F.col("t.digest")]
    said = lambda role, text: F.concat(role, F.lit(":"), text)
    user, assistant, text, nothing = F.lit("user"), F.lit("assistant"), F.col("text"), F.lit("")
    one = lambda c: F.when(c == "u", said(user, nothing)).when(c == "a", said(assistant, nothing)).when(c == "k", said(F.col("role"), text)).when(c == "U", said(user, text)).otherwise(said(assistant, text))
    written = prints.alias("p").join(texts.alias("t"), same).select("p.conv_id", "p.id", "p.seg", "p.code", "p.role", "t.text")
    written = written.select("conv_id", "id", "seg", F.array_join(F.transform(F.filter(F.split("code", ""), lambda c: c != ""), one), "\n").alias("line"))
    written = written.repartition("conv_id").sortWithinPartitions("conv_id", "id", "seg")
    digests = _arrow(written, ["conv_id", "line"], _fields(conv, "sha string"), _digests)

    totals = behind.where("first").select("conv_id", "cost", "illegal")
    out = counts
    for other in (totals, audits, digests):
        out = out.alias("a").join(other.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left").select("a.*", *[F.col(f"b.{c}") for c in other.columns if c != "conv_id"])
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) spoilt by rule, for trials of the repair: by crc32 of ``conv_id:turn`` modulo 20,
    0 drops a row, 1 empties its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes
    its role user. Null roles and texts are one space; so are null ids and turns in what is hashed."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
