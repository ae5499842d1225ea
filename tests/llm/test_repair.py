"""Repair of conversations beside a search over all edits, and at sf0.01 beside the same search on the damaged table."""

import hashlib
import random
import re
import zlib

import pytest

from tracewell.llm import repair
from tracewell.llm.queries import QUERIES

from .oracle import same

NONE = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows):
    """The search keeps, for every state, the cheapest edits so far to the end, as (cost, edits, lines)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    pattern = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", []), "a": (0, "", []), "u": (2, "I", ["assistant:"]), "s": (4, "II", ["user:", "assistant:"])}
    name = {"u": "user", "a": "assistant"}
    for (_, _, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        new = {}
        more = lambda cost, edit, line, rest: (cost + rest[0], edit + rest[1], line + rest[2])
        for q in pattern:
            ways = [more(3, "D", [], best[q])]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                if role[:1] and role[:1] in pattern[q]:
                    ways.append(more(extra, "K", [f"{role}:{text}"], best[role[:1]]))
                ways += [more(2 + extra, "R", [f"{name[x]}:{text}"], best[x]) for x in pattern[q] if x != "s"]
            new[q] = min(ways, key=lambda w: w[:2])
        for _ in range(3):
            new = {q: min([new[q], *[more(2, "I", [f"{name[x]}:"], new[x]) for x in pattern[q] if x != "s"]], key=lambda w: w[:2]) for q in pattern}
        best = new
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, best[""][0], best[""][1], hashlib.sha256("\n".join(best[""][2]).encode()).hexdigest())


def by_conversation(rows):
    found = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    return found


def turns(draw, convs, most):
    out = []
    for c in [None, *range(convs)]:
        for t in range(draw.randint(1, most)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            out.append((c, draw.choice([t, t, t, t, None]), role, draw.choice(["Yes.", "No", "Why?\n", "", " \t", None, "é!", f"row {t}.", f"row {t}"])))
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("segment", [5, 65_536])
def test_against_search(spark, segment, monkeypatch):
    draw = random.Random(segment)
    rows = turns(draw, 60, 9) + turns(draw, 3, 400) + [(900, 1, "user", "Yes.")] * 300 + [(901, t, "assistant", "Same.") for t in range(200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n string").repartition(6)
    if segment == 5:  # workers take the module as it is in the driver's folder, so the size goes in with the function
        monkeypatch.setattr(repair, "SEGMENT", segment)
        local = list(repair._segments(iter([{"conv_id": 1, "part": 0, "id": i, "role_class": i % 4, "fault": i % 3, "n": 1 + i % 7} for i in range(20)])))
        assert max(len(s["symbols"]) for s in local) == 5 and sum(len(s["symbols"]) for s in local) == sum(1 + i % 7 for i in range(20))
    spark.conf.set("spark.sql.shuffle.partitions", 31 if segment == 5 else 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blank = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    assert got == {c: plain(rs) for c, rs in by_conversation(blank).items()}


def test_segments_join_as_one_run():
    draw = random.Random(1)
    symbols = [draw.randrange(12) for _ in range(301)]
    t = repair.tables()
    for size in (1, 3, 4, 50, 301):
        parts = [symbols[i : i + size] for i in range(0, 301, size)]
        v, ends = 0, []
        for part in reversed(parts):
            ends.append(v)
            for block in t.blocks(repair.np.array(part))[::-1]:
                v = int(t.to[v, block])
        state, edits = 0, ""
        for part, end in zip(parts, reversed(ends), strict=True):
            way = repair._traced(repair.np.array(part) | 128, 0, end, state, part is parts[-1])
            state, edits = way["to"], edits + way["edits"]
        if size == 1:
            want = edits
        assert edits == want and state in (0, 3)


def test_empty_and_dropped(spark):
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert repair.repair(repair.damage(none)).count() == 0


def test_query(spark):
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: (0, 0, 0, 0, 0, 0, "", NONE) for c in {r[0] for r in table}} | {c: plain(rs) for c, rs in by_conversation(damaged(table)).items()}
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_repair"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_query_equals_sql(spark):
    assert same(spark, "op13_repair") > 0
