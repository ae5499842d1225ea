import hashlib
import random
from collections import Counter

import numpy as np

from tracewell.llm import suffixes

DDL = "doc_id long, text string, id string, k string, size string, raw long"


def brute(rows):
    n = suffixes.LENGTH
    raws = [(r[1] or "").encode() for r in rows]
    count = Counter(raw[i : i + n] for raw in raws for i in range(len(raw) - n + 1))
    out = []
    for r, raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - n + 1):
            if count[raw[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone[:-1].astype(int)])) == 1).sum())
        out.append((r[0], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shape(r):
    assert all(a < b for a, b in zip(r.low, r.high, strict=True))
    return (r.doc_id, r.n_bytes, sum(r.high) - sum(r.low), len(r.low), r.kept_sha256)


def test_loser_tree_merges_runs():
    random.seed(2)
    keys = [bytes(random.choices(b"ab", k=random.randint(1, 40))) + b"\xff" for _ in range(3000)]
    for pieces in (1, 2, 3, 7, 16):
        runs = []
        for p in range(pieces):
            c = Counter(keys[p::pieces])
            run = sorted(c)
            runs.append(suffixes.front_code(run, [c[k] for k in run]))
        got = list(suffixes.unique(suffixes.merge(runs)))
        want = Counter(keys)
        assert [(k, n) for k, _, n in got] == sorted(want.items())
        before = b""
        for k, s, _ in got:
            assert s == suffixes.shared_from(before, k, 0)
            before = k
    assert list(suffixes.merge([])) == []


def test_anchor_follows_the_string():
    random.seed(3)
    body = bytes(random.choices(b"abcdefg ", k=700))
    a, b = b"x" * 90 + body + b"y" * 300, b"zz" + body
    data = a + b
    text, lo, hi, p, gram = suffixes.anchors(data, np.cumsum([len(a), len(b)]))
    at = lambda s: next(int(q) for l, h, q in zip(lo, hi, p, strict=True) if l <= s <= h)
    for s in range(301):
        assert at(90 + s) - (90 + s) == at(len(a) + 2 + s) - (len(a) + 2 + s)


def test_against_brute_force(spark):
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyzéñ", k=random.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, second = text(120), text(75)
    rows = [(i, text(random.randint(1, 300)), "a", "b", "c", 1) for i in range(60)]
    for i in range(40):
        parts = [text(random.randint(0, 60)), passage[random.randint(0, 80) :], text(random.randint(0, 60)), second, text(random.randint(0, 30))]
        rows.append((100 + i, " ".join(random.sample(parts, len(parts))), None, None, None, None))
    base = text(250).split()
    for i in range(60):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = word()
        rows.append((200 + i, " ".join(w), None, None, None, None))
    line = text(12) + "\n"
    rows += [(300, line * 60, None, None, None, None), (301, "a" * 3000, None, None, None, None), (302, "ab" * 201, None, None, None, None), (303, "é" * 200, None, None, None, None), (304, "é" * 200, None, None, None, None), (305, "q" * 399, None, None, None, None), (306, "q" * 399, None, None, None, None), (307, None, None, None, None, None), (308, "", None, None, None, None)]
    rows += [rows[3], rows[3], (None, rows[110][1], None, None, None, None), (309, rows[10][1], None, None, None, None), (310, rows[10][1] + "x", None, None, None, None), (311, text(4000), None, None, None, None)]
    docs = spark.createDataFrame(rows, DDL).repartition(7)
    want = brute(rows)
    got = suffixes.repeated(docs, keep_text=False).collect()
    diff = [(a, b) for a, b in zip(sorted(map(shape, got), key=repr), want, strict=True) if a != b]
    assert not diff, diff[:5]
    kept = suffixes.repeated(docs).collect()
    for r in kept:
        raw = next((x[1] or "").encode() for x in rows if x[0] == r.doc_id)
        parts = [raw[a:b] for a, b in zip([0, *r.high], [*r.low, len(raw)], strict=True)]
        assert r.kept_text == "".join(p.decode("utf-8", "ignore") for p in parts)
    assert sorted((r.kept_sha256 for r in kept)) == sorted(hashlib.sha256(r.kept).hexdigest() for r in kept) and sorted(map(shape, kept), key=repr) == want


def test_empty(spark):
    assert suffixes.repeated(spark.createDataFrame([], DDL)).count() == 0
    assert suffixes.repeated(spark.createDataFrame([(1, "short", None, None, None, None)], DDL)).first().kept == b"short"
