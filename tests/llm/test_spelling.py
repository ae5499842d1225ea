"""Spelling variants beside loops over all pairs, and beside SQL."""

import random
import re
import zlib
from collections import Counter

from tracewell.llm import spelling

from .oracle import same


def plain_words(rows, spoil):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, words[w], len(near[w]), form[w], words.get(form[w]), root(w)) for w in words}


def as_set(df):
    return {tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def test_variants_against_all_pairs(spark):
    draw = random.Random(3)
    words = {"".join(draw.choice("abÀ") for _ in range(draw.randint(5, 8))): draw.randint(3, 60) for _ in range(700)}
    words |= {"a" * n: 3 * 2 ** (n % 9) for n in range(5, 40)} | {"z" * 3000 + "x": 9, "z" * 3000: 3, "y" + "z" * 3000: 20, "aaaaa\U0001f600": 4}
    made = [(w, n, "x", 1) for w, n in words.items()]
    for parts in (1, 7):
        df = spark.createDataFrame(made, "word string, n long, form string, id long").repartition(parts)
        assert as_set(spelling.variants(df)) == plain_variants(words)


def test_nodes_are_shared_exactly_by_common_prefixes(spark):
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(1, 9))) for _ in range(300)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spelling.number_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    number = {}
    for r in rows:
        assert len(r["nodes"]) == len(r["key"])
        for i, x in enumerate(r["nodes"]):
            assert number.setdefault(r["key"][: i + 1], x) == x
    assert len(set(number.values())) == len(number)
    own = [number[w] for w in words]
    assert own == sorted(own)


def test_counts_nulls_and_empty_tables(spark):
    draw = random.Random(9)
    rows = [(draw.choice([None, *range(50)]), draw.choice([None, "", " ".join(draw.choice(["Straße", "ÉTÉété", "colour", "color", "Color", "x" * 5000, "abc1defgh", "naïve×÷ab"]) for _ in range(300))])) for _ in range(120)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    for spoil in (0, 97):
        assert {tuple(r) for r in spelling.count_words(df, spoil=spoil).collect()} == set(plain_words(rows, spoil).items())
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.count_words(none, spoil=97)).count() == 0


def test_query_equals_sql(spark):
    assert same(spark, "op12_spelling") > 0
