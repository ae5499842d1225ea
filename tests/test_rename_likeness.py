"""Likeness of texts beside difflib's; pairs are dealt over tasks, and few of them are compared in blocks."""

import difflib
import random
from unittest import mock

import pandas as pd
from pyspark.sql import functions as F

from tracewell.operators import renames

from .test_changes import plain_pairs


def test_ratio_is_that_of_difflib_and_its_bound_holds():
    draw = random.Random(3)
    text = lambda most: "".join(draw.choice("ab cé") for _ in range(draw.randint(0, most)))
    for _ in range(1500):
        a, b = text(40), text(40)
        if draw.random() < 0.4:
            b = a[len(a) // 5 :] + " and more"
        want = difflib.SequenceMatcher(a=a, b=b, autojunk=False).ratio()
        assert renames.ratio(a, b) == want <= renames.at_most(a, b), (a, b)
    a, b = text(30) * 400, text(30) * 400 + "x"
    assert renames.at_most(a[:300], b[:300]) >= renames.ratio(a[:300], b[:300])


def test_pairs_that_cannot_win_are_not_compared(spark, monkeypatch):
    draw = random.Random(8)
    sentence = lambda: " ".join(draw.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(40))
    changes = []
    for s in range(4):
        for i in range(5):
            old = sentence()
            changes += [(s, f"a/{i}.md", None, old), (s, None, f"b/{i}.md", old[40:] + " and more")]
        changes += [(s, f"a/left{i}.md", None, sentence()) for i in range(2)] + [(s, None, "b/new.md", sentence())]
    df = spark.createDataFrame(changes, "change_set long, before_path string, after_path string, text string").coalesce(1)
    compared, seen = renames._compared, []

    def counted(pairs, *texts):
        seen.append(pairs.count())
        return compared(pairs, *texts)

    monkeypatch.setattr(renames, "_compared", counted)
    got = {(r[0], r[1], r[2], round(r[3], 9)) for r in renames.pair_renames(df).collect()}
    assert got == plain_pairs(changes)
    assert sum(seen) <= 4 * 7 * 6 / 2, seen  # of 42 pairs a set, at most half


def test_a_pair_is_compared_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        calls.add(len(a))
        return pd.Series([0.5] * len(a))

    texts = [(1, f"p{i}", f"text {i}") for i in range(30)]
    side = spark.createDataFrame(texts, "change_set long, path string, text string")
    pairs = spark.createDataFrame([(1, f"p{i}", f"p{i}", 1.0) for i in range(30)], "change_set long, before_path string, after_path string, likeness double")
    with mock.patch.object(renames, "likeness", counted):
        assert renames._compared(pairs, side, side).count() == 30
    assert calls.value == 30


def test_pairs_are_dealt_over_all_tasks(spark):
    df = spark.createDataFrame([(1, f"a{i}", f"b{i}") for i in range(200)], "change_set long, before_path string, after_path string").coalesce(1)
    dealt = renames._dealt(df)
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(n > 0 for n in dealt.rdd.glom().map(len).collect()) > 1
