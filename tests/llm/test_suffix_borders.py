import random

import pytest

from tracewell.llm import suffixes

from .test_suffixes import DDL, brute, shape


def test_grams_stay_together_unless_they_are_many():
    grams = [bytes([65 + i]) * suffixes.GRAM for i in range(20)]
    keys = sorted(b"R" + g + bytes([97 + k]) for i, g in enumerate(grams) for k in range(26 if i == 7 else 3))
    cuts = suffixes.borders(keys, 10, 20)
    assert cuts == sorted(set(cuts)) and sum(k[: 1 + suffixes.GRAM] == b"R" + grams[7] for k in cuts) >= 3
    assert all(len(k) == 1 + suffixes.GRAM for k in cuts if k[1 : 1 + suffixes.GRAM] != grams[7])
    whole = suffixes.borders(keys, 10, 1000)
    assert all(len(k) == 1 + suffixes.GRAM for k in whole) and suffixes.borders([], 5, 3) == []


@pytest.mark.parametrize("whole", [60_000, 3])
def test_many_partitions_against_brute_force(spark, monkeypatch, whole):
    """With few keys to a partition all that crosses a border is decided by whole strings, else by the sort."""
    monkeypatch.setattr(suffixes, "WHOLE", whole)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    random.seed(12)
    text = lambda n: " ".join("".join(random.choices("abcdefghij", k=random.randint(1, 9))) for _ in range(n))
    passage = text(160)
    rows = [(i, f"{text(random.randint(5, 80))} {passage[random.randint(0, 300) : random.randint(500, len(passage))]} {text(40)}", None, None, None, None) for i in range(250)]
    try:
        got = sorted(map(shape, suffixes.repeated(spark.createDataFrame(rows, DDL), keep_text=False).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)
