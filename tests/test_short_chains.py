import pytest

from tracewell.operators import ancestry


@pytest.mark.parametrize("depth", [1, 4, 7])
def test_short_chains_need_no_look_for_rings(spark, monkeypatch, depth):
    parents = {i: i + 1 for i in range(12)} | {20: 21, 21: 22, 22: 20, 30: 31, 31: 20, 40: 40, 41: 40}
    want = set()
    for node in {*parents, 12}:
        at, seen = node, [node]
        while at in parents and parents[at] not in seen and len(seen) <= depth:
            at = parents[at]
            want.add((node, len(seen), at))
            seen.append(at)
    monkeypatch.setattr(ancestry, "_closing", lambda parents: pytest.fail("looked for rings"))
    df = spark.createDataFrame(list(parents.items()), "node long, parent long")
    starts = spark.createDataFrame([(n,) for n in {*parents, 12}], "node long")
    assert {tuple(r) for r in ancestry.ancestors(df, starts, depth).collect()} == want
