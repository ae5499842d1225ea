import numpy as np

from tracewell.llm import vectors

from .oracle import same

DDL = "vec_id long, embedding array<float>, label int, rep string, n string, copies string"


def brute(rows, threshold=0.93):
    ok = [i for i, r in enumerate(rows) if r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = {i: np.array(rows[i][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[i][1], np.float32).astype(float)) for i in ok}
    links = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in ok}
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        component = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(links.get(i, [])), component, component == r[0]))
    return sorted(out, key=repr)


def test_against_sql(spark):
    assert same(spark, "op1_pivots") == 500


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist(), int(i % 3), "a", "b", "c") for i in range(400)]
    centre = rng.standard_normal(16)
    rows += [(1000 + i, (centre + 0.17 * rng.standard_normal(16)).tolist(), 1, None, None, None) for i in range(150)]
    rows += [(2000 + i, rows[5][1], 2, None, None, None) for i in range(70)] + [(3000, rows[5][1], 1, None, None, None), (3000, rows[5][1], 1, None, None, None)]
    rows += [(4000, None, 1, None, None, None), (4001, [0.0] * 16, 1, None, None, None), (4002, [float("nan")] * 16, 1, None, None, None), (4003, [None] * 16, 1, None, None, None), (4004, rows[0][1], None, None, None, None), (4005, [], 1, None, None, None), (4006, [1.0], 1, None, None, None), (4007, [2.0], 1, None, None, None), (4008, [float("inf")] * 16, 1, None, None, None)]
    got = vectors.near_vectors(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty_and_null_ids(spark):
    assert vectors.near_vectors(spark.createDataFrame([], DDL)).count() == 0
    rows = [(None, [1.0, 2.0], 1, None, None, None), (5, [1.0, 2.0], 1, None, None, None)]
    assert {(r.vec_id, r.n_links) for r in vectors.near_vectors(spark.createDataFrame(rows, DDL)).collect()} == {(None, 0), (5, 0)}
