import numpy as np

from tracewell.llm import shingles, vectors

from .test_vectors import DDL, brute


def test_one_id_with_two_vectors_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "LONG", 60)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist(), 1, None, None, None) for i in range(300)]
    centre = rng.standard_normal(16)
    rows += [(1000 + i, (centre + 0.17 * rng.standard_normal(16)).tolist(), 1, None, None, None) for i in range(150)]
    rows += [(5, rows[300][1], 1, None, None, None), (5, rows[7][1], 1, None, None, None), (1001, rows[9][1], 1, None, None, None)]
    got = vectors.near_vectors(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_one_id_with_two_texts_loses_no_link(spark):
    words = lambda seed: [f"w{seed}x{i}" for i in range(120)]
    near = lambda w, k: " ".join([*w[:-k], *["other"] * k])
    a, b = words(1), words(2)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 2)), (3, near(b, 2)), (4, " ".join(words(3)))]
    got = shingles.near_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r.doc_id, r.component_id) for r in got.collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4)}
