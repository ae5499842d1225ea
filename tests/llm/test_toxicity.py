import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import toxicity
from tracewell.llm.queries import op3_toxicity

DDL = "doc_id long, text string, label int, score string, id string, n_windows long"


def test_gradients_match_differences():
    net = toxicity.Network.new({"ab": 1, "c": 2}, {"abc*": 1, "*bcd": 2}, np.array([0.5, -0.5], np.float32), np.array([1, -1], np.float32), 0.1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    names = ["ab", "c", "abcd"]
    rng = np.random.default_rng(0)
    flat = np.append(rng.integers(0, 3, 60), 0)
    places, mask = toxicity.layout(np.array([0, 32]), np.array([40, 60]), 60)
    types, y = flat[places], np.array([1.0, 0.0])
    own = np.array([1, 2, 0])

    def loss():
        x = net.inputs(names).astype(np.float64)
        gates = np.matmul(x[None], net.p["wx"]) + net.p["b"]
        logits = net.run(np.stack([gates[0][types[:, 0]], gates[1][types[:, 1]]], axis=1), mask)
        return float(np.mean(np.log1p(np.exp(logits)) - y * logits))

    g = net.gradients(types, mask, net.inputs(names), net.char_rows(names), own, y)
    for key, at in (("u", (0, 1, 2)), ("u", (1, 3, 20)), ("wx", (1, 2, 5)), ("b", (0, 0, 9)), ("a", (3, 2)), ("v", (1,)), ("o", (4,)), ("word", (1, 3)), ("char", (2, 1))):
        old = net.p[key][at]
        net.p[key][at] = old + 1e-3
        up = loss()
        net.p[key][at] = old - 1e-3
        down = loss()
        net.p[key][at] = old
        assert abs((up - down) / 2e-3 - g[key][at]) < 2e-3 * max(1, abs(g[key][at])), key


def test_windows_cover_all_words():
    for n in (1, 15, 16, 17, 48, 49, 64, 65, 1000):
        covered = {w for s in toxicity.windows(n) for w in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))
    assert toxicity.windows(0) == []


def test_held_out_accuracy(spark):
    got = op3_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = got.join(labels, "doc_id").where("held_out and toxic is not null")
    right, toxic, caught, all_rows = held.agg(*[F.expr(f"count_if({c})") for c in ("predicted = toxic", "toxic = 1", "toxic = 1 and predicted = 1")], F.count("*")).first()
    print(right, toxic, caught, all_rows)
    assert right >= 0.97 * all_rows and caught >= 0.9 * toxic


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, None), (2, "", 1, "", "", 1), (3, "!!! --", None, None, None, None), (4, "good day " * 30_000, None, None, None, None), (4, "you idiot", None, None, None, None), (None, "you idiot", None, None, None, None)]
    docs = spark.createDataFrame(rows, DDL)
    net = toxicity.fit(["you idiot fool", "such an idiot", "idiot here"] * 20, [1] * 60, 0.25)
    got = {(r.doc_id, r.n_windows > 0): r.score for r in toxicity.score(docs, net, keep=["label"]).collect()}
    assert got[1, False] == got[2, False] == got[3, False] == 0.25 and all(0 <= s <= 1 for s in got.values())
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (6, 7)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels, F.lit(True)).base == 1.0
    empty = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(docs, empty).count() == len(rows) and toxicity.score(docs.limit(0), net).count() == 0
