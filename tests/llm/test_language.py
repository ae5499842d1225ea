import itertools
import math

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tracewell.llm import language
from tracewell.llm.queries import op7_language

PATH = public_tokenizers.path("piece_bpe_32k.model")
DDL = "doc_id long, text string, lang string, source string, fit string, score long"


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba"]
    weights = np.array([[0.2, 0.1], [0.1, 0.3], [0.3, 0.2], [0.1, 0.3], [0.3, 0.1]])
    model = language.Model(pieces, ["x", "y"], weights)
    for word in ("a", "abab", "bbaab", "abaabab", "abc"):
        for k in range(2):
            total = 0.0
            for cuts in itertools.product([0, 1], repeat=len(word) - 1):
                parts, at = [], 0
                for i, c in enumerate([*cuts, 1], 1):
                    if c:
                        parts.append(word[at:i])
                        at = i
                p = 1.0
                for part in parts:
                    p *= weights[pieces.index(part), k] if part in pieces else language.FLOOR if len(part) == 1 else 0
                total += p
            assert math.isclose(math.exp(model.log_words([word])[0, k]), total, rel_tol=1e-9)


def test_held_out_accuracy(spark):
    got = op7_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = got.join(docs, "doc_id").where("held_out and lang is not null")
    assert got.count() == docs.count() and held.where("lang = lang_pred").count() >= 0.97 * held.count()


def test_odd_rows(spark):
    rows = [(1, None, "en", None, None, None), (2, "", None, "s", "f", 1), (3, "123 -- !!", None, None, None, None), (4, "the " * 30_000, None, None, None, None), (4, "x" * 5000, None, None, None, None), (None, "la maison", None, None, None, None)]
    docs = spark.createDataFrame(rows, DDL)
    model = language.fit({"en": ["the house and the tree"], "fr": ["la maison et le jardin"]}, language.vocabulary(PATH))
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.predict(docs, model, keep=["source"]).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (None, "fr", True)} <= got and len(got) >= 5
    nothing = language.train(docs.where("false"), F.lit(True), PATH)
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0
