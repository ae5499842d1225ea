import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
DDL = "doc_id long, text string, lang string, ids string, part string, n long"
ROWS = [(1, "Hello world, it's 12 o'clock.", None, "x", "y", 7), (2, None, "en", None, None, None), (3, "", "en", "", "", 1), (4, "a  b \n\n c　 d  e \u0085", None, None, None, None), (5, "x<|endoftext|> y<|endoftext|>", None, None, None, None), (6, "Hello world, it's 12 o'clock.", None, None, None, None), (7, "é́ñ😀" * 4000, None, None, None, None), (8, "  lead and trail  ", None, None, None, None), (8, "  lead and trail  ", None, None, None, None), (9, "aaaa" * 5000, None, None, None, None), (None, "no id", None, None, None, None)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_prefix_encoding_equals_the_library(library):
    random.seed(1)
    coder = bpe.PrefixBpe(PATH)
    alphabet = ["the", " ", "  ", "\n", "ing", "é", "漢", "😀", "'s", "12", "!", "\t", "Qz", "<|endoftext|>", "\x1c", "​", " ", "ab", "abab", "ther"]
    for _ in range(1500):
        text = "".join(random.choices(alphabet, k=random.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == want, text
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(1500):
        text = "".join(random.choices(letters[: random.randint(1, 26)], k=random.randint(1, 30)))
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    docs = spark.createDataFrame(ROWS, DDL)
    got = {(r.doc_id, r.n_tokens, hashlib.sha256(r.ids_text).hexdigest(), bytes(r.decoded)) for r in bpe.digest_documents(docs, PATH).collect()}
    want = set()
    for row in ROWS:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        want.add((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), library.decode(ids, skip_special_tokens=False).encode()))
    assert got == want
    assert bpe.encode_documents(docs, PATH).where("doc_id = 5").first().ids.count(50256) == 2
    assert bpe.digest_documents(docs.limit(0), PATH).count() == 0


def test_packing_is_gapless_and_exact(spark, library):
    docs = spark.createDataFrame(ROWS, DDL).repartition(3)
    pieces = [r.asDict() for r in packing.pack(docs, PATH, size=64).orderBy("sequence_id", "offset").collect()]
    at = 0
    for p in pieces:
        assert p["sequence_id"] * 64 + p["offset"] == at and p["length"] * 4 == len(p["ids"]) and p["offset"] + p["length"] <= 64
        at += p["length"]
    made = {}
    for p in sorted(pieces, key=lambda p: (str(p["doc_id"]), p["start"])):
        made.setdefault(p["doc_id"], []).extend(np.frombuffer(bytes(p["ids"]), "<u4").tolist())
    for row in ROWS:
        ids = [*library.encode(row[1] or "", add_special_tokens=False).ids, 0]
        if row[0] != 8:
            assert made[row[0]] == ids
    assert sum(r[0] == 8 for r in ROWS) * len([*library.encode(ROWS[7][1], add_special_tokens=False).ids, 0]) == len(made[8])
    crc = packing.pack(docs, PATH).where("doc_id = 1").select(F.crc32("ids").alias("c")).first().c
    assert crc == zlib.crc32(np.array([*library.encode(ROWS[0][1], add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert packing.pack(docs.limit(0), PATH).count() == 0
