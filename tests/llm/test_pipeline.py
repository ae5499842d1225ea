import hashlib

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import language

from .test_shingles import brute as near_brute
from .test_suffixes import brute as repeat_brute

DIR = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def write(df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = [(100_000, None, None, None, None), (100_001, "", "en", "s", 0), (100_002, "12 !", "en", "s", 4), (None, "the and of in that with", "en", "s", 5)]
    given = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("x")).withColumn("kept", F.lit(1))
    given = given.union(given.where("doc_id = 5"))
    kept = [given]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(write(stage(spark, kept[-1], DIR), tmp_path, str(k)))
    got = [rows(d) for d in kept[:5]]
    letters = [r for r in got[0] if r[1] and language.word_list(r[1])]
    assert set(got[1]) <= set(letters) and len(got[1]) >= 0.95 * len(letters)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    gone = set(got[1]) - set(got[2])
    assert set(got[2]) <= set(got[1]) and sum(toxic.get(r[0]) == 0 for r in gone) <= 0.1 * len(got[1])
    stay = {r[0] for r in near_brute([(r[0], r[1]) for r in got[2]]) if r[3]}
    assert sorted(got[3], key=repr) == sorted({r for r in got[2] if r[0] in stay}, key=repr)
    want = {(r[0], r[4]) for r in repeat_brute([(r[0], r[1]) for r in got[3]])}
    assert len(got[4]) == len(got[3]) and {r[2:4] for r in got[4]} <= {r[2:4] for r in got[3]}
    ascii_only = {(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in got[4]}
    cut = {r[0] for r in repeat_brute([(r[0], r[1]) for r in got[3]]) if r[2]}
    assert all(x in want for x in ascii_only if x[0] not in cut)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in got[4])
    assert kept[5].agg(F.sum("length")).first()[0] == total and kept[5].agg(F.max("sequence_id")).first()[0] == (total - 1) // 1024


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = write(stage(spark, docs, DIR), tmp_path, f"empty{k}")
        assert docs.count() == 0, name
