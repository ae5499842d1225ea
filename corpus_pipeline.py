"""The corpus pipeline: language, toxicity, near copies, repeated strings, packing.

Every stage reads what its predecessor wrote, decides for all rows, and its decisions take
effect. Stages use the columns of ``documents`` only; further columns, whatever their names,
go. Rows with null ids or texts, empty texts and repeated rows go through as each stage states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import language, packing, shingles, suffixes, toxicity
from tracewell.llm.common import fold, read, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is accepted at this posterior.
SURE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known go on; texts that are null or without a letter are rejected.
    With no labelled row nothing can be known, and all go."""
    model = language.train(docs, fold("doc_id", 4) != 2, public_tokenizers.path("piece_bpe_32k.model"))
    scored = language.predict(docs.select(*COLUMNS), model, keep=COLUMNS[1:])
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are predicted toxic are rejected."""
    network = toxicity.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs.select(*COLUMNS), network, keep=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of repeated rows with
    one id and text one row; rows with a null id and texts without words stay all."""
    docs = docs.select(*COLUMNS)
    found = shingles.near_texts(docs, percent=85)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi")
    same = Window.partitionBy("doc_id").orderBy("doc_id", F.xxhash64("text"))
    first = stay.withColumn("before", F.lag(F.xxhash64("text")).over(same)).where("before is null or before <> xxhash64(text)")
    return first.select(*COLUMNS).union(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, without the bytes of strings that repeat; characters cut in two go whole."""
    found = suffixes.repeated(docs.select(*COLUMNS), carry=["lang", "source", "n_chars"])
    changed = F.size("low") > 0
    length = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", length.alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of gapless sequences of 1024 ids."""
    pieces = packing.pack(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", known_language), ("toxicity", not_toxic), ("near copies", one_of_near_copies), ("repeated strings", without_repeats), ("packing", packed)]
#: Learned models and sampled orders have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
