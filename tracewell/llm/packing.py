"""Concatenate and cut: all token ids stand in one long row, which is cut every ``size`` ids.

Two passes. The first tokenizes, writes each document's ids with the number of ids before it
in its partition, and needs no shuffle. Prefix sums over the partitions' totals (one number a
partition) give global offsets; the second pass cuts at multiples of ``size`` and writes a
record for each piece, so that a document across a border has one on either side.
"""

from __future__ import annotations

import os
import string
from itertools import accumulate

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import kept, map_rows, small_batches, stage

#: Strings whose ids a Python worker keeps, and their greatest length.
KEPT, KEPT_CHARS = 700_000, 48


class Tokens:
    """ids of the tokenizers library, kept by word: a byte-level pre-tokenizer never joins what
    stands on either side of one space between other characters."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.double, self.gaps = regex.compile(r"\s\s"), regex.compile(r"(?<=\S)(?= \S)")
        self.kept: dict[str, bytes] = {}
        self.letters = {b: c for c, b in byte_letters().items()}

    def words(self, text: str) -> list[str]:
        if self.special.search(text):
            return [text]
        if self.double.search(text):
            return self.gaps.split(text)
        head, *rest = text.split(" ")
        return [head, *[" " + w for w in rest]] if head else [" " + w for w in rest]

    def word(self, word: str) -> bytes | None:
        """The ids of letters, a space before and punctuation after them allowed; None for other
        strings. Letters are one piece of the pre-tokenizer, punctuation the next, so each goes
        to the library's model by itself, without the rest of its pipeline."""
        stem = word.rstrip(string.punctuation)
        if not stem.removeprefix(" ").isalpha():
            return None
        kept, out = self.kept, b""
        for part in (stem, word[len(stem) :]):
            if part and part not in kept:
                made = self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
                kept[part] = np.array([t.id for t in made], "<u4").tobytes()
            out += kept[part] if part else b""
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.kept) > KEPT:
            self.kept.clear()
        known = self.kept
        extra, new = {}, []
        for w in {w for words in cut for w in words if w not in known}:
            ids = self.word(w) if len(w) <= KEPT_CHARS else None
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            (known if len(w) <= KEPT_CHARS else extra)[w] = np.array(e.ids, "<u4").tobytes()
        if extra:
            return [b"".join([known[w] if w in known else extra[w] for w in words]) for words in cut]
        return [b"".join([known[w] for w in words]) for words in cut]


def tokens(path: str) -> Tokens:
    return kept(("tokens", path), lambda: Tokens(path))


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """First pass: (id, part, before, n, ids) with ``before`` the ids that precede in its partition."""
    small_batches(docs.sparkSession)

    def start():
        library, part, total = tokens(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()

        def work(keys, texts):
            nonlocal total
            ids = [x + end for x in library.encode(texts)]
            n = [len(x) // 4 for x in ids]
            before = list(accumulate(n, initial=total))
            total = before.pop()
            return {id_col: keys, "part": [part] * len(n), "before": before, "n": n, "ids": [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]}

        return work

    return map_rows(docs, [id_col, text_col], f"{id_col} long, part int, before long, n long, ids binary", start, rows=200)


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids binary of little-endian uint32, doc_tokens, sequence_id, offset).

    Every id of every row lies in one piece; ``sequence_id`` counts the windows of ``size`` ids
    from 0 and only the last can be short. Null and empty texts have their end id alone. Rows
    that repeat are packed each, a null id stays null, other columns are not read, and an
    empty table has no pieces. Vocabularies of up to 65,536 ids fit the stored form.
    """
    stored = stage(tokenized(docs, path, end_id, id_col, text_col), "tokens")
    totals = sorted((r.part, r.total) for r in stored.groupBy("part").agg(F.sum("n").alias("total")).collect())  # a row for each partition of the input
    bases = list(zip([p for p, _ in totals], accumulate([t for _, t in totals], initial=0), strict=False))
    offsets = docs.sparkSession.createDataFrame(bases, "part int, base long")
    placed = stored.join(F.broadcast(offsets), "part").select(id_col, (F.col("base") + F.col("before")).alias("at"), "ids")

    def start():
        def work(keys, at, ids):
            out = {k: [] for k in (id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for key, first, raw in zip(keys, at, ids, strict=True):
                full = np.frombuffer(raw, "<u2").astype("<u4")
                done = 0
                while done < len(full):
                    sequence, offset = divmod(first + done, size)
                    n = min(size - offset, len(full) - done)
                    for k, v in zip(out, (key, done, n, full[done : done + n].tobytes(), len(full), sequence, offset), strict=True):
                        out[k].append(v)
                    done += n
            return out

        return work

    return map_rows(placed, [id_col, "at", "ids"], f"{id_col} long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long", start, rows=200)
