"""Spelling variants: near words of a corpus by a dictionary of trie-node pairs, and the form each word stands for."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stage

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # A to Z lower-cased before, and U+00C0 to U+00FF in UTF-8
LEAST_LENGTH, LEAST_COUNT = 5, 3


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", spoil: int = 0) -> DataFrame:
    """(word, n): letter runs of whole texts, of 5 or more code points, with 3 or more occurrences over all documents.

    Only A to Z is lower-cased. With ``spoil``, a run loses its code point h % length where h, the crc32 of
    ``<doc_id>:<run>`` (a null id is written as nothing), is a multiple of ``spoil``. Null and empty texts have no words,
    repeated rows count again. Each batch of texts counts its runs before anything is shuffled.
    """

    def start():
        def work(ids: list, texts: list) -> dict:
            total: Counter = Counter()
            for i, body in zip(ids, texts, strict=True):
                if not body:
                    continue
                runs = Counter(_RUN.findall(body.encode("utf-8", "surrogatepass").lower()))
                seed = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                for run, n in runs.items():
                    if spoil:
                        h = zlib.crc32(run, seed)
                        if h % spoil == 0:
                            letters = run.decode()
                            at = h % len(letters)
                            run = (letters[:at] + letters[at + 1 :]).encode()
                    if len(run) >= LEAST_LENGTH:
                        total[run] += n
            found = {w: n for run, n in total.items() if len(w := run.decode()) >= LEAST_LENGTH}
            return {"word": list(found), "n": list(found.values())}

        return work

    counted = map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id", "text"], "word string, n long", start, rows=5000)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a and b agree up to low and differ before high
    while high - low > 1:
        half = (low + high) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half)
    return low


_NODES = pa.schema([("key", pa.string()), ("part", pa.int64()), ("nodes", pa.list_(pa.int64()))])


def _local_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the trie nodes on each sorted word's way, within a partition: a node is new where a word leaves the one
    before it. The first word's nodes are numbered by their depth."""
    part, last, path, made = TaskContext.get().partitionId(), "", [], 0
    for batch in batches:
        words, out = batch.column(0).to_pylist(), []
        for word in words:
            same = _common(last, word)
            new = len(word) - same
            path = path[:same] + list(range(made + 1, made + new + 1))
            made += new
            last = word
            out.append(path)
        yield pa.record_batch([pa.array(words, pa.string()), pa.array([part] * len(words), pa.int64()), pa.array(out, pa.list_(pa.int64()))], schema=_NODES)


def _borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each partition in order, the numbers of those nodes of its first word that the words before it made."""
    last, path = "", []
    for batch in batches:
        parts, shared = [], []
        for row in batch.to_pylist():
            part, first = row["part"], row["first"]
            same = path[: _common(last, first)]
            number = lambda x, same=same, part=part: same[x - 1] if x <= len(same) else (part << 40) + x
            last, path = row["last"], [number(x) for x in row["way"]]
            parts.append(part)
            shared.append(same)
        yield pa.record_batch([pa.array(parts, pa.int64()), pa.array(shared, pa.list_(pa.int64()))], names=["part", "shared"])


def number_nodes(words: DataFrame, key: str) -> DataFrame:
    """(key, nodes): for every distinct string of ``key``, the integers of its trie's nodes at depths 1, 2, ...

    Two strings have the same integer at a depth if and only if they agree up to there, and a longer or later string's
    own node has the greater integer (code-point order). Words are sorted by ranges and numbered within each; what
    reaches over a border is settled by one row a partition (first and last word), streamed in order.
    """
    ranges = words.select(F.col(key).alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    local = stage(ranges.mapInArrow(_local_nodes, "key string, part long, nodes array<long>"), "nodes")
    ends = local.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("nodes", "key").alias("way"))
    borders = ends.repartitionByRange(1, "part").sortWithinPartitions("part").select("part", "first", "last", "way").mapInArrow(_borders, "part long, shared array<long>")
    number = lambda x: F.when(x <= F.size("shared"), F.get("shared", (x - 1).cast("int"))).otherwise(F.shiftleft("part", 40) + x)
    return local.join(borders, "part").select("key", F.transform("nodes", number).alias("nodes"))


def _near(words: DataFrame) -> DataFrame:
    """(id, near, best): how many near words each id has, and the most frequent, as (-n, id). Ids without one are left out.

    A word with its code point i skipped lies at the pair of its prefix node before i and its suffix node after i. Words
    that skip to one pair differ by a replacement there; a word that is whole at the pair lacks what the others skip. A pair
    holds at most one word for each letter and one whole word, so no pair is large. A word that skips to the same word
    within a run of one letter counts at the run's first place only.
    """
    size = F.size("prefixes")
    node = lambda nodes, depth: F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.get(nodes, (depth - 1).cast("int")))
    place = lambda p, s, kind: F.struct(p.alias("p"), s.alias("s"), kind.alias("kind"))
    new = lambda i: (i == 0) | (F.substring("word", i + 1, F.lit(1)) != F.substring("word", i, F.lit(1)))
    skipped = F.transform(F.sequence(F.lit(0), size - 1), lambda i: place(node("prefixes", i), node("suffixes", size - 1 - i), F.when(new(i), 1).otherwise(0)))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: place(node("prefixes", i), node("suffixes", size - i), F.lit(2)))
    at = words.select("id", (-F.col("n")).alias("less"), F.explode(F.concat(skipped, whole)).alias("x")).select("x.p", "x.s", F.struct("less", "id", F.col("x.kind").alias("kind")).alias("m"))
    pairs = at.groupBy("p", "s").agg(F.collect_list("m").alias("m")).where("size(m) > 1")
    skips = F.array_sort(F.filter("m", lambda x: x["kind"] < 2))
    full = F.filter("m", lambda x: x["kind"] == 2)
    pairs = pairs.select(skips.alias("skips"), F.size(F.filter("m", lambda x: x["kind"] == 1)).alias("heads"), F.get(full, F.lit(0)).alias("whole"))
    as_best = lambda x: F.when(x.isNotNull(), F.struct(x["less"].alias("less"), x["id"].alias("id")))
    first, second, no_whole = F.get("skips", F.lit(0)), F.get("skips", F.lit(1)), F.col("whole").isNull()
    found = lambda i, near, best: F.struct(i.alias("id"), near.cast("long").alias("near"), best.alias("best"))
    mine = lambda x: found(x["id"], F.size("skips") - 1 + F.when(no_whole, 0).otherwise(x["kind"]), F.least(as_best(F.when(x["id"] == first["id"], second).otherwise(first)), as_best(F.col("whole"))))
    lines = F.concat(F.transform("skips", mine), F.when(no_whole, F.array()).otherwise(F.array(found(F.col("whole.id"), F.col("heads"), as_best(first)))))
    rows = pairs.where("size(skips) > 0").select(F.explode(lines).alias("x")).select("x.*").where("best is not null")
    return rows.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every (word, n): distinct words, none null or empty, n positive.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its most frequent near
    word (ties: the first in code-point order) if that is at least twice as frequent; root is where forms lead. A form
    is twice as frequent, so chains are short; they are followed by pointer doubling until nothing moves.

    An empty table gives none. Memory is bounded by a word's length and by the alphabet, never by the number of words.
    """
    words = stage(words.select("word", "n"), "words")
    forward = number_nodes(words, "word").select(F.col("key").alias("word"), F.col("nodes").alias("prefixes"))
    backward = number_nodes(words.select(F.reverse("word").alias("back")), "back").select(F.reverse("key").alias("word"), F.col("nodes").alias("suffixes"))
    numbered = words.join(forward, "word").withColumn("id", F.element_at("prefixes", -1)).join(backward, "word")
    numbered = stage(numbered, "numbered")
    near = _near(numbered)
    counts = numbered.select("id", "word", "n").join(near, "id", "left")
    fits = -F.col("best.less") >= 2 * F.col("n")
    counts = stage(counts.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.id")).alias("form_id"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    ways = counts.where("form_id is not null").select("id", F.col("form_id").alias("to"))
    while True:
        on = ways.select(F.col("id").alias("to"), F.col("to").alias("next"))
        ways = stage(ways.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "ways")
        if ways.where("moved").isEmpty():
            break
        ways = ways.drop("moved")
    names = counts.select(F.col("id").alias("to"), F.col("word").alias("root"))
    forms = counts.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    rooted = counts.join(ways.drop("moved").join(names, "to").select("id", "root"), "id", "left").join(forms, "form_id", "left")
    return rooted.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
