"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest pivots in order. Inverted lists hold, for each pivot, the
vectors that name it; two vectors of one list are candidates if they share enough pivots,
and are met in the list of the first pivot that they share, once. Candidates are verified by
cosine in double precision. Equal vectors are one class with a count. A list that is long is
split by the second pivot that two vectors share, so that lists stay short as the table grows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_rows, stage

#: Vectors that pivots are drawn from, least and greatest number of pivots, nearest pivots kept, pivots that candidates share.
SAMPLE, LEAST, MOST, NEAREST, SHARED = 8192, 128, 2048, 10, 3
#: Pivots are no closer to each other than this cosine, so that a crowd of copies gives one.
APART = 0.7
#: Rows of a list that one task compares with as many; longer lists are cut into blocks.
BLOCK = 2048
#: Rows of a list from which it is split by the second shared pivot.
LONG = 16 * BLOCK


def usable(vector: str, label: str, key: str):
    """Is a row compared at all?"""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def unit(raw: list, width: int) -> np.ndarray:
    """Vectors of length 1 in double precision, ended with zeros where they are shorter."""
    out = np.zeros((len(raw), width))
    for i, x in enumerate(raw):
        out[i, : len(x)] = x
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def choose_pivots(sampled: np.ndarray, wanted: int) -> np.ndarray:
    """Vectors of the sample in order, each far from those before it."""
    chosen = np.zeros((0, sampled.shape[1]))
    for x in sampled:
        if len(chosen) >= wanted:
            break
        if not len(chosen) or (chosen @ x).max() < APART:
            chosen = np.vstack([chosen, x])
    return chosen


def compare(threshold: float, pivots: int, nearest: int, shared: int):
    """Compares the rows of a list's block with those of another, or among themselves."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, second, left, right = map(int, key[2:])
        ids, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        units = np.stack([np.frombuffer(x) for x in rows["unit"]])
        named = np.zeros((len(ids), pivots), np.float32)
        np.put_along_axis(named, np.stack([np.frombuffer(x, np.int16) for x in rows["nearest"]]).astype(np.int64), 1, axis=1)
        block = rows["block"].to_numpy()
        one, other = (np.arange(len(ids)),) * 2 if left == right else (np.flatnonzero(block == left), np.flatnonzero(block == right))
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for at in range(0, len(one), 512):
            part = one[at : at + 512]
            candidate = named[part] @ named[other].T >= shared
            if pivot:
                candidate &= named[part, :pivot] @ named[other, :pivot].T == 0
            if second > pivot + 1:
                candidate &= named[part, pivot + 1 : second] @ named[other, pivot + 1 : second].T == 0
            if left == right:
                candidate &= other[None] > part[:, None]
            a, b = np.nonzero(candidate)
            for lo in range(0, len(a), 65536):
                i, j = part[a[lo : lo + 65536]], other[b[lo : lo + 65536]]
                near = np.einsum("nd,nd->n", units[i], units[j]) >= threshold
                i, j = i[near], j[near]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = root(x), root(y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": ids[some], "n": links[some], "hub": ids[[root(i) for i in some]] if len(some) else ids[some]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows are compared if their labels are equal and their vectors equally long. Rows with a
    null id or label, and vectors that are null, empty, zero or hold null or non-finite numbers, link
    with nothing and are their own component. Repeated rows are vectors of their own that link
    with each other. Of a component the smallest id is kept (each row that bears it).

    Pivots come from at most SAMPLE distinct vectors; their number is twice the square root of
    the distinct vectors' number, between LEAST and MOST. All vectors are indexed. With fewer
    pivots than NEAREST the lists hold all of them, and all pairs of a label are candidates.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).withColumn("ok", usable("vector", "label", "id"))
    keys = ["label", "h1", "h2"]
    hashed = rows.withColumn("h1", F.when(F.col("ok"), F.xxhash64("vector"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(7), F.size("vector"), "vector")))
    grouped = hashed.where("ok").groupBy(*keys).agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # written, so that a class keeps its number; an id may have several vectors, so it names no class
    classes = stage(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    total = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = total[1] or 1
    sampled = [r.vector for r in classes.orderBy(F.xxhash64("h1", "label"), "h2").select("vector").limit(SAMPLE).collect()]
    pivots = choose_pivots(unit(sampled, width), min(MOST, max(LEAST, 2 * math.isqrt(total[0])))) if sampled else np.ones((1, 1))
    nearest = min(NEAREST, len(pivots))
    shared = min(SHARED, nearest) if len(pivots) > NEAREST else 1
    index = spark.sparkContext.broadcast(pivots)

    def start():
        places = index.value

        def work(reps, labels, copies, raw):
            out = {k: [] for k in ("rep", "label", "length", "copies", "unit", "pivot", "later", "nearest")}
            units = unit(raw, width)
            named = np.argsort(-(units @ places.T), axis=1, kind="stable")[:, :nearest].astype(np.int16)
            for i, rep in enumerate(reps):
                body, names = units[i].tobytes(), named[i].tobytes()
                pivots_of = sorted(named[i].tolist())
                for at, p in enumerate(pivots_of, 1):
                    for k, v in zip(out, (rep, labels[i], len(raw[i]), copies[i], body, p, pivots_of[at:], names), strict=True):
                        out[k].append(v)
            return out

        return work

    lists = ["label", "length", "pivot"]
    named = classes.select("rep", F.col("label").cast("string").alias("label"), "copies", F.col("vector").cast("array<double>").alias("vector"))
    posted = stage(map_rows(named, named.columns, "rep long, label string, length int, copies long, unit binary, pivot int, later array<int>, nearest binary", start, rows=500), "lists")
    counted = posted.groupBy(*lists).agg(F.count("*").alias("rows"))
    long = stage(counted.where(F.col("rows") > (LONG if shared > 1 else 1 << 62)).select(*lists, F.lit(True).alias("split")), "long")
    marked = posted.join(long, lists, "left").withColumn("second", F.explode(F.when(F.col("split"), F.col("later")).otherwise(F.array(F.lit(-1))))).drop("later", "split")
    lists = [*lists, "second"]
    sizes = marked.groupBy(*lists).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = marked.join(sizes, lists).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("left", F.least("block", "with")).withColumn("right", F.greatest("block", "with"))
    found = stage(paired.groupBy(*lists, "left", "right").applyInPandas(compare(threshold, len(pivots), nearest, shared), "rep long, n long, hub long"), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(classes.select(F.col("rep").alias("id")).distinct(), found.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    members = stage(classes.select(*keys, "rep", "least", "copies").join(parts.select(F.col("id").alias("rep"), F.col("component").alias("group")), "rep"), "members")
    per_class = members.join(counts, "rep", "left").join(members.groupBy("group").agg(F.min("least").alias("component")), "group")
    joined = hashed.join(per_class.drop("ok"), keys, "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce(F.coalesce("n", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )

