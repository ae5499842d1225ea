"""Near-duplicate texts by an LSH forest over MinHash signatures.

A signature's hashes are read in several orders (trees). In each order all signatures are
sorted together; documents whose prefixes agree longest stand side by side. Neighbours that
share a prefix are candidates; in a region with many members the prefix is followed deeper,
along the branch that holds most, to the member that stands for the region at each depth.
Candidates with similar signatures are confirmed on their full shingle sets.

Rows that share a tree's first hashes (``meeting`` of them) are all compared: in pairs where
they are few, and else, where not yet linked, block by block on their full shingle sets.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, components, kept, map_rows, small_batches, stage

#: Words in a shingle; trees, hashes in a tree's order, and the shortest shared prefix of candidates.
WORDS, TREES, DEPTH, LEAST = 5, 20, 7, 2
#: Candidates whose signatures agree in a smaller share of their hashes than the threshold less this are not confirmed.
#: With 140 hashes that is over four standard errors.
SLACK = 0.14
#: A pair at the threshold meets in no tree with this probability at most.
MISSED = 0.001
#: Rows of a region whose pairs are listed, and rows (of BLOCK_SHINGLES / BLOCK shingles) of a block where they are more.
FEW, BLOCK, BLOCK_SHINGLES = 8, 512, 512 * 1024
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
HASHES = TREES * DEPTH
_rng = np.random.default_rng(20_011)
MULTIPLY = (_rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


class Words:
    """64-bit hashes of words that a Python worker keeps."""

    def __init__(self):
        self.kept: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of all shingles; a text with fewer words is one shingle."""
        found = SPLIT.findall((text or "").encode().lower())
        if not found:
            return np.zeros(0, np.uint64)
        known = self.kept
        if len(known) > 700_000:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        n = min(WORDS, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = (out ^ h[k : len(out) + k]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(32)
        return np.unique(out)


def words() -> Words:
    return kept("shingles", Words)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(20)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 512):
            v = MULTIPLY[:, None] * x[None, at : at + 512] + ADD[:, None]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            np.minimum(out, v.min(axis=1), out=out)
    return out


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, key of the set, signature)."""

    def start():
        known = words()

        def work(keys, texts):
            out = {"id": keys, "n_shingles": [], "key": [], "signature": []}
            for text in texts:
                s = known.shingles(text)
                out["n_shingles"].append(len(s))
                out["key"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out["signature"].append(signature(s).astype(">u4").tobytes() if len(s) else None)
            return out

        return work

    return map_rows(docs, [id_col, text_col], "id long, n_shingles long, key binary, signature binary", start, rows=200)


def shared(keys: np.ndarray) -> np.ndarray:
    """How many leading hashes each row of sorted keys shares with the next; -1 across trees."""
    same = keys[1:] == keys[:-1]
    out = np.where(same.all(axis=1), keys.shape[1], np.argmin(same, axis=1)) - 1
    return out


def stands_for(gap: np.ndarray, lo: int, hi: int, depth: int) -> dict[int, set[int]]:
    """For rows lo..hi-1, which share ``depth`` leading hashes: the members that stand for the
    regions that each row lies in. A region's is that of its largest branch."""
    out: dict[int, set[int]] = {}

    def walk(lo: int, hi: int, depth: int) -> int:
        if hi - lo <= 2 or depth >= DEPTH:
            return lo
        cuts = [lo, *(lo + 1 + np.flatnonzero(gap[lo : hi - 1] <= depth)).tolist(), hi]
        spans = list(zip(cuts, cuts[1:], strict=False))
        heads = [walk(a, b, depth + 1) if b - a > 1 else a for a, b in spans]
        head = heads[max(range(len(spans)), key=lambda i: spans[i][1] - spans[i][0])]
        if len(spans) > 1:
            for row in range(lo, hi):
                out.setdefault(row, set()).add(head)
        return head

    head = walk(lo, hi, depth)
    for row in range(lo, hi):
        out.setdefault(row, set()).add(head)
    return out


def meeting(percent: int) -> int:
    """The most leading hashes at which a pair at the threshold still meets in one of the trees."""
    return max([d for d in range(LEAST, DEPTH + 1) if (1 - (percent / 100) ** d) ** TREES <= MISSED], default=LEAST)


def neighbours(forest: DataFrame, meet: int) -> DataFrame:
    """Candidate pairs (a, b) of the forest's rows (order binary, id), which come sorted, and
    (a, region) of the rows of regions of ``meet`` hashes that are large or lie at a partition's border."""
    ddl = "a long, b long, part int, edge binary, region binary"

    def run(batches):
        part = TaskContext.get().partitionId()
        batches = list(batches)
        n = sum(b.num_rows for b in batches)
        if not n:
            return
        table = pa.Table.from_batches(batches)
        raw = b"".join(table["order"].to_pylist())
        keys = np.frombuffer(raw, ">u4").reshape(n, DEPTH + 1)
        ids = table["id"].to_numpy()
        gap = shared(keys)
        pairs = set()
        for i in np.flatnonzero(gap >= LEAST).tolist():
            pairs.add((int(ids[i]), int(ids[i + 1])))
        bounds = np.concatenate([[0], np.flatnonzero(gap < LEAST) + 1, [n]])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo > 2:
                for row, heads in stands_for(gap, lo, hi, LEAST).items():
                    pairs.update((int(ids[row]), int(ids[h])) for h in heads if h != row)
        members = []
        bounds = np.concatenate([[0], np.flatnonzero(gap < meet) + 1, [n]])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo > FEW or lo == 0 or hi == n:
                region = keys[lo, : meet + 1].tobytes()
                members += [(int(i), None, None, None, region) for i in ids[lo:hi]]
            elif hi - lo > 2:
                pairs.update(combinations(ids[lo:hi].tolist(), 2))
        pairs = {(min(p), max(p)) for p in pairs}
        # the first and last row of each partition, so that neighbours across borders are seen too
        ends = [(int(ids[i]), None, part, struct.pack(">B", i > 0) + keys[i].tobytes(), None) for i in (0, n - 1)]
        rows = [(a, b, None, None, None) for a, b in sorted(pairs)] + ends + members
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows[at : at + 50_000]] for i, k in enumerate(("a", "b", "part", "edge", "region"))}, schema=arrow_schema(ddl))

    return forest.mapInArrow(run, ddl)


def across(found: DataFrame) -> list[tuple[int, int]]:
    """Neighbours whose partitions differ: at most one pair for each partition."""
    ends: dict[int, dict[int, tuple[int, bytes]]] = {}
    for r in found.where("part is not null").select("a", "part", "edge").collect():  # two rows a partition
        ends.setdefault(r.part, {})[r.edge[0]] = (r.a, bytes(r.edge[1:]))
    parts = sorted(ends)
    out = []
    for p, q in zip(parts, parts[1:], strict=False):
        last, first = ends[p].get(1, ends[p].get(0)), ends[q].get(0, ends[q].get(1))
        keys = np.frombuffer(last[1] + first[1], ">u4").reshape(2, DEPTH + 1)
        if shared(keys)[0] >= LEAST and last[0] != first[0]:
            out.append((min(last[0], first[0]), max(last[0], first[0])))
    return out


def similar(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """The pairs with the share of their signatures' hashes that agree, if it is ``least`` or more."""
    one = pairs.join(signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a")
    both = one.join(signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")

    def start():
        def work(a, b, sa, sb):
            share = (np.frombuffer(b"".join(sa), "<u4") == np.frombuffer(b"".join(sb), "<u4")).reshape(-1, HASHES).mean(axis=1) if a else np.zeros(0)
            keep = np.flatnonzero(share >= least)
            return {"a": [a[i] for i in keep], "b": [b[i] for i in keep], "share": share[keep]}

        return work

    return map_rows(both, ["a", "b", "sa", "sb"], "a long, b long, share double", start)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets hold 100 x intersection >= percent x union."""
    one = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")

    def start():
        def work(a, b, sa, sb):
            out = {"a": [], "b": []}
            for i, j, x, y in zip(a, b, sa, sb, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out["a"].append(i)
                    out["b"].append(j)
            return out

        return work

    return map_rows(both, ["a", "b", "sa", "sb"], "a long, b long", start, rows=100)


def link_block(ids: list[int], near: list[int], sets: list[bytes], right: int, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) that connect rows whose ``near`` differs: rows before ``right`` with those from there on,
    or all rows with each other if ``right`` is 0. The full sets of every such pair are compared."""
    sizes = np.array([len(s) // 8 for s in sets])
    _, local = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    local, starts = local.astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(local.max()) + 1, np.uint8)
    parent = {c: c for c in near}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for x in range(right or len(ids) - 1):
        y = right or x + 1
        own = local[starts[x] : starts[x + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[local[starts[y] :]], starts[y:-1] - starts[y], dtype=np.int64)
        mark[own] = 0
        for k in np.flatnonzero(100 * both >= percent * (sizes[x] + sizes[y:] - both)).tolist():
            a, b = root(near[x]), root(near[y + k])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((min(ids[x], ids[y + k]), max(ids[x], ids[y + k])))
    return out


def link_regions(members: DataFrame, near: DataFrame, signatures: DataFrame, shingle_sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame | None:
    """Links (a, b) that join rows of one region (id, region) whose components differ; None if no region
    holds two components. All rows of a region are compared, but for those of its largest component with each
    other: each two blocks of its rows in a group of their own, which gives fewer links than it has rows."""
    sizes = signatures.select("id", F.col("n_shingles").alias("n"))
    rows = stage(members.join(near.select("id", "component"), "id", "left").join(sizes, "id").select("id", "region", "n", F.coalesce("component", "id").alias("near")), "members")
    parts = rows.groupBy("region", "near").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    regions = parts.groupBy("region").agg(F.count("*").alias("parts"), F.sum("rows").alias("all_rows"), F.sum("n").alias("all_n"), F.max(F.struct("rows", "n", "near")).alias("main"))
    blocks = lambda rows, n: F.ceil(F.greatest(rows / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    regions = regions.where("parts > 1").select("region", F.col("main.near").alias("main"), blocks(F.col("all_rows") - F.col("main.rows"), F.col("all_n") - F.col("main.n")).alias("others"), blocks(F.col("main.rows"), F.col("main.n")).alias("mains"))
    regions = stage(regions, "regions")
    if regions.isEmpty():
        return None
    placed = rows.join(regions, "region").withColumn("block", F.when(F.col("near") == F.col("main"), F.col("others") + F.expr("pmod(xxhash64(id), mains)")).otherwise(F.expr("pmod(xxhash64(id), others)")).cast("int"))
    met = F.explode(F.expr("sequence(0, others + if(near = main, 0, mains) - 1)"))
    tasks = placed.withColumn("other", met).select("id", "near", "block", "region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    tasks = stage(tasks, "tasks")
    sets = shingle_sets(tasks.select("id").distinct())

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "id"])
        one, right = rows["low"].iat[0] == rows["high"].iat[0], int((rows["block"] == rows["low"]).sum())
        if not one and right in (0, len(rows)):  # a block without rows
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        found = link_block(rows["id"].tolist(), rows["near"].tolist(), rows["shingles"].tolist(), 0 if one else right, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return tasks.join(sets, "id").groupBy("region", "low", "high").applyInPandas(compare, "a long, b long").distinct()


def near_texts(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Texts are linked if 100 x the size of the intersection of their shingle sets is at least
    ``percent`` x that of the union; a component's id is the smallest in it, and that row is
    kept. Null, empty and wordless texts have no shingle, link with nothing and are kept.
    Repeated rows are texts of their own, also if one id has several texts; rows with equal sets
    are kept or not alike if their ids are equal. A row with a null id links with nothing. Equal sets are one class, so copies are never paired.

    First each class is confirmed with its most similar candidate; then only candidates
    that lie in different components are, and what still differs in large regions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    described = stage(describe(docs, id_col, text_col), "signatures")
    usable = described.where("key is not null and id is not null")
    # written, so that a class keeps its number; an id may have several texts, so it names no class
    grouped = usable.groupBy("key").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    signatures = stage(grouped.withColumn("id", F.monotonically_increasing_id()), "distinct")

    def start():
        def work(ids, raw):
            out = {"order": [], "id": []}
            for i, s in zip(ids, raw, strict=True):
                for t in range(TREES):
                    out["order"].append(struct.pack(">I", t) + s[4 * DEPTH * t : 4 * DEPTH * (t + 1)])
                    out["id"].append(i)
            return out

        return work

    forest = map_rows(signatures, ["id", "signature"], "order binary, id long", start)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = stage(neighbours(forest.repartitionByRange(parts, "order", "id").sortWithinPartitions("order", "id"), meeting(percent)), "neighbours")
    pairs = found.where("b is not null").select("a", "b").union(spark.createDataFrame(across(found), "a long, b long")).distinct()
    candidates = stage(similar(pairs, signatures, percent / 100 - SLACK), "candidates")
    involved = candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct()

    def shingle():
        known = words()

        def work(ids, texts):
            sets = [known.shingles(t).tobytes() for t in texts]
            return {"rep": ids, "key": [xxhash.xxh3_128_digest(s) if s else None for s in sets], "shingles": sets}

        return work

    def shingle_sets(ids: DataFrame) -> DataFrame:
        wanted = stage(signatures.join(ids, "id").select("id", "rep", "key"), "wanted")
        texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(wanted.select("rep").distinct(), "rep", "left_semi")
        made = map_rows(texts, ["rep", "text"], "rep long, key binary, shingles binary", shingle, rows=200)
        return stage(made.join(wanted, ["rep", "key"]).groupBy("id").agg(F.first("shingles").alias("shingles")), "sets")

    sets = shingle_sets(involved)
    ends = candidates.select("a", "b", "share").union(candidates.select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
    best = ends.groupBy("a").agg(F.max_by("b", F.struct("share", -F.col("b"))).alias("b"))
    first = stage(confirm(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent), "links")
    vertices = involved
    near = stage(components(vertices, first), "near")
    rest = candidates.join(near.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(near.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").where("ca <> cb").select("a", "b")
    second = stage(confirm(rest, sets, percent), "links")
    joined = components(vertices, first.union(second))
    members = found.where("region is not null").select(F.col("a").alias("id"), "region")
    third = link_regions(members, joined, signatures, shingle_sets, percent)
    if third is not None:
        third = stage(third, "links")
        ends = third.select(F.col("a").alias("id")).union(third.select("b")).union(joined.select("id")).distinct()
        joined = components(ends, third.union(joined.select("id", "component")))
    grouped = stage(signatures.select("id", "key", "rep").join(joined, "id", "left").select("key", "rep", F.coalesce("component", "id").alias("group")), "placed")
    placed = grouped.join(grouped.groupBy("group").agg(F.min("rep").alias("component")), "group").select("key", "component")
    out = described.select("id", "n_shingles", "key").join(placed, "key", "left")
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
