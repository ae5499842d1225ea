"""Vector bin packing of groups of equal texts into shards, jointly by bytes, tokens and rows.

A group goes whole to the shard where the dot product of its need with the residual capacity
is highest. Groups of more than half a shard in some dimension (at most a few for each
shard) are cut into salted parts of measured size and placed first, together with all groups
above a QUARTERS-th of a partition's share of a shard, whose number is bounded by that of the
partitions; then every partition of the remaining groups packs its own, largest first, into its
share of what is left, each beginning at another shard, so that no task and no driver sees all
groups. Numbers within a shard are prefix sums over partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, stage


#: Groups above a partition's share of a shard, divided by this, are placed before all others.
QUARTERS = 4
#: Swaps by which a placement is evened out at most, the pairs of shards that are tried for each, the least groups of
#: a shard that are looked at, and groups for each shard from which small ones fill up what large ones leave.
ROUNDS, PAIRS, SWAPPED, MANY = 400, 60, 128, 100


def place(needs: np.ndarray, residual: np.ndarray, slack: float = 0) -> np.ndarray:
    """The shard of each need, largest first; ``residual`` (shards x dimensions) is used up.
    Of shards that differ by less than ``slack`` x the need itself the first is taken."""
    scale = np.maximum(residual.sum(axis=0), 1e-9)
    shares, left = needs / scale, residual / scale
    chosen = np.zeros(len(needs), np.int32)
    for i in np.argsort(-shares.max(axis=1), kind="stable"):
        fit = left @ shares[i]
        chosen[i] = s = int(np.argmax(fit >= fit.max() - slack * (shares[i] @ shares[i])))
        left[s] -= shares[i]
    residual[:] = left * scale
    return chosen


def even_out(needs: np.ndarray, chosen: np.ndarray, residual: np.ndarray) -> None:
    """Moves a group, or swaps two, between two shards that differ much, as long as such two come
    closer in all dimensions together. Works on ``chosen`` and ``residual``."""
    scale = np.maximum(needs.sum(axis=0), 1e-9)
    shares, left = needs / scale, residual / scale
    for _ in range(ROUNDS if len(needs) else 0):
        apart = ((left[:, None] - left[None]) ** 2).sum(axis=2)
        for pair in np.argsort(-apart, axis=None, kind="stable")[:PAIRS].tolist():
            full, empty = divmod(pair, len(left))
            gap = left[empty] - left[full]
            give, take = (np.flatnonzero(chosen == s) for s in (full, empty))
            give, take = (x[np.argsort(shares[x].max(axis=1), kind="stable")[:SWAPPED]] for x in (give, take))
            if not len(give):
                continue
            back = np.concatenate([np.zeros((1, shares.shape[1])), shares[take]])
            moved = shares[give][:, None] - back[None]
            after = ((gap - 2 * moved) ** 2).sum(axis=2)
            i, j = np.unravel_index(int(after.argmin()), after.shape)
            if after[i, j] < apart[full, empty] * (1 - 1e-6):
                break
        else:
            break
        left[full] += moved[i, j]
        left[empty] -= moved[i, j]
        chosen[give[i]] = empty
        if j:
            chosen[take[j - 1]] = full
    residual[:] = left * scale


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, tokens, text_crc32, shard, slot) of every row.

    size: UTF-8 bytes of the text plus 8; tokens: runs of characters other than white space.
    Null texts count as empty and join that group. Rows that repeat are placed each, like
    other members of their group. A group above half a shard is split by its rows' numbers, so
    that rows of one id, or of none, part too; all others stay whole. Slots number a shard's rows from 0 without gaps. Empty tables have no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row")),
        "rows",
    )
    spark = docs.sparkSession
    groups = rows.groupBy("h", "size", "text_crc32").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("all_tokens"))
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    capacity = np.array([[float(x or 0) for x in total]] * shards) / shards
    half = [max(x / 2, 1e-9) for x in capacity[0]]
    worst = F.greatest(F.col("bytes") / half[0], F.col("all_tokens") / half[1], F.col("rows") / half[2])
    key = "h long, size long, text_crc32 long"
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # at most 3 x QUARTERS for each shard and partition: each takes that part of a shard in some dimension
    above = sorted(groups.withColumn("worst", worst).where(F.col("worst") * QUARTERS * partitions > 2).select("h", "size", "text_crc32", "bytes", "all_tokens", "rows", "worst").collect())
    large = [r for r in above if r.worst > 1 and r.rows > 1]  # at most 2 for each shard and dimension
    whole = [r for r in above if not (r.worst > 1 and r.rows > 1)]
    known = spark.createDataFrame([(r.h, r["size"], r.text_crc32, math.ceil(r.worst * 8) if r.worst > 1 and r.rows > 1 else None) for r in above], f"{key}, salts int")
    # as many rows as groups above the limit
    salted = rows.join(F.broadcast(known.where("salts is not null")), ["h", "size", "text_crc32"], "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.expr("pmod(xxhash64(row, 'salt'), salts)")))
    parts = salted.where("salt is not null").groupBy("h", "size", "text_crc32", "salt").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("all_tokens"), F.count("*").alias("rows")).orderBy("h", "size", "salt").collect() if large else []
    needs = np.array([[p.bytes, p.all_tokens, p.rows] for p in [*parts, *whole]], float).reshape(-1, 3)
    first = place(needs, capacity)
    even_out(needs, first, capacity)
    first = first.tolist()
    placed = spark.createDataFrame([(p.h, p["size"], p.text_crc32, p.salt, s) for p, s in zip(parts, first, strict=False)], f"{key}, salt long, shard int")
    fixed = spark.createDataFrame([(r.h, r["size"], r.text_crc32, s) for r, s in zip(whole, first[len(parts) :], strict=True)], f"{key}, shard int")
    room = np.maximum(capacity, 0)

    def pack(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            table = table.sort_by([("h", "ascending"), ("size", "ascending"), ("text_crc32", "ascending")])  # the same again if the task is run again
            needs = np.stack([table[c].to_numpy() for c in ("bytes", "all_tokens", "rows")], axis=1).astype(float)
            share = needs.sum(axis=0) / np.maximum(room.sum(axis=0), 1e-9)
            turn = TaskContext.get().partitionId() % shards
            own = np.roll(room * share, -turn, axis=0)
            chosen = place(needs, own, 0.5)
            if len(needs) < MANY * shards:
                even_out(needs, chosen, own)
            chosen = (chosen + turn).astype(np.int32) % shards
            yield pa.RecordBatch.from_pydict({c: table[c].combine_chunks() for c in ("h", "size", "text_crc32")} | {"shard": chosen}, schema=arrow_schema(f"{key}, shard int"))

    small = groups.join(F.broadcast(known), ["h", "size", "text_crc32"], "left_anti") if above else groups
    chosen = small.mapInArrow(pack, f"{key}, shard int").union(fixed)
    columns = ["id", "size", "tokens", "text_crc32", "shard"]
    assigned = (salted.where("salt is null") if large else rows).join(chosen, ["h", "size", "text_crc32"]).select(*columns)
    if large:
        assigned = assigned.union(salted.where("salt is not null").join(F.broadcast(placed), ["h", "size", "text_crc32", "salt"]).select(*columns))
    ddl = "id long, size long, tokens long, text_crc32 long, shard int, part int, before long"

    def number(batches):
        counts, part = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            s = batch.column(4).to_numpy()
            before = np.zeros(len(s), np.int64)
            for k in np.unique(s):
                at = np.flatnonzero(s == k)
                before[at] = counts[k] + np.arange(len(at))
                counts[k] += len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(s), part, np.int32)), pa.array(before)], schema=arrow_schema(ddl))

    numbered = stage(assigned.mapInArrow(number, ddl), "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = numbered.groupBy("part", "shard").count().select("part", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return numbered.join(bases, ["part", "shard"]).select(F.col("id").alias(id_col), "size", "tokens", "text_crc32", "shard", (F.col("base") + F.col("before")).alias("slot"))
