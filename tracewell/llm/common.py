"""What the corpus operators share: reading, stage tables in the shared folder, Arrow maps, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import shared_folder

_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
    "array<double>": pa.list_(pa.float64()),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % modulus


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tracewell-{uuid.uuid4().hex}/{label}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    A lost executor loses nothing of it; later steps start from the files.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def map_rows(df: DataFrame, columns: list[str], ddl: str, start: Callable[[], Callable[..., dict]], rows: int = 1000) -> DataFrame:
    """One narrow Arrow pass. ``start()`` runs once a task and returns a function from the
    columns' lists (at most ``rows`` long) to a dict of output lists."""
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                made = pa.RecordBatch.from_pydict(out, schema=schema)
                if made.num_rows:
                    yield made

    return df.select(*columns).mapInArrow(run, ddl)


_kept: dict[Hashable, object] = {}


def kept(name: Hashable, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks under ``name``. Workers serve one stage after
    another, so what they kept for another name is freed first, down to the system."""
    if name not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _kept[name] = make()
    return _kept[name]


class Memory:
    """Values of strings, bounded: when the younger half is full it becomes the older one, from
    which what is wanted again moves on, so that frequent strings stay."""

    def __init__(self, most: int):
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.most = most

    def lacks(self, wanted: set[str]) -> list[str]:
        """What of ``wanted`` is unknown; all the rest is in the younger half now."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        missing, old = wanted.difference(self.young), self.old
        again = [w for w in missing if w in old]
        self.young.update(zip(again, map(old.pop, again), strict=True))
        return list(missing.difference(again))


class Rows:
    """Rows of numbers by string, bounded like a Memory."""

    def __init__(self, shape: tuple[int, ...], dtype, most: int):
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.table, self.old_table, self.most = np.empty((1024, *shape), dtype), np.empty((0, *shape), dtype), most

    def add(self, wanted: set[str], make: Callable[[list[str]], np.ndarray]) -> None:
        """Every string of ``wanted`` has its row in ``table`` now, at ``young``'s place."""
        if len(self.young) > self.most:
            self.old, self.old_table, self.young = self.young, self.table, {}
            self.table = np.empty((1024, *self.table.shape[1:]), self.table.dtype)
        missing = wanted.difference(self.young)
        if not missing:
            return
        again = [w for w in missing if w in self.old]
        new = list(missing.difference(again))
        n = len(self.young)
        if n + len(missing) > len(self.table):
            more = np.empty((max(2 * len(self.table), n + len(missing)), *self.table.shape[1:]), self.table.dtype)
            more[:n] = self.table[:n]
            self.table = more
        if again:
            self.table[n : n + len(again)] = self.old_table[[self.old[w] for w in again]]
        if new:
            self.table[n + len(again) : n + len(missing)] = make(new)
        self.young.update(zip([*again, *new], range(n, n + len(missing)), strict=True))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows to an Arrow batch, so that a batch of very long texts stays in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def components(vertices: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) with the smallest id that links reach, for every id of ``vertices``.

    Alternating large-star and small-star steps over the links (a, b); each round is one
    shuffle over the links left, with partial aggregation, and its result is written, so
    that a vertex with very many links is never gathered and a lost executor costs one
    round. The number of rounds grows with the logarithm of the links.
    """
    links = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(rounds):
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", F.col("m").alias("b"))).distinct()
        new = stage(small, "links")
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (links, new)]
        links = new
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return vertices.join(links.select(F.col("a").alias("id"), F.col("b").alias("least")), "id", "left").select("id", F.coalesce("least", "id").alias("component"))
