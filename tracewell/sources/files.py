"""Source files as snapshots: which are read, and their ids by content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import stable_id

# Suffixes that are read, and names of files or folders that are not.
SUFFIXES = (".py", ".md", ".txt")
EXCLUDED = (".git", "__pycache__", ".venv", ".pytest_cache", "dist", "build")


def snapshots(files: DataFrame, observed_at: str, suffixes: Sequence[str] = SUFFIXES, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """(snapshot_id, source_id, relative_path, uri, content_hash, size_bytes, observed_at, content_text) of files.

    files: relative_path, content (bytes). A file counts if its name ends in one of the suffixes after at least one other character, no part of its path is
    excluded, and its bytes are UTF-8; an empty file counts, a null one does not. Ids follow from the path and the bytes alone, so a
    second scan gives the same ones."""
    parts = F.split("relative_path", "/")
    name = F.element_at(parts, -1)
    suffix = F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = files.where(suffix.isin(*suffixes) & ~F.arrays_overlap(parts, F.array(*map(F.lit, excluded)))).withColumn("content_text", text).where("content_text is not null")
    uri = F.concat(F.lit("file://"), "relative_path")
    rows = rows.select("relative_path", uri.alias("uri"), F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"), F.lit(observed_at).alias("observed_at"), "content_text")
    rows = rows.withColumn("source_id", stable_id("src", F.struct(F.lit("local_file").alias("source_type"), "uri")))
    return rows.withColumn("snapshot_id", stable_id("snap", F.struct("content_hash", "source_id"))).select("snapshot_id", "source_id", "relative_path", "uri", "content_hash", "size_bytes", "observed_at", "content_text")


def scan_sources(spark: SparkSession, root: str, observed_at: str, suffixes: Sequence[str] = SUFFIXES, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """`snapshots` of all files below a folder of any store that Spark reads; only names with the suffixes are opened.
    Spark's reader of files passes over empty ones; give those to `snapshots` as rows."""
    glob = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.split(":", 1)[-1].lstrip("/").rstrip("/") + "/"
    relative = F.col("path").substr(F.locate(base, F.col("path")) + len(base), F.length("path"))
    return snapshots(files.select(relative.alias("relative_path"), "content"), observed_at, suffixes, excluded)
