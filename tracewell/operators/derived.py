"""Derived data: verification of what was derived from what, and a store that takes plans of changes once."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .governance import admissible
from .integrity import canonical
from .textgate import lines

# Fields of a derivation receipt, which of them its id is made from, kinds, levels and schema version.
FIELDS = ("receipt_id", "kind", "subject_id", "source_snapshot_ids", "input_artifact_ids", "transform_id", "output_hash", "derivation_verification_level", "status", "created_at", "metadata")
ID_FIELDS = ("kind", "subject_id", "source_snapshot_ids", "input_artifact_ids", "transform_id", "output_hash", "derivation_verification_level", "status", "metadata")
KINDS = ("derived.artifact.created", "derived.artifact.staled", "derived.artifact.tombstoned")
LEVELS = ("DV0", "DV1", "DV2", "DV3", "DV4")
SCHEMA_VERSION = "1"
_TRANSFORM = ("transform_id", "name", "version", "code_hash", "config_hash", "runtime_hash")
_RAW = "receipt_id string, kind string, subject_id string, source_snapshot_ids array<string>, input_artifact_ids array<string>, transform_id string, output_hash string, derivation_verification_level string, status string, created_at string, metadata struct<receipt_schema_version:string,transform:struct<" + ",".join(f"{t}:string" for t in _TRANSFORM) + ">>"


@F.pandas_udf(T.StringType())
def _recomputed_id(raw: pd.Series) -> pd.Series:
    """The id that a receipt's own fields come to."""

    def one(text):
        try:
            value = json.loads(text)
            return "drcpt_" + hashlib.sha256(canonical({k: value[k] for k in ID_FIELDS}).encode()).hexdigest()[:24]
        except (TypeError, ValueError, KeyError):
            return None

    return raw.map(one)


def verify_derivations(receipts: DataFrame, artifacts: DataFrame, snapshots: DataFrame, transforms: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(receipt_id, subject_id, level, status, errors): how far each derivation is verified, with what speaks against it.

    receipts: receipt_id, kind, subject_id, level, status, created_at, raw (its JSON); artifacts: artifact_id,
    artifact_type, source_snapshot_id, input_artifact_ids, transform_id, output_hash, receipt_id, status, max_lines,
    chunk_index; snapshots: snapshot_id, content_hash, content_text; transforms: its id, name, version and hashes;
    tombstones: artifact_id. Ids are unique in each table.

    A receipt must be an object with all its fields, agree with its row, have the id that its fields come to, and rest on
    snapshots, inputs (which must be admissible) and a transform that exist: else DV0. A created artifact must agree with its
    receipt (DV1). One that is a chunk of a source is made again: DV2 if its hash is that of its lines, DV1 if not.
    Staled and tombstoned ones must have the receipt's hash (DV1, else DV0). Errors are sorted.

    Each snapshot's text is cut once for every size of chunks in use, within its row; only hashes of chunks leave it. Lists
    of a receipt are looked up by equi-joins.
    """
    c = F.col
    rows = receipts.select("receipt_id", "kind", "subject_id", "level", "status", "created_at", "raw", F.json_object_keys("raw").alias("keys"), F.from_json("raw", _RAW).alias("r"), _recomputed_id("raw").alias("again"))
    lacking = F.array_except(F.array(*map(F.lit, FIELDS)), "keys")
    whole = F.size(lacking) == 0
    rule = lambda when, text: F.when(F.coalesce(when, F.lit(False)), F.lit(text) if isinstance(text, str) else text)
    told = {"receipt_id": "receipt_id", "kind": "kind", "subject_id": "subject_id", "derivation_verification_level": "level", "status": "status", "created_at": "created_at"}
    own = [rule(c("keys").isNull(), "receipt_json must decode to an object"), rule(c("keys").isNotNull() & ~whole, F.concat(F.lit("receipt_json missing fields: "), F.array_join(F.array_sort(lacking), ", ")))]
    own += [rule(whole & ~c(f"r.{f}").eqNullSafe(c(column)), f"receipt_json {f} does not match receipts row") for f, column in told.items()]
    own += [
        rule(whole & ~F.coalesce(c("r.kind").isin(*KINDS), F.lit(False)), "unknown receipt kind"),
        rule(whole & ~F.coalesce(c("r.derivation_verification_level").isin(*LEVELS), F.lit(False)), "unknown derivation_verification_level"),
        rule(whole & ~c("r.metadata.receipt_schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "unsupported receipt_schema_version"),
        rule(whole & (c("r.source_snapshot_ids").isNull() | F.exists("r.source_snapshot_ids", lambda x: x.isNull())), "source_snapshot_ids must be a list of strings"),
        rule(whole & (c("r.input_artifact_ids").isNull() | F.exists("r.input_artifact_ids", lambda x: x.isNull())), "input_artifact_ids must be a list of strings"),
        rule(whole & ~c("again").eqNullSafe(c("receipt_id")), "receipt_id does not match canonical receipt payload"),
    ]
    rows = rows.withColumn("own", F.array_compact(F.array(*own))).withColumn("whole", F.coalesce(whole, F.lit(False)))

    ids = artifacts.select("artifact_id", ((c("status") == "active")).alias("active")).join(tombstones.select("artifact_id").distinct().withColumn("gone", F.lit(True)), "artifact_id", "left").select("artifact_id", (c("active") & c("gone").isNull()).alias("active"))
    sound = admissible(ids, artifacts.select("artifact_id", F.explode("input_artifact_ids").alias("input_id")))
    needed = lambda field, name: rows.where("whole").select("receipt_id", F.explode(f"r.{field}").alias(name)).where(f"{name} is not null").distinct()
    no_snapshot = needed("source_snapshot_ids", "snapshot_id").join(snapshots.select("snapshot_id"), "snapshot_id", "left_anti").select("receipt_id", F.concat(F.lit("source snapshot not found: "), "snapshot_id").alias("e"))
    inputs = needed("input_artifact_ids", "artifact_id").join(sound, "artifact_id", "left").where("admissible is null or not admissible")
    no_input = inputs.select("receipt_id", F.when(c("admissible").isNull(), F.concat(F.lit("input artifact not found: "), "artifact_id")).otherwise(F.concat(F.lit("input artifact is not admissible: "), "artifact_id")).alias("e"))
    lineage = no_snapshot.union(no_input).groupBy("receipt_id").agg(F.collect_list("e").alias("lineage"))  # as many as one receipt lists

    cut = artifacts.where("artifact_type = 'source_chunk'").select(c("source_snapshot_id").alias("snapshot_id"), "max_lines").distinct().join(snapshots, "snapshot_id")
    text = F.transform(F.sequence(F.lit(0), F.size("lines") - 1, c("max_lines").cast("int")), lambda at: F.sha2(F.array_join(F.slice("lines", at + 1, c("max_lines").cast("int")), "\n"), 256))
    cut = cut.withColumn("lines", lines(c("content_text"))).where((F.size("lines") > 0) & (c("max_lines") > 0))
    chunks = cut.select("snapshot_id", "max_lines", F.posexplode(text).alias("chunk_index", "chunk_hash")).select(c("snapshot_id").alias("source_snapshot_id"), "max_lines", c("chunk_index").cast("long").alias("chunk_index"), F.concat(F.lit("sha256:"), "chunk_hash").alias("chunk_hash"))
    known = snapshots.select(c("snapshot_id").alias("source_snapshot_id"), (c("content_text").isNotNull()).alias("has_text"), (F.concat(F.lit("sha256:"), F.sha2("content_text", 256)) == c("content_hash")).alias("intact"))
    made = artifacts.join(known, "source_snapshot_id", "left").join(chunks, ["source_snapshot_id", "max_lines", "chunk_index"], "left").join(transforms.select("transform_id", c("name").alias("made_by")), "transform_id", "left")
    made = made.select(c("artifact_id").alias("subject_id"), F.struct("artifact_type", "source_snapshot_id", "input_artifact_ids", "transform_id", "output_hash", c("receipt_id").alias("by"), "has_text", "intact", "chunk_hash", "made_by").alias("a"))
    used = transforms.select(F.struct(*_TRANSFORM).alias("t"), c("transform_id").alias("claimed_transform"))
    rows = rows.join(lineage, "receipt_id", "left").join(made, "subject_id", "left").withColumn("claimed_transform", c("r.transform_id")).join(used, "claimed_transform", "left")

    a, r, here = lambda x: c(f"a.{x}"), lambda x: c(f"r.{x}"), c("a").isNotNull()
    whole = c("whole")
    ground = F.concat("own", F.coalesce("lineage", F.array().cast("array<string>")), F.array_compact(F.array(rule(whole & ~here, "subject artifact not found"), rule(whole & c("t").isNull(), "transform not found"))))
    transform_errors = [rule(r("metadata.transform").isNotNull() & ~r(f"metadata.transform.{t}").eqNullSafe(c(f"t.{t}")), f"receipt transform {t} does not match committed transform") for t in _TRANSFORM]
    differs = lambda x, y: ~x.eqNullSafe(y)
    created = [
        rule(differs(a("by"), c("receipt_id")), "artifact receipt_id does not match receipt"),
        rule(differs(a("output_hash"), r("output_hash")), "artifact output_hash does not match receipt"),
        rule(differs(a("transform_id"), r("transform_id")), "artifact transform_id does not match receipt"),
        rule(a("source_snapshot_id").isNotNull() & ~F.array_contains(r("source_snapshot_ids"), a("source_snapshot_id")), "artifact source snapshot not present in receipt"),
        rule(differs(a("input_artifact_ids"), r("input_artifact_ids")), "artifact input_artifact_ids do not match receipt"),
        *transform_errors,
    ]
    chunk = F.coalesce(a("artifact_type") == "source_chunk", F.lit(False))
    redo = (
        F.when(F.coalesce(a("source_snapshot_id") == "", F.lit(True)), "artifact has no source_snapshot_id")
        .when(a("has_text").isNull(), "source snapshot not found")
        .when(~a("has_text"), "source snapshot does not contain recomputable content_text")
        .when(~a("intact"), "source snapshot content_text hash does not match content_hash")
        .when(a("made_by").isNull(), "transform not found")
        .when(a("made_by") != "line_chunker", F.concat(F.lit("unsupported transform for recompute: "), a("made_by")))
        .when(a("chunk_hash").isNull(), "artifact chunk_index is outside recomputed chunk range")
        .when(a("chunk_hash") != a("output_hash"), "recomputed output hash does not match artifact")
    )
    born = F.array_compact(F.array(*created, F.when(chunk, redo)))
    moved = F.array_compact(F.array(rule(differs(a("output_hash"), r("output_hash")), "artifact output_hash does not match receipt"), *transform_errors))
    is_new = r("kind") == KINDS[0]
    errors = F.when(F.size(ground) > 0, ground).when(is_new, born).otherwise(moved)
    level = F.when(F.size("ground") > 0, "DV0").when(is_new & chunk, F.when(F.size("errors") == 0, "DV2").otherwise("DV1")).otherwise(F.when(F.size("errors") == 0, "DV1").otherwise("DV0"))
    rows = rows.withColumn("ground", ground).withColumn("errors", errors)
    return rows.select("receipt_id", "subject_id", level.alias("level"), F.when(F.size("errors") == 0, "verified").otherwise("failed").alias("status"), F.array_sort("errors").alias("errors"))


#: Tables of the store, their keys, and the columns that a later row of a key changes; None: all of them.
STORE = {
    "sources": ("source_id", ("last_seen_at",)),
    "snapshots": ("snapshot_id", ()),
    "transforms": ("transform_id", ()),
    "artifacts": ("artifact_id", ("status", "receipt_id", "level")),
    "receipts": ("receipt_id", ()),
    "tombstones": ("artifact_id", None),
}


def merged(table: DataFrame, changes: DataFrame, key: str, moving: tuple[str, ...] | None) -> DataFrame:
    """A table after ``changes`` (its columns and ``n``, their order): one row a key. A key that is new comes in with its first
    row; of those in ``moving`` the last row counts, all other columns stay as they were first (None: the last row whole)."""
    columns = table.columns
    both = table.withColumn("n", F.lit(-1).cast("long")).unionByName(changes.select(*columns, F.col("n").cast("long")))
    first, last = F.min_by(F.struct(*columns), "n").alias("first"), F.max_by(F.struct(*columns), "n").alias("last")
    rows = both.groupBy(F.col(key).alias("the_key")).agg(first, last)
    return rows.select(*[F.col(f"last.{c}" if moving is None or c in moving else f"first.{c}").alias(c) for c in columns])


def applied(store: dict[str, DataFrame], plan: dict[str, DataFrame], marks: DataFrame) -> dict[str, DataFrame]:
    """The store's tables after a plan: upserts by table (with ``n``), then ``marks`` (artifact_id, status, n): the last
    mark of an artifact that comes after its last upsert is its status. Ids of marks that no artifact has go."""
    out = {name: merged(rows, plan[name], *STORE[name]) if name in plan else rows for name, rows in store.items()}
    put = plan["artifacts"].groupBy("artifact_id").agg(F.max("n").alias("put")) if "artifacts" in plan else None
    last = marks.groupBy("artifact_id").agg(F.max(F.struct("n", F.col("status").alias("marked"))).alias("m"))
    rows = out["artifacts"].join(last, "artifact_id", "left")
    rows = rows.join(put, "artifact_id", "left") if put is not None else rows.withColumn("put", F.lit(None).cast("long"))
    counts = F.col("m").isNotNull() & (F.col("put").isNull() | (F.col("m.n") > F.col("put")))
    rows = rows.withColumn("status", F.when(counts, F.col("m.marked")).otherwise(F.col("status")))
    return out | {"artifacts": rows.select(*out["artifacts"].columns)}


def _version(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(the last version that was written whole, the plans in it)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 0, []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/plans/_SUCCESS"))]
    if not done:
        return 0, []
    return max(done), [r[0] for r in spark.read.parquet(f"{path}/v={max(done)}/plans").collect()]


def read_store(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of the store's last whole version; empty ones where there is none."""
    version, _ = _version(spark, path)
    return {name: spark.read.schema(ddl).parquet(f"{path}/v={version}/{name}") if version else spark.createDataFrame([], ddl) for name, ddl in schemas.items()}


def apply_plan(spark: SparkSession, path: str, schemas: dict[str, str], plan_id: str, plan: dict[str, DataFrame], marks: DataFrame) -> bool:
    """Write the store's next version with a plan applied; False, and nothing is written, if it holds the plan already.

    A version is a folder; the list of its plans is written last and makes it count, so a job that dies leaves the old
    version in force, and runs again to the same result. One writer at a time. The list of plans is one row a plan.
    """
    version, plans = _version(spark, path)
    if plan_id in plans:
        return False
    for name, rows in applied(read_store(spark, path, schemas), plan, marks).items():
        rows.write.mode("overwrite").parquet(f"{path}/v={version + 1}/{name}")
    spark.createDataFrame([(p,) for p in [*plans, plan_id]], "plan_id string").coalesce(1).write.mode("overwrite").parquet(f"{path}/v={version + 1}/plans")
    return True
