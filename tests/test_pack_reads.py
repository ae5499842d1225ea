from pyspark.sql import functions as F

from tracewell.jobs import pack_jobs
from tracewell.operators import packs

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_findings_are_made_once(spark):
    files = spark.createDataFrame([("a", "pack_manifest.json"), ("b", "pack_manifest.json"), ("b", "x")], "pack_id string, path string")
    found = spark.createDataFrame([("a", "validate_schema", "error"), ("b", "validate_paths", "warning"), ("b", "validate_receipts", "error")], "pack_id string, stage string, severity string")
    done = packs.stage_results(files, found.withColumn("stage", F.concat(F.lit("mark"), "stage")).withColumn("stage", F.substring("stage", 5, 99)))
    assert "mark" not in _plan(done)
    got = {(r.pack_id, r.stage): r.passed for r in done.collect()}
    assert got == {("a", "validate_schema"): False} | {("b", s): s != "validate_receipts" for s in packs.STAGES}


def test_files_are_made_once(spark):
    assert "props" not in _plan(pack_jobs.pack_findings(spark, SF)) and "props" not in _plan(pack_jobs.pack_stages(spark, SF))
