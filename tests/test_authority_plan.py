"""Artifacts, by far the largest table, are read and shuffled once."""

from tests.test_authority import chain

from tracewell.operators import authority


def test_artifacts_are_read_once(spark, tmp_path):
    made = [chain(n) for n in ("a", "b")]
    row, artifacts, proofs = made[0][0], [a for m in made for a in m[1]], [p for m in made for p in m[2]]
    text = [n for n in ("chain_id", "at", *authority.REQUIRED, *authority.OPTIONAL)]
    ddl = ", ".join(f"{n} string" for n in text) + ", verifier_receipt_refs array<string>, revoked_artifact_refs array<string>, action_domain_authorized boolean, claim_tier string, evidence_tier string"
    assert len(row) == len(ddl.split(", "))
    spark.createDataFrame(artifacts, authority.ARTIFACT).write.parquet(f"{tmp_path}/artifacts")
    found = authority.findings(
        spark.createDataFrame([m[0] for m in made], ddl),
        spark.read.parquet(f"{tmp_path}/artifacts"),
        spark.createDataFrame(proofs, "chain_id string, ref string, log_index string, integrated_time string, body_hash string"),
        spark.createDataFrame([], "ref string, revoked_at string"),
    )
    assert found.count() == 0
    assert found._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1
