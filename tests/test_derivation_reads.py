"""Texts are cut into chunks once, not for each join of their receipts and artifacts."""

from tracewell.jobs import derived_jobs


def test_documents_are_read_for_snapshots_only(spark):
    found = derived_jobs.derivation_levels(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4, plan  # 14 with chunks cut anew for each use
