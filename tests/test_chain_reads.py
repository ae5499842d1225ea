"""Items of chains are grouped once, not for each join of the tables made of them."""

from tracewell.jobs import claim_jobs


def test_items_are_read_once(spark):
    found = claim_jobs.claim_chain_findings(spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in found._jdf.queryExecution().optimizedPlan().toString()
