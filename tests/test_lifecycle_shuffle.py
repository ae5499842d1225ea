"""Rows of a case meet in one shuffle, so what a run keeps on disk does not grow with the number of rules."""

from datetime import datetime

from tracewell.operators import checkpoints

SAME = "request_id string, checkpoint_id string, checkpoint_type string, subject string, attempt long, relying_party string"
ROW = ("q", "p", "email", "s", 1, "rp")


def tables(spark, *receipts):
    hour = lambda h: datetime(2024, 1, 1, h)
    return (
        spark.createDataFrame([("a", *ROW, "ep", hour(0))], f"case_id string, {SAME}, episode_id string, requested_at timestamp"),
        spark.createDataFrame([("a", f"e{n}", *ROW, "e1" if n == 2 else None, hour(n), "pol", "h") for n in (1, 2)], f"case_id string, evaluation_id string, {SAME}, supersedes_evaluation_id string, evaluated_at timestamp, policy_id string, policy_hash string"),
        spark.createDataFrame([("a", "x", "q", "p", "email", "e2", None, "released", hour(9), None, ["r", None])], "case_id string, resolution_id string, request_id string, checkpoint_id string, checkpoint_type string, evaluation_id string, final_evaluation_id string, outcome string, resolved_at timestamp, approved_at timestamp, decision_ids array<string>"),
        spark.createDataFrame(
            [("a", r, "other", "checkpoint_attempt:p", hour(h), ["e2", "z", None], "pol", "h", "APPROVE", "execute") for r, h in receipts],
            "case_id string, receipt_id string, episode_id string, decision_subject string, decided_at timestamp, refs array<string>, policy_id string, policy_hash string, verdict string, disposition string",
        ),
    )


def test_one_shuffle(spark):
    plan = checkpoints.lifecycle_errors(*tables(spark, ("r", 3)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_decisions_of_one_receipt_are_judged_once_each(spark):
    """A null among the ids that a resolution names is no decision."""
    found = checkpoints.lifecycle_errors(*tables(spark, ("r", 3), ("r", 4))).collect()
    two = [("decision_episode_id_mismatch", "r"), ("decision_references_multiple_evaluations", "r")]
    want = [*two, *two, ("final_decision_not_bound_to_final_evaluation", "x"), ("resolution_references_unknown_decision", None)]
    assert sorted(((r.error, r.about) for r in found), key=repr) == sorted(want, key=repr)


def test_errors_are_counted_where_they_were_found(spark):
    """Only the requests' names are shuffled beside the rows of the cases."""
    made = tables(spark, ("r", 3))
    results = checkpoints.lifecycle_results(made[0], checkpoints.lifecycle_errors(*made))
    assert results._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    assert [tuple(r) for r in results.collect()] == [("a", False, 2)]  # another episode, and a null id
