"""Lifecycles of checkpoints: a request, its evaluations one after another, the resolution, and the decisions between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Outcomes that need a decision.
DECIDED = ("released", "dispatch_failed", "blocked", "refused")
_SAME = ("request_id", "checkpoint_id", "checkpoint_type", "subject", "attempt", "relying_party")


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def lifecycle_errors(requests: DataFrame, evaluations: DataFrame, resolutions: DataFrame, decisions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(case_id, error, about): what is inconsistent in each case, once for each evaluation or decision it is about.

    requests: case_id, request_id, checkpoint_id, checkpoint_type, subject, episode_id, attempt, relying_party,
    requested_at; evaluations: case_id, evaluation_id, the same of the request, supersedes_evaluation_id, evaluated_at,
    policy_id, policy_hash; resolutions: case_id, resolution_id, request_id, checkpoint_id, checkpoint_type, evaluation_id,
    final_evaluation_id, outcome, resolved_at, approved_at, decision_ids (list); decisions: case_id, receipt_id,
    episode_id, decision_subject, decided_at, refs (list), policy_id, policy_hash, verdict, disposition. One request and
    one resolution a case; times are timestamps. Evaluations go by time, then id; so do decisions. known: case_id of cases
    that must be judged even if they have no row in any table.

    A case without a request, evaluation or resolution, or whose resolution names an evaluation it lacks, gets that error
    only. All rows of a case meet in one shuffle, and nothing is written: what a row is judged by (the evaluations that
    a reference names, the one in force at a decision, the case's own facts) comes from windows within the case, so no table is
    joined, and a case of very many rows is sorted, not gathered.
    """
    c, case = F.col, Window.partitionBy("case_id")
    final = F.coalesce(F.nullif("final_evaluation_id", F.lit("")), F.col("evaluation_id"))
    parts = [
        requests.select("case_id", F.struct("requested_at", "episode_id", *_SAME).alias("q")),
        evaluations.select("case_id", F.struct("evaluation_id", *_SAME, "supersedes_evaluation_id", "evaluated_at").alias("e"), F.struct("policy_id", "policy_hash").alias("policy")),
        resolutions.select("case_id", F.struct("resolution_id", "request_id", "checkpoint_id", "checkpoint_type", "evaluation_id", final.alias("final_id"), "outcome", "resolved_at", "approved_at").alias("res"), c("decision_ids").alias("ids")),
        decisions.select("case_id", F.struct("receipt_id", "episode_id", "decision_subject", "decided_at", "policy_id", "policy_hash", "verdict", "disposition").alias("d"), c("refs").alias("ids")),
    ]
    rows = parts[0] if known is None else parts[0].unionByName(known.select("case_id"), allowMissingColumns=True)
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    # rows grow when references are told apart, so partitions must not be joined by their size before
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_id")

    # a row itself, and one for each evaluation that a decision refers to, or decision that a resolution names
    def look(kind: int, of_decision: Column, key: Column, receipt: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), of_decision.alias("of_decision"), key.cast("string").alias("key"), receipt.cast("string").alias("receipt"))

    none, is_decision, own_row, ref_row, named_row = F.lit(None), c("d").isNotNull(), 0, 1, 2
    own = look(own_row, is_decision, F.coalesce("d.receipt_id", "e.evaluation_id", "res.final_id"), c("d.receipt_id"))
    refs = F.transform("ids", lambda x: look(ref_row, F.lit(False), x, c("d.receipt_id")))
    named = F.transform("ids", lambda x: look(named_row, F.lit(True), x, none))
    looks = F.when(c("ids").isNull(), F.array(own)).when(is_decision, F.concat(F.array(own), refs)).otherwise(F.concat(F.array(own), named))
    rows = rows.withColumn("look", F.explode(looks)).select("case_id", "look.*", *[F.when(c("look.kind") == own_row, c(x)).alias(x) for x in ("q", "res", "e", "d", "policy")])

    # what has the same id within the case, kept where it is asked for, and then what the references of one decision found
    same, mine = Window.partitionBy("case_id", "of_decision", "key"), Window.partitionBy("case_id", "receipt")
    is_e, is_d, kind = c("e").isNotNull(), c("d").isNotNull(), lambda n: c("kind") == n
    met = lambda when, x: F.when(when & c("key").isNotNull(), x)
    rows = rows.withColumns({
        "n": F.count("e").over(same),
        "met": F.max(F.when(is_e, F.struct("e.evaluation_id", "e.evaluated_at", "policy"))).over(same),
        "latest": F.max(F.when(is_e, F.struct(c("e.evaluated_at").alias("at"), c("e.checkpoint_type").alias("type")))).over(same),
        "there": F.count("d").over(same),
    }).where(~kind(named_row) | c("key").isNull() | (c("there") == 0))
    rows = rows.select("case_id", "kind", "receipt", met(kind(named_row), c("key")).alias("key"), "q", "res", "e", "d", met(c("res").isNotNull(), c("latest")).alias("latest"), met(is_e & (c("n") > 1), F.lit(True)).alias("again"), met(kind(ref_row), c("n")).alias("n"), met(kind(ref_row), c("met")).alias("met"))
    bound = {"bound": F.nullif(F.sum("n").over(mine), F.lit(0)), "to": F.max("met").over(mine)}
    rows = rows.withColumns(bound).where(~kind(ref_row)).select("case_id", "kind", "key", "q", "res", "e", "d", "latest", "again", *[F.when(is_d & c("receipt").isNotNull(), c(x)).alias(x) for x in bound])

    # evaluations and decisions by time, and what holds of the whole case; its request comes first
    rank = F.when(is_e, 0).when(is_d, 1).when(kind(named_row), -1).otherwise(F.when(c("q").isNotNull(), -3).otherwise(-2))
    rows = rows.withColumns({"at": F.coalesce("e.evaluated_at", "d.decided_at"), "rank": rank, "id": F.coalesce("e.evaluation_id", "d.receipt_id")})
    order = case.orderBy("at", "rank", "id")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    one = is_d & F.coalesce(c("bound") == 1, F.lit(False))
    decided = F.struct("d.decided_at", "d.receipt_id", "d.verdict", "d.disposition", "to.evaluation_id")
    rows = rows.withColumns({
        "place": F.row_number().over(order),
        "nth": F.count("e").over(upto),
        "in_force": F.last("e.evaluation_id", ignorenulls=True).over(upto),
        "before": F.last(F.when(is_e, F.struct("e.evaluation_id")), ignorenulls=True).over(before),
    })
    rows = rows.withColumns({
        "req": F.max("q").over(case),
        "end": F.max(F.when(c("res").isNotNull(), F.struct("res", "latest"))).over(case),
        "listed": F.max(~is_d).over(case),
        "evaluations": F.count("e").over(case),
        "twice": F.max("again").over(case),
        "newest": F.max(F.when(is_e, F.struct("e.evaluated_at", "e.evaluation_id"))).over(case),
        "decisions": F.count("d").over(case),
        "last": F.max(F.when(is_d, decided)).over(case),
        "last_bound": F.max(F.when(one, decided)).over(case),
    })

    request, res, final_id, final_at = lambda x: c(f"req.{x}"), lambda x: c(f"end.res.{x}"), c("end.res.final_id"), c("end.latest.at")
    stop = F.when(c("req").isNull() | c("case_id").isNull(), "request_invalid").when(c("evaluations") == 0, "evaluation_invalid").when(final_at.isNull(), "resolution_invalid")

    def found(about: Column, rules: list[tuple[Column, str]]) -> Column:
        return F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name).alias("error"), about.cast("string").alias("about"))) for when, name in rules]))

    of_evaluation = [(_differs(request(x), c(f"e.{x}")), f"{x}_mismatch_between_request_and_evaluation") for x in _SAME]
    of_evaluation += [
        (c("e.evaluated_at") < request("requested_at"), "evaluation_precedes_request"),
        ((c("evaluations") > 1) & (c("nth") == 1) & c("e.supersedes_evaluation_id").isNotNull(), "initial_evaluation_must_not_supersede"),
        ((c("nth") > 1) & _differs(c("e.supersedes_evaluation_id"), c("before.evaluation_id")), "evaluation_supersession_chain_invalid"),
    ]
    of_decision = [
        (_differs(c("d.episode_id"), request("episode_id")), "decision_episode_id_mismatch"),
        (_differs(c("d.decision_subject"), F.concat(F.lit("checkpoint_attempt:"), request("checkpoint_id"))), "decision_subject_mismatch"),
        (c("d.decided_at") < request("requested_at"), "decision_precedes_request"),
        (c("d.decided_at") > res("resolved_at"), "decision_after_resolution"),
        (c("bound").isNull(), "decision_missing_evaluation_ref"),
        (c("bound") > 1, "decision_references_multiple_evaluations"),
        (one & _differs(c("d.policy_id"), c("to.policy.policy_id")), "decision_policy_id_mismatch"),
        (one & _differs(c("d.policy_hash"), c("to.policy.policy_hash")), "decision_policy_hash_mismatch"),
        (one & (c("d.decided_at") < c("to.evaluated_at")), "decision_precedes_evaluation"),
        (one & (c("in_force") != c("to.evaluation_id")), "decision_uses_superseded_evaluation"),
    ]
    approved = res("approved_at")
    verdict, disposition, outcome, some = c("last.verdict"), c("last.disposition"), res("outcome"), c("decisions") > 0
    of_case = [
        (c("twice"), "duplicate_evaluation_id"),
        ((c("evaluations") > 1) & (c("newest.evaluation_id") != final_id), "resolution_uses_superseded_evaluation"),
        (_differs(request("request_id"), res("request_id")), "request_id_mismatch_between_request_and_resolution"),
        (_differs(request("checkpoint_id"), res("checkpoint_id")), "checkpoint_id_mismatch_between_request_and_resolution"),
        (_differs(final_id, res("evaluation_id")), "evaluation_id_mismatch_between_evaluation_and_resolution"),
        (_differs(c("end.latest.type"), res("checkpoint_type")), "checkpoint_type_mismatch_between_evaluation_and_resolution"),
        (res("resolved_at") < final_at, "resolution_precedes_evaluation"),
        (approved < request("requested_at"), "approval_precedes_request"),
        (approved > res("resolved_at"), "approval_after_resolution"),
        (outcome.isin(*DECIDED) & ~some, "decision_missing_for_terminal_outcome"),
        (some & _differs(c("last_bound.evaluation_id"), final_id), "final_decision_not_bound_to_final_evaluation"),
        (some & outcome.isin("released", "dispatch_failed") & (_differs(verdict, F.lit("APPROVE")) | _differs(disposition, F.lit("execute"))), "release_like_resolution_requires_approve_execute_decision"),
        (some & (outcome == "blocked") & (_differs(verdict, F.lit("REFUSE")) | _differs(disposition, F.lit("block"))), "blocked_resolution_requires_refuse_block_decision"),
        (some & (outcome == "refused") & _differs(verdict, F.lit("REFUSE")), "refused_resolution_requires_refuse_decision"),
    ]
    first, true = c("place") == 1, F.lit(True)
    errors = (
        F.when(stop.isNotNull(), F.when(first & c("listed"), F.array(F.struct(stop.alias("error"), none.cast("string").alias("about")))))
        .when(is_e, found(c("e.evaluation_id"), of_evaluation))
        .when(is_d, found(c("d.receipt_id"), of_decision))
        .when(kind(named_row), found(c("key"), [(true, "resolution_references_unknown_decision")]))
        .when(first, found(res("resolution_id"), of_case))
    )
    return rows.select("case_id", F.explode(errors).alias("f")).select("case_id", "f.error", "f.about")


def lifecycle_results(requests: DataFrame, errors: DataFrame) -> DataFrame:
    """(case_id, passed, errors) of every request."""
    n = errors.groupBy("case_id").agg(F.count("*").alias("errors"))
    return requests.select("case_id").distinct().join(n, "case_id", "left").select("case_id", F.col("errors").isNull().alias("passed"), F.coalesce("errors", F.lit(0)).alias("errors"))
