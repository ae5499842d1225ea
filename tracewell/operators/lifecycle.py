"""Lifecycles from ordered events: commitments, contradictions, episodes, obligations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.receipts import parse_time

REGISTERED, OBSERVED, TERMINATED = "commitment.registered", "result.observed", "commitment.terminated"
FULFILLED = ("fulfillment.commitment_kept", "fulfillment.commitment_broken")


def commitment_ends(events: DataFrame) -> DataFrame:
    """Every fulfillment and termination with what became of it.

    events: (commitment_id, seq, type, result_id, terminal_reason, idempotency_key, ...). A
    fulfillment closes its commitment if the commitment was registered before, an earlier
    observation anchors the same result to it, and nothing ended it before. A termination that
    bears id, reason and key ends it whether or not it was registered. All windows are those of one
    commitment; no store-wide order is needed.
    """
    rows = events.where("commitment_id <> ''")
    pair = Window.partitionBy("commitment_id", "result_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("anchor", F.last(F.when(F.col("type") == OBSERVED, F.col("seq")), ignorenulls=True).over(pair))
    whole = Window.partitionBy("commitment_id")
    rows = rows.withColumn("registered", F.min(F.when(F.col("type") == REGISTERED, F.col("seq"))).over(whole))
    fulfills = F.col("type").isin(*FULFILLED) & (F.col("result_id") != "")
    terminates = (F.col("type") == TERMINATED) & (F.col("terminal_reason") != "") & (F.col("idempotency_key") != "")
    ready = (fulfills & (F.col("registered") < F.col("seq")) & F.col("anchor").isNotNull()) | terminates
    rows = rows.withColumn("end", F.min(F.when(ready, F.struct("seq", "type"))).over(whole))
    ends = rows.where(fulfills | terminates)
    late = F.col("end.seq") < F.col("seq")
    reasons = F.when(fulfills, F.array_compact(F.array(F.when(F.coalesce(F.col("registered") >= F.col("seq"), F.lit(True)), "no registration"), F.when(F.col("anchor").isNull(), "no anchor"), F.when(late & F.col("end.type").isin(*FULFILLED), "after closure"), F.when(late & (F.col("end.type") == TERMINATED), "after termination"))))
    ends = ends.withColumn("reasons", F.coalesce(F.array_join(reasons, "; "), F.when(late, "already ended").otherwise("")))
    return ends.withColumn("valid", F.col("seq") == F.col("end.seq")).withColumn("anchor_seq", F.when(fulfills, F.col("anchor")))


def registrations(events: DataFrame) -> DataFrame:
    """The first registration of each commitment."""
    rows = events.where((F.col("type") == REGISTERED) & (F.col("commitment_id") != ""))
    return rows.groupBy("commitment_id").agg(F.min(F.struct("seq", "due_at", "actor_id")).alias("r")).select("commitment_id", "r.*")


def commitment_summary(events: DataFrame, now: str) -> DataFrame:
    """OPEN, CLOSED or TERMINATED of every registered commitment; overdue only if open and due, readably, before ``now``."""
    ends = commitment_ends(events).where("valid").select("commitment_id", F.col("type").alias("end_type"), F.col("seq").alias("end_seq"))
    rows = registrations(events).join(ends, "commitment_id", "left")
    status = F.when(F.col("end_type").isNull(), "OPEN").when(F.col("end_type") == TERMINATED, "TERMINATED").otherwise("CLOSED")
    rows = rows.withColumn("status", status)
    overdue = (F.col("status") == "OPEN") & F.coalesce(parse_time(F.col("due_at")) < F.lit(now).cast("timestamp"), F.lit(False))
    return rows.withColumn("overdue", overdue)


def commitment_timeline(events: DataFrame) -> DataFrame:
    """(commitment_id, line, seq, type, summary, note): what happened to each commitment, in order.

    The first registration, every observation and fulfillment that names a result, and the termination that took
    effect. At one place in the order, a registration comes first and a termination last.
    """
    quoted = lambda c: F.concat(F.lit("'"), F.coalesce(F.col(c), F.lit("")), F.lit("'"))
    line = lambda rank, text, note: [F.lit(rank).alias("rank"), text.alias("summary"), note.alias("note")]
    due = F.coalesce(F.nullif(F.col("due_at"), F.lit("")), F.lit("perpetual"))
    first = registrations(events).select("commitment_id", "seq", F.lit(REGISTERED).alias("type"), *line(0, F.concat(F.lit("registered by actor_id="), quoted("actor_id"), F.lit(", due_at="), due), F.lit("ok")))
    seen = events.where((F.col("type") == OBSERVED) & (F.col("commitment_id") != "") & (F.col("result_id") != ""))
    seen = seen.select("commitment_id", "seq", "type", *line(1, F.concat(F.lit("observed result_id="), quoted("result_id")), F.lit("anchor edge present")))
    ends = commitment_ends(events)
    broken = F.concat(F.lit("invalid anchor ("), F.coalesce(F.nullif(F.col("reasons"), F.lit("")), F.lit("unknown")), F.lit(")"))
    stops = F.col("type") == TERMINATED
    replaced = F.when(F.col("replacement_id") != "", F.concat(F.lit(", replacement="), quoted("replacement_id"))).otherwise("")
    text = F.when(stops, F.concat(F.lit("terminated (reason="), F.col("terminal_reason"), replaced, F.lit(")"))).otherwise(F.concat(F.lit("fulfillment for result_id="), quoted("result_id")))
    note = F.when(stops, "terminates commitment").when(F.col("valid") & (F.col("reasons") == ""), "closes commitment").otherwise(broken)
    ended = ends.where(~stops | F.col("valid")).select("commitment_id", "seq", "type", F.when(stops, 3).otherwise(2).alias("rank"), text.alias("summary"), note.alias("note"))
    order = Window.partitionBy("commitment_id").orderBy("seq", "rank", "summary")
    return first.union(seen).union(ended).withColumn("line", F.row_number().over(order)).select("commitment_id", "line", "seq", "type", "summary", "note")


def supersession_edges(events: DataFrame) -> DataFrame:
    """(predecessor, successor, source_seq, source_type, root): each pair once, from its first source, with the first root that is given."""
    declared = events.where((F.col("type") == REGISTERED) & (F.col("supersedes_id") != "")).select(F.col("supersedes_id").alias("predecessor"), F.col("commitment_id").alias("successor"), "seq", "type", "root_id")
    ended = commitment_ends(events).where((F.col("type") == TERMINATED) & F.col("valid") & (F.col("replacement_id") != "")).select(F.col("commitment_id").alias("predecessor"), F.col("replacement_id").alias("successor"), "seq", "type", "root_id")
    rows = declared.union(ended).groupBy("predecessor", "successor").agg(F.min(F.struct("seq", "type")).alias("s"), F.min(F.when(F.col("root_id") != "", F.struct("seq", "root_id"))).alias("g"))
    return rows.select("predecessor", "successor", F.col("s.seq").alias("source_seq"), F.col("s.type").alias("source_type"), F.col("g.root_id").alias("root"))


def open_contradictions(events: DataFrame) -> DataFrame:
    """First registration of every contradiction that its trace does not resolve."""
    named = events.where("contradiction_id <> ''")
    first = named.where("type = 'contradiction.registered'").groupBy("trace_id", "contradiction_id").agg(F.min(F.struct("seq", "severity")).alias("f"))
    solved = named.where("type = 'contradiction.resolved'").select("trace_id", "contradiction_id").distinct()
    return first.join(solved, ["trace_id", "contradiction_id"], "left_anti").select("trace_id", "contradiction_id", "f.*")


def orphaned_episodes(events: DataFrame) -> DataFrame:
    """Episodes that are opened and, in the same trace from then on, neither closed nor abandoned."""
    rows = events.where("episode_id <> ''")
    opened = F.min(F.when(F.col("type") == "episode.opened", F.col("seq"))).over(Window.partitionBy("trace_id", "episode_id"))
    after = rows.withColumn("opened_seq", opened).where(F.col("seq") >= F.col("opened_seq"))
    done = F.bool_or(F.col("type").isin("episode.closed", "episode.abandoned"))
    found = after.groupBy("trace_id", "episode_id").agg(F.min("opened_seq").alias("opened_seq"), F.count("*").alias("receipts"), F.max_by("type", "seq").alias("last_type"), F.max("seq").alias("last_seq"), done.alias("done"))
    return found.where("not done").drop("done")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def obligation_posture(snapshots: DataFrame, now: str, by: str = "owner") -> DataFrame:
    """Open and overdue obligations of each owner; a due date that can't be read counts as overdue."""
    rows = latest(snapshots, "obligation_id", ["saved_at", "line_no"])
    is_open = F.col("status") == "open"
    late = is_open & F.coalesce(parse_time(F.col("due_at")) < F.lit(now).cast("timestamp"), F.lit(True))
    out = rows.groupBy(by).agg(F.count_if(is_open).alias("open_count"), F.count_if(late).alias("overdue_count"))
    return out.withColumn("posture", F.when(F.col("open_count") == 0, "CLEAN").when(F.col("overdue_count") > 0, "DEBT_OVERDUE").otherwise("DEBT_OUTSTANDING"))


# What may come before a decision; any other predecessor is denied.
BEFORE_DECISION = ("refusal", "contradiction.resolved")


def succession(events: DataFrame) -> DataFrame:
    """(trace_id, seq, predecessor, allowed) of every decision."""
    before = F.lag("type").over(Window.partitionBy("trace_id").orderBy("seq"))
    rows = events.withColumn("predecessor", before).where("type = 'decision_v1'")
    return rows.select("trace_id", "seq", "predecessor", F.coalesce(F.col("predecessor").isin(*BEFORE_DECISION), F.lit(False)).alias("allowed"))
