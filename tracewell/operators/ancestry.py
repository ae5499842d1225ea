"""Long chains and graphs in few rounds: ancestors by pointer doubling, grounded nodes by peeling with shortcuts, reasons of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import settle

# Fixed value: chains of so many steps at most are followed without a look for rings in the whole graph.
SHORT = 64


def _after(rows: DataFrame, column: str, hops: DataFrame, *more: str) -> DataFrame:
    """Rows with ``next`` (and ``next_...``), where a hop from the node in ``column`` leads. The hops get columns of their
    own: a checkpoint joined with itself would have each of its columns twice."""
    told = hops.select(F.col("node").alias("via"), F.col("parent").alias("next"), *[F.col(m).alias(f"next_{m}") for m in more])
    return rows.join(told, F.col(column) == F.col("via")).drop("via")


def _twice(hops: DataFrame) -> DataFrame:
    return settle(_after(hops, "parent", hops).select("node", F.col("next").alias("parent")))


def _closing(parents: DataFrame) -> DataFrame:
    """(node, most): of nodes from which one never comes to an end, the steps until a node comes again, less one.

    parents: (node, parent), one parent a node. Nodes are first narrowed to those without an end, then to their rings;
    each is a doubling of steps, which is over as soon as a round takes nothing away. A ring is numbered by its least node.
    """
    hop, n = parents, parents.count()
    while True:
        twice = _twice(hop)
        left = twice.count()
        if left == n or not left:
            break
        hop, n = twice, left
    if not left:
        return parents.select("node", F.lit(0).cast("long").alias("most")).limit(0)
    endless, hop = settle(parents.join(twice.select(F.col("node").alias("n")), F.col("node") == F.col("n"), "left_semi")), twice
    size = hop.select("parent").distinct().count()
    while True:
        hop = _twice(hop)
        now = hop.select("parent").distinct().count()
        if now == size:
            break
        size = now
    ring = settle(endless.join(hop.select(F.col("parent").alias("n")).distinct(), F.col("node") == F.col("n"), "left_semi"))
    least, width = ring.withColumn("least", F.least("node", "parent")), 2
    while width < 2 * size:
        least = settle(_after(least, "parent", least, "least").select("node", F.col("next").alias("parent"), F.least("least", "next_least").alias("least")))
        width = 2 * width
    length = least.groupBy("least").agg(F.count("*").alias("length"))
    rings = least.join(length, "least").select("node", "length")
    outside = settle(endless.join(ring.select(F.col("node").alias("n")), F.col("node") == F.col("n"), "left_anti"))
    reached = _doubled(outside, outside.select("node")).join(ring.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    entry = reached.select("node", "step", "ancestor").join(rings.withColumnRenamed("node", "ancestor"), "ancestor").select("node", (F.col("step") + F.col("length") - 1).alias("most"))
    return settle(entry.union(rings.select("node", F.col("length") - 1)))


def _doubled(parents: DataFrame, starts: DataFrame, depth: int | None = None, most: DataFrame | None = None) -> DataFrame:
    """(node, step, ancestor) for steps from 1, each round twice as many as before, to the end or to ``depth``, and no
    further than ``most`` for nodes that have one."""
    hop = parents
    out = starts.distinct().select("node", F.lit(0).cast("long").alias("step"), F.col("node").alias("ancestor"))
    if most is not None:
        out = out.join(most, "node", "left")
    else:
        out = out.withColumn("most", F.lit(None).cast("long"))
    out, span = settle(out), 1
    while depth is None or span <= depth:
        more = _after(out, "ancestor", hop).select("node", (F.col("step") + span).alias("step"), F.col("next").alias("ancestor"), "most")
        more = settle(more.where("most is null or step <= most"))
        if more.isEmpty():
            break
        out, span = settle(out.union(more)), 2 * span
        if depth is None or span <= depth:
            hop = _twice(hop)
    out = out.where("step > 0").drop("most")
    return out if depth is None else out.where(F.col("step") <= depth)


def ancestors(parents: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, step, ancestor): the parent, its parent and so on of every node of ``starts``, each once.

    parents: (node, parent), one row a node; node may be a struct. A chain ends where a node has no row, where it would
    come to a node again (in a ring, or back at its start), or at ``depth``. Steps double, so a chain of a thousand takes
    ten rounds of equi-joins; each round is checkpointed. Up to SHORT steps a chain is walked though it may be in a ring:
    from the first node that comes again on all do, so the first coming of each is the chain.
    """
    parents = settle(parents.where("node is not null and parent is not null"))
    if depth is not None and depth <= SHORT:
        walked = _doubled(parents, starts, depth).where("node <> ancestor")
        return walked.groupBy("node", "ancestor").agg(F.min("step").alias("step")).select("node", "step", "ancestor")
    most = _closing(parents)
    return _doubled(parents, starts, depth, most)


def grounded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) of the nodes that rest on nothing, or on such nodes only: none on a ring, behind one, or behind a closed one.

    nodes: (node, open), once each; edges: (node, on), of which both ends are nodes. A round takes away the open nodes
    without edges, and every edge to them; and where a node's only edge leads to an open node with one edge only, it skips
    that one. So long chains shrink by half a round. A round that takes nothing away is the last: if any
    grounded node were left, one of them would have no edge.
    """
    opened = settle(nodes.where("open").select("node").distinct())
    edges = settle(edges.select("node", "on").distinct())
    left, done = opened, None
    while True:
        free = settle(left.join(edges.select("node").distinct(), "node", "left_anti"))
        done = free if done is None else done.union(free)
        if free.isEmpty():
            break
        left = settle(left.join(free, "node", "left_anti"))
        edges = settle(edges.join(free.withColumnRenamed("node", "on"), "on", "left_anti").select("node", "on"))
        single = edges.groupBy("node").agg(F.count("*").alias("n"), F.first("on").alias("on")).where("n = 1").join(opened, "node", "left_semi").select(F.col("node").alias("via"), F.col("on").alias("next"))
        mine = single.select(F.col("via").alias("node"), F.col("next").alias("via")).join(single, "via").select("node", F.col("next").alias("skip"))
        edges = settle(edges.join(mine, "node", "left").select("node", F.coalesce("skip", "on").alias("on")))
    return done.distinct()


def explain(receipts: DataFrame, obligations: DataFrame, asked: DataFrame, depth: int | None = 1) -> DataFrame:
    """(receipt_id, relation, step, target, found): what stands behind each decision asked for.

    receipts: receipt_id, parent_receipt_id, supersedes, obligations_created (list); obligations: obligation_id,
    source_receipt_id, superseded_receipt_id; asked: receipt_id. The last row of an id in either table is not defined:
    give one row an id. Relations: ``target`` (the decision itself), ``supersedes``, ``obligation`` (those it made, then
    those made of it or of what replaced it, each once), ``parent`` (up to ``depth`` steps, all if None). What is not there
    is kept with found = false: a chain's first missing parent, and with relation ``cycle`` the parent at which a chain
    comes to a node again.
    """
    asked = asked.select("receipt_id").where("receipt_id is not null").distinct()
    known = receipts.select("receipt_id", F.lit(True).alias("here"))
    mine = settle(asked.join(receipts.select("receipt_id", "supersedes", "obligations_created").withColumn("here", F.lit(True)), "receipt_id", "left"))
    row = lambda df, relation, step, target, found: df.select("receipt_id", F.lit(relation).alias("relation"), (F.lit(step) if isinstance(step, int) else step).cast("long").alias("step"), target.alias("target"), found.alias("found"))
    is_here = lambda c: F.coalesce(F.col(c), F.lit(False))
    target = row(mine, "target", 0, F.col("receipt_id"), is_here("here"))
    older = mine.where("supersedes <> ''").select("receipt_id", "supersedes").join(known.withColumnRenamed("receipt_id", "supersedes"), "supersedes", "left")
    supersedes = row(older, "supersedes", 1, F.col("supersedes"), is_here("here"))
    made = mine.where("here").select("receipt_id", F.explode("obligations_created").alias("obligation_id")).where("obligation_id is not null")
    made = made.join(obligations.select("obligation_id", F.lit(True).alias("here")), "obligation_id", "left")
    ends = [obligations.select(F.col(c).alias("receipt_id"), "obligation_id") for c in ("source_receipt_id", "superseded_receipt_id")]
    of = ends[0].union(ends[1]).distinct().join(mine.where("here").select("receipt_id"), "receipt_id", "left_semi").withColumn("here", F.lit(True))
    owed = row(made.select("receipt_id", "obligation_id", "here").union(of.select("receipt_id", "obligation_id", "here")).distinct(), "obligation", 1, F.col("obligation_id"), is_here("here"))
    parents = receipts.where("parent_receipt_id <> ''").select(F.col("receipt_id").alias("node"), F.col("parent_receipt_id").alias("parent"))
    starts = mine.where("here").select(F.col("receipt_id").alias("node"))
    chain = settle(ancestors(parents, starts, depth))
    chain = chain.select(F.col("node").alias("receipt_id"), "step", F.col("ancestor").alias("target")).join(known.withColumnRenamed("receipt_id", "target"), "target", "left")
    up = row(chain, "parent", F.col("step"), F.col("target"), is_here("here"))
    last = settle(starts.select(F.col("node").alias("receipt_id"), F.lit(0).cast("long").alias("step"), F.col("node").alias("target")).union(chain.where("here").select("receipt_id", "step", "target")).groupBy("receipt_id").agg(F.max(F.struct("step", "target")).alias("x")).select("receipt_id", "x.*"))
    more = last.join(parents.withColumnRenamed("node", "target"), "target").select("receipt_id", (F.col("step") + 1).alias("step"), F.col("parent").alias("target"))
    again = more.join(chain.where("here").select("receipt_id", "target", F.lit(True).alias("seen")).union(starts.select(F.col("node").alias("receipt_id"), F.col("node").alias("target"), F.lit(True).alias("seen"))).distinct(), ["receipt_id", "target"], "left_semi")
    again = again if depth is None else again.where(F.col("step") <= depth)
    cycle = row(again, "cycle", F.col("step"), F.col("target"), F.lit(False))
    return target.union(supersedes).union(owed).union(up).union(cycle)
