"""Cycles of steps beside a loop; only episodes that may hold one are peeled."""

import random
from unittest import mock

from tracewell.operators import decisions


def plain(steps, depends):
    out = set()
    for e in {s[0] for s in steps}:
        ids = [s[1] for s in steps if s[0] == e]
        edges = {(a, b) for x, a, b in depends if x == e}
        if len(set(ids)) < len(ids):
            out.add((e, "duplicate step"))
        if any(b not in ids for _, b in edges):
            out.add((e, "unknown dependency"))
        edges = {(a, b) for a, b in edges if b in ids}
        if not any(s[2] == "EMIT_OUTPUT" for s in steps if s[0] == e and s[1] not in {b for _, b in edges}):
            out.add((e, "no terminal output"))
        left = set(ids)
        while free := {x for x in left if not any(a == x and b in left for a, b in edges)}:
            left -= free
        if left:
            out.add((e, "cycle"))
    return out


def test_findings_beside_a_loop_and_few_steps_peeled(spark):
    draw = random.Random(5)
    steps, depends = [], []
    for e in range(120):
        n = draw.randint(1, 7)
        steps += [(e, i, "EMIT_OUTPUT") for i in range(n)]
        if e % 3 == 0:
            depends += [(e, draw.randrange(n), draw.randrange(n + 1)) for _ in range(draw.randint(0, n))]
        else:  # a chain down
            depends += [(e, i, i - 1) for i in range(1, n)]
    depends += [(200, 1, 1), (201, 3, 2), (201, 2, 3)]
    steps += [(200, 1, "CALL"), (201, 2, "CALL"), (201, 3, "EMIT_OUTPUT"), (201, 3, "EMIT_OUTPUT")]
    peel, asked = decisions.grounded, []

    def counted(nodes, edges):
        asked.append(nodes.count())
        return peel(nodes, edges)

    with mock.patch.object(decisions, "grounded", counted):
        found = decisions.step_graphs(spark.createDataFrame(steps, "episode_id long, step_id int, opcode string"), spark.createDataFrame(depends, "episode_id long, step_id int, on int"))
        assert {tuple(r) for r in found.collect()} == {x for x in plain(steps, depends)}
    assert sum(asked) < len({s[:2] for s in steps}) / 2


def test_a_step_without_id_is_no_cycle(spark):
    found = decisions.step_graphs(spark.createDataFrame([("a", None, "EMIT_OUTPUT"), ("a", 1, "CALL")], "episode_id string, step_id int, opcode string"), spark.createDataFrame([], "episode_id string, step_id int, on int"))
    assert found.where("finding = 'cycle'").count() == 0
