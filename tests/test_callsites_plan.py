"""Call sites: files are shuffled once, by a number of partitions that stays, and whole token tables are sorted once."""

from tracewell.operators import callsites


def test_tokens_are_sorted_once(spark):
    files = spark.createDataFrame([("r", "a.py", "x = openai.chat.completions.create(m)")], "repo string, path string, content string")
    plan = callsites.scan(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan and "SortAggregate" not in plan
    # tokens by file; opening brackets, without their texts, by depth and by part of a chain
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert len(sorts) == 3, sorts


def test_emitter_behind_a_subscript_marks_its_file_twice_given(spark):
    text = "emit_receipt[0](x)\ny = litellm.completion(m)\nz = (\n  a.b(c)\n)[1].messages.create(q)\n"
    other = "y = litellm.completion(m)\n"
    rows = [("r", "a.py", text), ("r", "a.py", text), ("r", "a.py", other), ("r", "b.py", "import tracewell.integrations.openai\n" + other), ("r", "c.py", "call_llm(")]
    got = sorted(tuple(x) for x in callsites.scan(spark.createDataFrame(rows, "repo string, path string, content string")).select("path", "line", "call", "instrumented").collect())
    assert got == [("a.py", 1, "litellm.completion", False), ("a.py", 2, "litellm.completion", True), ("a.py", 3, "messages.create", True), ("b.py", 2, "litellm.completion", True)]
