"""Call sites against Python's own parser, on small cases and on files of its library."""

import ast
import json
import os
import textwrap
from collections import Counter

from tracewell.operators import callsites


def dotted(node):
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Subscript):
        return dotted(node.value)
    if isinstance(node, ast.Attribute):
        left = dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr


def parsed(source):
    """All calls by the parser; those inside formatted strings are not asked for."""
    tree = ast.parse(source)
    inside = {id(n) for f in ast.walk(tree) if isinstance(f, ast.JoinedStr) for n in ast.walk(f)}
    return [(n.lineno, dotted(n.func)) for n in ast.walk(tree) if isinstance(n, ast.Call) and id(n) not in inside and dotted(n.func)]


CASES = {
    "chain.py": '''
        import openai
        r = (client  # a comment
             .chat.completions
             .create(model="m", messages=[{"role": "user", "content": "messages.create("}]))
        a = make()[0].llm.predict(x["a"](1))(2)
        b = table["k"].rows[i + f(1)].chat.completions.create(
            n=1)
        c = "x".join(d); e = [1, 2].count(1)
        g = (a or
             b).responses.create()
    ''',
    "strings.py": '''
        """client.messages.create( \\""" still inside"""
        x = 'it\\'s openai.chat.completions.create('  # client.messages.create(
        def query_model(q): return ask_llm(q)
        class LLM(Base): pass
        y = run_model \\
            .apply(1)
        @ask_llm("x")
        async def f(a=call_model(1)):
            await db.invoke(1)
            return (1)
    ''',
    "framed.py": '''
        from langchain_core.runnables import (  # several
            Runnable as R,
            chain)
        if x: import os, sys
        a = chain.invoke({"q": 1}).text.strip()
        b = db.ainvoke(1)
        c = ChatOpenAI(temperature=0).invoke(b)
        d = m.generate_content_async(1); e = litellm.acompletion(2)
    ''',
    "marked.py": "from .receipts import emit_receipt\nllm.predict(1)\nclient.messages.create()\n",
    "called.py": "store.emit_receipt(1)\nclient.messages.create()\n",
    "package.py": "import tracewell.integrations.openai as t\nclient.messages.create()\n",
    "broken.py": "client.messages.create(\n",
    "quote.py": "x = 'abc\nclient.messages.create()\n",
    "empty.py": "",
    "crlf.py": "x = 1\r\nclient.messages.create()\r\n",
}
FILES = [("r", p, textwrap.dedent(s)) for p, s in CASES.items()]
SCHEMA = "repo string, path string, content string"


def test_all_calls_as_the_parser(spark):
    here = os.path.dirname(json.__file__)
    library = [os.path.join(d, n) for d in (here, os.path.join(here, "..", "http"), os.path.join(here, "..", "email"), os.path.join(here, "..", "asyncio")) for n in sorted(os.listdir(d)) if n.endswith(".py")]
    files = FILES + [("lib", p, open(p, encoding="utf-8").read()) for p in library]
    got = Counter(map(tuple, callsites.all_calls(spark.createDataFrame(files, SCHEMA)).collect()))
    want = Counter((r, p, *c) for r, p, s in files if p not in ("broken.py", "quote.py") for c in parsed(s))
    assert len(want) > 3000
    assert got == want, (list((got - want).items())[:8], list((want - got).items())[:8])


def test_scan(spark):
    rows = callsites.scan(spark.createDataFrame(FILES, SCHEMA)).collect()
    got = {(r.path, r.line, r.call): (r.confidence, r.framework, r.instrumented, r.provider) for r in rows}
    assert len(got) == len(rows)
    assert got == {
        ("chain.py", 3, "client.chat.completions.create"): ("high", "openai", False, "openai"),
        ("chain.py", 7, "table.rows.chat.completions.create"): ("high", "openai", False, "openai"),
        ("chain.py", 10, "responses.create"): ("high", "openai", False, "other"),
        ("strings.py", 4, "ask_llm"): ("low", "", False, "other"),
        ("strings.py", 8, "ask_llm"): ("low", "", False, "other"),
        ("strings.py", 9, "call_model"): ("low", "", False, "other"),
        ("framed.py", 6, "chain.invoke"): ("medium", "langchain", False, "langchain"),
        ("framed.py", 7, "db.ainvoke"): ("medium", "langchain", False, "langchain"),
        ("framed.py", 8, "ChatOpenAI"): ("medium", "langchain", False, "openai"),
        ("framed.py", 9, "m.generate_content_async"): ("high", "google", False, "other"),
        ("framed.py", 9, "litellm.acompletion"): ("medium", "litellm", False, "litellm"),
        ("marked.py", 3, "client.messages.create"): ("high", "anthropic", True, "anthropic"),
        ("called.py", 2, "client.messages.create"): ("high", "anthropic", True, "anthropic"),
        ("package.py", 2, "client.messages.create"): ("high", "anthropic", True, "anthropic"),
        ("crlf.py", 2, "client.messages.create"): ("high", "anthropic", False, "anthropic"),
    }
    fixes = {r.call: r.fix for r in rows if not r.instrumented}
    assert fixes["client.messages.create"].startswith("from tracewell.integrations.anthropic")
    assert fixes["ChatOpenAI"].startswith("from tracewell.integrations.langchain")
    assert fixes["ask_llm"].startswith("from tracewell import emit_receipt")
    assert all(r.fix is None for r in rows if r.instrumented)


def test_repeated_null_long_and_empty(spark):
    long = "x = '" + "\\n" * 200_000 + "'\n" + "client.messages.create()\n"
    files = [("r", "a.py", long), ("r", "a.py", long), ("r", "b.py", None), (None, None, "client.messages.create()")]
    got = sorted(map(str, callsites.scan(spark.createDataFrame(files, SCHEMA)).select("repo", "path", "line").collect()))
    assert got == ["Row(repo='r', path='a.py', line=2)", "Row(repo=None, path=None, line=1)"]
    assert callsites.scan(spark.createDataFrame([], SCHEMA)).count() == 0
