"""Registered queries: orders as Python sources, whose items are lines of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callsites
from .views import table

#: Lines of code by part; all other parts give a plain line.
LINES = (
    "from langchain_core.messages import HumanMessage, AIMessage",
    'r = client.chat.completions.create(model="m")',
    "s = 1  # client.messages.create(x)",
    'x = chain.invoke({"q": "llm.predict("})',
    "y = litellm.completion(m)",
    "z = parse(Query_Model(q))",
    'print("openai.messages.create(")',
    "w = agents[0].llm.predict(t); v = ChatOpenAI(temperature=0)",
    "out = genai.generate_content(p)  # db.invoke(",
    "m = anthropic.Client().messages.create(a)",
    "import os, litellm.utils as u",
    "k = store.responses.create(db.ainvoke(b))",
)


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are repositories, their orders files; few files import an integration."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    p = F.col("l_partkey")
    code = F.element_at(F.array(*map(F.lit, LINES)), (p % 24 + 1).cast("int"))
    code = F.when(p % 24 < len(LINES), code).when(p % 120 == 119, "import tracewell.integrations.openai").when(p % 120 == 95, 'emit_receipt("model_call", {})').otherwise(F.concat(F.lit("n = f("), p, F.lit(")")))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", code.alias("code"))))
    text = i.groupBy("l_orderkey").agg(F.array_join(lines.code, "\n").alias("content"))
    files = text.join(o, text.l_orderkey == o.o_orderkey).select(F.concat(F.lit("c"), "o_custkey").alias("repo"), F.concat(F.lit("src/f"), "o_orderkey", F.lit(".py")).alias("path"), "content")
    return callsites.scan(files)


QUERIES = {f.__name__: f for f in (call_sites,)}
_CODE = " ".join(f"WHEN {n} THEN '{line}'" for n, line in enumerate(LINES))
_PATTERNS = ", ".join(f"({n}, '{p}', '{c}', '{f}')" for n, (p, c, f) in enumerate(callsites.PATTERNS))
ORACLES = {
    "call_sites": rf"""
WITH pat(n, p, confidence, framework) AS (VALUES {_PATTERNS}
), l AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS line,
    CASE WHEN l_partkey % 24 < {len(LINES)} THEN CASE l_partkey % 24 {_CODE} END WHEN l_partkey % 120 = 119 THEN 'import tracewell.integrations.openai' WHEN l_partkey % 120 = 95 THEN 'emit_receipt("model_call", {{}})' ELSE 'n = f(' || l_partkey || ')' END AS raw FROM lineitem
), b AS (
  SELECT *, regexp_replace(regexp_replace(raw, '"[^"]*"', '""', 'g'), '#.*', '') AS t FROM l
), f AS (
  SELECT k, bool_or(regexp_matches(t, '^import .*tracewell\.integrations\.(openai|anthropic|langchain|google|litellm)') OR regexp_matches(t, '\bemit_receipt\(')) AS instrumented,
    bool_or(regexp_matches(t, '^from (langchain|langgraph|llama_index|litellm|langchain_core)(\.\w+)* import ') OR regexp_matches(t, '^import (.*, *)?(langchain|langgraph|llama_index|litellm)\b')) AS framed FROM b GROUP BY k
), c AS (
  SELECT k, line, regexp_replace(unnest(regexp_extract_all(t, '([A-Za-z_][\w.\[\]]*|\.[\w.]+)\(', 1)), '\[\d*\]|^\.', '', 'g') AS call FROM b
), m AS (
  SELECT c.*, instrumented, (SELECT min(n) FROM pat WHERE contains(call, p)) AS n, CASE WHEN contains(call, '.invoke') OR contains(call, '.ainvoke') OR contains(call, 'llm.predict') THEN CASE WHEN framed THEN 'medium' END
    WHEN lower(string_split(call, '.')[-1]) IN ('query_model', 'ask_llm', 'call_llm') THEN 'low' END AS other FROM c JOIN f USING (k)
), r AS (
  SELECT k, line, call, instrumented, coalesce(pat.confidence, other) AS confidence, coalesce(pat.framework, CASE other WHEN 'medium' THEN 'langchain' ELSE '' END) AS framework, lower(call) AS x FROM m LEFT JOIN pat USING (n)
)
SELECT 'c' || o_custkey AS repo, 'src/f' || k || '.py' AS path, line, call, confidence, framework, instrumented,
  CASE WHEN instrumented THEN NULL WHEN contains(x, 'langchain') OR starts_with(x, 'chatopen') THEN 'from tracewell.integrations.langchain import CallbackHandler  # pass callbacks=[CallbackHandler()]' WHEN regexp_matches(x, 'openai|completions\.create|responses\.create') THEN 'from tracewell.integrations.openai import patch; patch()'
    WHEN regexp_matches(x, 'anthropic|messages\.create') THEN 'from tracewell.integrations.anthropic import patch; patch()' ELSE 'from tracewell import emit_receipt  # add emit_receipt() after this call' END AS fix,
  CASE WHEN regexp_matches(x, 'openai|chat\.completions') THEN 'openai' WHEN regexp_matches(x, 'anthropic|messages\.create') THEN 'anthropic' WHEN contains(x, 'litellm') THEN 'litellm' WHEN regexp_matches(x, '\.a?invoke|llm\.predict|(chain|agent|retriever|parser|prompt)\.') THEN 'langchain' ELSE 'other' END AS provider
FROM r JOIN orders ON o_orderkey = k WHERE confidence IS NOT NULL
""",
}
