"""Calls of language models in Python sources, found in Spark columns over token tables; no parser runs in a task.

A file's text becomes one row per token; depth of brackets, line numbers and chains of attributes are running windows
over a file's tokens. Files are shuffled once, as texts, and every window keeps that partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a dotted call holds, its confidence and framework; the first that fits counts.
PATTERNS = (
    ("chat.completions.create", "high", "openai"),
    ("completions.create", "high", "openai"),
    ("responses.create", "high", "openai"),
    ("messages.create", "high", "anthropic"),
    ("chat_completions.create", "high", "openai"),
    ("generate_content", "high", "google"),
    ("generate_content_async", "high", "google"),
    ("ChatOpenAI", "medium", "langchain"),
    ("ChatAnthropic", "medium", "langchain"),
    ("litellm.completion", "medium", "litellm"),
    ("litellm.acompletion", "medium", "litellm"),
)
# These count, with medium confidence, only in files that import a framework.
GUARDED = (".invoke", ".ainvoke", "llm.predict", "llm.apredict")
FRAMEWORKS = ("langchain", "langgraph", "llama_index", "litellm", "google.generativeai", "langchain_core", "langchain_community", "langchain_openai", "langchain_anthropic", "llama_index.core")
# Names of functions that are called with low confidence.
NAMES = ("llm_call", "call_llm", "query_model", "call_model", "generate_response", "chat_completion", "model_inference", "run_model", "ask_llm", "prompt_model")
# Providers with an integration, and names whose import or call marks a file as instrumented.
INTEGRATIONS = ("openai", "anthropic", "langchain", "google", "litellm")
EMITTERS = ("emit_receipt",)
# Parts of a lower-cased call that tell its provider; the first row that fits counts.
PROVIDERS = (
    ("openai", ("openai", "chat.completions", "chatopenai")),
    ("anthropic", ("anthropic", "messages.create", "chatanthropic")),
    ("litellm", ("litellm",)),
    ("langchain", (".invoke", ".ainvoke", "llm.predict", "llm.apredict", "chain.", "agent.", "retriever.", "parser.", "prompt.", "model.invoke", "model.ainvoke")),
)

KEYWORDS = "and as assert async await break case class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False".split()
_NAME = r"[^\W\d]\w*+"
_GAP = r"(?:\s++|#[^\n]*+\n|\\\n)*+"
_CHAIN = rf"(?:(?<!\w)|(?=\.))(?:\.{_GAP})?{_NAME}(?:{_GAP}\.{_GAP}{_NAME})*+"
_REST = r"(?:[^\n;#\\]++|\\[\s\S])*+"
#: All loops are possessive: linear in the text, and without recursion.
TOKENS = "(?U)" + "|".join(
    (
        r'(?<!\w)[rbufRBUF]{0,2}"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""',
        r"(?<!\w)[rbufRBUF]{0,2}'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''",
        r'(?<!\w)[rbufRBUF]{0,2}"(?:[^"\\\n]++|\\[\s\S])*+"',
        r"(?<!\w)[rbufRBUF]{0,2}'(?:[^'\\\n]++|\\[\s\S])*+'",
        r"#[^\n]*+",
        r"\\\n",
        r"\n",
        rf"(?<![\w.])from[ \t]++[.\w]++[ \t]++import\b[ \t]*+(?:\([^)]*+\)|{_REST})",
        rf"(?<![\w.])import[ \t]++{_REST}",
        rf"(?<![\w.])(?:def|class)[ \t]++{_NAME}[ \t]*+[(\[]",
        rf"{_CHAIN}(?:[ \t]*+[(\[])?",
        r"\d[\w.]*+",
        r"[\[({]",
        r"[\])}]",
        r"\"|'",
        r"[^\s\w\"'#()\[\]{}.\\]++",
        r"\S",
    )
)


def _any(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def _tokens(files: DataFrame, key: list[str]) -> DataFrame:
    """One row per token of each file, with its kind, the bracket depth it stands at and its first line.

    An opening bracket and the one that closes it stand at the same depth. Line ends within brackets, comments and
    joined lines count for lines only and go."""
    t = F.col("t")
    token = files.select(*key, F.posexplode(F.regexp_extract_all("content", F.lit(TOKENS), F.lit(0))).alias("at", "t"))
    first, last = F.substring(t, 1, 1), F.right(t, F.lit(1))
    string = t.rlike("^[rbufRBUF]{0,2}[\"']")
    kind = (
        F.when(string & (F.length(t) > 1), "string").when(string, "bad").when(first == "#", "space").when(t == "\\\n", "space").when(t == "\n", "end")
        .when(t.rlike(r"(?U)^(?:from|import)[ \t]+[\w.]"), "import").when(last.isin("(", "[", "{"), "open").when(last.isin(")", "]", "}") & (F.length(t) == 1), "close").otherwise("other")
    )
    token = token.withColumn("kind", kind)
    order = Window.partitionBy(*key).orderBy("at")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    opened, closed = F.when(F.col("kind") == "open", 1).otherwise(0), F.when(F.col("kind") == "close", 1).otherwise(0)
    token = token.withColumn("line", 1 + F.coalesce(F.sum(lines).over(before), F.lit(0))).withColumn("depth", F.sum(opened - closed).over(upto) - opened)
    whole = Window.partitionBy(*key)
    broken = (F.min("depth").over(whole) < 0) | (F.sum(opened - closed).over(whole) != 0) | F.max(F.col("kind") == "bad").over(whole)
    token = token.withColumn("broken", broken)
    return token.where(~F.col("broken") & (F.col("kind") != "space") & ~((F.col("kind") == "end") & (F.col("depth") > 0))).drop("broken")


def _calls(token: DataFrame, key: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Opening brackets with `call`, the dotted name called there (null elsewhere), and `line` of the expression's start.

    What follows a closed call, or brackets without a name, begins a name anew; a subscript in between is passed over.
    All other tokens go before anything is sorted again."""
    t = F.col("t")
    order = Window.partitionBy(*key).orderBy("at")
    token = token.withColumn("was", F.lag("kind").over(order))
    # adjacent strings are one, from the first one's line
    begun = F.when((F.col("kind") == "string") & (F.coalesce("was", F.lit("")) != "string"), F.col("line"))
    token = token.withColumn("string_line", F.last(begun, True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    names = F.regexp_replace(F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - 1), r"#[^\n]*", ""), r"(?U)[\s\\]+", "")
    names = F.regexp_replace(names, r"^\.", "")
    plain = ~t.rlike(r"(?U)^(?:def|class)[ \t]+\w") & (names != "") & ~names.isin(*KEYWORDS)
    goes_on = F.coalesce((F.col("was") == "close") & (F.startswith(t, F.lit(".")) | t.isin("(", "[")), F.lit(False))
    start = F.when(F.startswith(t, F.lit(".")) & (F.col("was") == "string"), F.col("string_line")).otherwise(F.col("line"))
    opens = token.where("kind = 'open'").select(*key, *carry, "at", "depth", F.when(plain, names).alias("names"), goes_on.alias("goes_on"), start.alias("start"), (F.right(t, F.lit(1)) == "(").alias("round"))
    # openers of one depth, in order: a chain follows itself without a gap there
    level = Window.partitionBy(*key, "depth").orderBy("at")
    upto = level.rowsBetween(Window.unboundedPreceding, 0)
    opens = opens.withColumn("line", F.last(F.when(~F.col("goes_on"), F.col("start")), True).over(upto))
    anew = ~F.col("goes_on") | F.lag("round").over(level)
    opens = opens.withColumn("part", F.sum(F.when(anew, 1).otherwise(0)).over(upto)).drop("goes_on", "start")
    piece = Window.partitionBy(*key, "depth", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    name = F.array_join(F.collect_list("names").over(piece), ".")
    return opens.withColumn("call", F.when(F.col("round"), F.nullif(name, F.lit("")))).drop("names", "round", "part")


#: A file's tokens take many times its text, so files are dealt over so many times the partitions of a shuffle,
#: a number that Spark does not make smaller by the size of the texts.
SPREAD = 4


def _distinct(files: DataFrame) -> tuple[DataFrame, list[str]]:
    key = ["repo", "path", "digest"]
    text = F.regexp_replace("content", "\r\n?", "\n")
    rows = files.where("content is not null").select("repo", "path", text.alias("content"), F.unhex(F.sha2(F.col("content").cast("string"), 256)).alias("digest"))
    parts = SPREAD * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *key).distinct(), key


def all_calls(files: DataFrame) -> DataFrame:
    """(repo, path, line, call) of every call of a dotted name in Python files (repo, path, content).

    A call begins where its expression does, so a chain over several lines is at the first. Null texts have no calls;
    a file given twice with one content counts once. Files whose brackets or quotes do not close have none; other errors of
    syntax go unnoticed. Calls within the braces of formatted strings are not seen."""
    rows, key = _distinct(files)
    return _calls(_tokens(rows, key), key).where("call is not null").select("repo", "path", "line", "call")


def suggested_fix(call: Column, package: str) -> Column:
    """The line that would instrument a call, by what its name holds; integrations live in the given package."""
    c = F.lower(call)
    use = lambda name: F.lit(f"from {package}.integrations.{name} import patch; patch()")
    return (
        F.when(F.contains(c, F.lit("langchain")) | F.startswith(c, F.lit("chatopen")) | F.startswith(c, F.lit("chatanthropic")), f"from {package}.integrations.langchain import CallbackHandler  # pass callbacks=[CallbackHandler()]")
        .when(_any(c, ("openai", "chat.completions", "completions.create", "responses.create")), use("openai"))
        .when(_any(c, ("anthropic", "messages.create")), use("anthropic"))
        .otherwise(f"from {package} import emit_receipt  # add emit_receipt() after this call")
    )


def provider(call: Column) -> Column:
    """The provider that a call's name tells: openai, anthropic, litellm, langchain or other."""
    out = F.lit(None).cast("string")
    for name, parts in PROVIDERS:
        out = F.coalesce(out, F.when(_any(F.lower(call), parts), name))
    return F.coalesce(out, F.lit("other"))


def scan(files: DataFrame, package: str = "tracewell") -> DataFrame:
    """(repo, path, line, call, confidence, framework, instrumented, fix, provider) of calls of language models.

    files: repo, path, content. Direct calls have high confidence, framework calls medium, names alone low (no framework:
    an empty string). A file is instrumented if it imports an integration of ``package`` or imports or calls an emitter, anywhere
    in it; its calls then need no fix (null). Files that hold no part of any pattern are left before they are split into tokens;
    otherwise as `all_calls`."""
    parts = sorted({p.split(".")[-1] for p, _, _ in PATTERNS} | {g.split(".")[-1] for g in GUARDED} | set(NAMES))
    rows, key = _distinct(files.where(F.col("content").rlike("(?i)" + "|".join(parts))))
    token = _tokens(rows, key)
    text = F.regexp_replace(F.regexp_replace("t", r"#[^\n]*", ""), r"\\\n", " ")
    module = F.regexp_replace(F.regexp_extract(text, r"(?U)^from[ \t]+([.\w]+)", 1), r"^\.+", "")
    named = lambda tail: F.regexp_extract_all(tail, F.lit(r"(?U)([\w.*]+)(?:\s+as\s+\w+)?"), F.lit(1))
    from_ = F.startswith("t", F.lit("from"))
    imported = F.when(from_, named(F.regexp_replace(text, r"(?U)^from[ \t]+[.\w]+[ \t]+import\b", ""))).otherwise(named(F.regexp_replace(text, r"^import\b", "")))
    full = F.transform(imported, lambda n: F.when(from_ & (module != ""), F.concat(module, F.lit("."), n)).otherwise(n))
    marks = (*EMITTERS, *(f"{package}.integrations.{i}" for i in INTEGRATIONS))
    under = lambda n: n.rlike("^(?:" + "|".join(f.replace(".", r"\.") for f in FRAMEWORKS) + r")(?:\.|$)")
    is_import = F.col("kind") == "import"
    whole = Window.partitionBy(*key)
    marked = is_import & F.exists(full, lambda n: _any(n, marks))
    framed = is_import & F.when(from_, under(module)).otherwise(F.exists(imported, under))
    token = token.withColumn("marked", F.max(marked).over(whole)).withColumn("framed", F.max(framed).over(whole))
    token = _calls(token, key, ("marked", "framed")).where("call is not null")
    last = F.element_at(F.split("call", r"\."), -1)
    found = F.lit(None).cast("struct<confidence:string,framework:string>")
    for p, confidence, framework in PATTERNS:
        found = F.coalesce(found, F.when(F.contains("call", F.lit(p)), F.struct(F.lit(confidence).alias("confidence"), F.lit(framework).alias("framework"))))
    guarded = F.struct(F.lit("medium").alias("confidence"), F.lit("langchain").alias("framework"))
    low = F.struct(F.lit("low").alias("confidence"), F.lit("").alias("framework"))
    found = F.when(found.isNotNull(), found).when(_any(F.col("call"), GUARDED), F.when(F.col("framed"), guarded)).when(F.lower(last).isin(*NAMES), low)
    emits = F.coalesce(last.isin(*EMITTERS), F.lit(False))
    # only calls that are told, or that mark their file, are sorted by file again
    out = token.withColumn("found", found).withColumn("emits", emits).where("found is not null or emits")
    out = out.withColumn("instrumented", F.max(F.col("marked") | F.col("emits")).over(whole)).where("found is not null")
    return out.select("repo", "path", "line", "call", "found.confidence", "found.framework", "instrumented", F.when(~F.col("instrumented"), suggested_fix(F.col("call"), package)).alias("fix"), provider(F.col("call")).alias("provider"))
