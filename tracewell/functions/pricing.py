"""Model prices in USD for a million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (model prefix, input, output), tried in this order.
PRICES = [
    ("gpt-4o", 2.50, 10.0),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4-turbo", 10.0, 30.0),
    ("gpt-4", 30.0, 60.0),
    ("gpt-3.5-turbo", 0.50, 1.50),
    ("o1", 15.0, 60.0),
    ("o1-mini", 3.0, 12.0),
    ("o3-mini", 1.10, 4.40),
    ("claude-opus-4", 15.0, 75.0),
    ("claude-sonnet-4", 3.0, 15.0),
    ("claude-3-opus", 15.0, 75.0),
    ("claude-3-sonnet", 3.0, 15.0),
    ("claude-3-haiku", 0.25, 1.25),
    ("claude-3-5-sonnet", 3.0, 15.0),
    ("claude-3-5-haiku", 0.80, 4.0),
    ("deepseek-chat", 0.28, 0.42),
    ("deepseek-reasoner", 0.28, 0.42),
    ("gemini-2.0-flash", 0.10, 0.40),
    ("gemini-1.5-pro", 1.25, 10.0),
    ("gemini-1.5-flash", 0.30, 2.50),
    ("mistral-large-latest", 0.50, 1.50),
    ("mistral-small-latest", 0.10, 0.30),
    ("llama-3.1-70b-versatile", 0.59, 0.79),
    ("llama-3.1-8b-instant", 0.05, 0.08),
    ("llama-3.3-70b-versatile", 0.59, 0.79),
    ("meta-llama/Meta-Llama-3.1-405B-Instruct-Turbo", 3.50, 3.50),
    ("meta-llama/Meta-Llama-3.1-70B-Instruct-Turbo", 0.88, 0.88),
    ("command-r-plus", 2.50, 10.0),
    ("command-r", 0.50, 1.50),
]
DEFAULT = (10.0, 30.0)


def prices(spark: SparkSession, rows: list = PRICES) -> DataFrame:
    """(ord, prefix, price_in, price_out)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, prefix string, price_in double, price_out double")


def price(model: Column, rows: list = PRICES) -> tuple[Column, Column]:
    """Input and output price: of the exact name, else of the first prefix in order, else the default.

    A chain of comparisons, so that pricing needs neither a join nor a shuffle.
    """
    out = []
    for k in (1, 2):
        chain = None
        for r in rows:
            chain = F.when(model == r[0], r[k]) if chain is None else chain.when(model == r[0], r[k])
        for r in rows:
            chain = chain.when(F.startswith(model, F.lit(r[0])), r[k])
        out.append(chain.otherwise(DEFAULT[k - 1]))
    return out[0], out[1]


def cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Cost of a call in USD."""
    a, b = price(model)
    return input_tokens / 1_000_000 * a + output_tokens / 1_000_000 * b
