from pyspark.sql import functions as F

from tracewell.operators import evidence


def test_a_pointer_takes_no_schema(spark):
    df = spark.createDataFrame([('{"a":[{"0":5},null]}', "a.0.0"), ('{"a":[{"0":5},null]}', "a.1"), ('{"a":[{"0":5},null]}', "0"), ("[[]]", "0"), ("[[]]", "0.0"), ("3", "0"), (None, "a")], "raw string, pointer string").coalesce(1)
    found = df.select(evidence.resolve_pointer(F.try_parse_json("raw"), F.col("pointer")).alias("v"))
    assert "schema" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r[0] for r in found.select(F.to_json("v")).collect()] == ["5", "null", None, "[]", None, None, None]
