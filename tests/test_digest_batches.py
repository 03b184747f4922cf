"""Digests taken in Python."""

from pyspark.sql import functions as F

from tidyspark.functions import digests


def test_values_are_hashed_where_they_lie(spark):
    """Digests outside the JVM: no copy of a batch, and null, empty and long values."""
    df = spark.createDataFrame([(None,), ("",), ("ab",), ("x" * 100_000,)], "content string").coalesce(1)
    for name in ("blake2s", "sha3-256", "blake2bp", "cumulative", "blake2b-chain"):
        told = df.select("content", digests.digest(F.col("content"), name).alias("d"))
        assert "ArrowEvalPython" in told._sc._jvm.PythonSQLUtils.explainString(told._jdf.queryExecution(), "simple") and "pandas" not in digests.__dict__ and "pd" not in digests.__dict__
        for r in told.collect():
            assert r.d == (None if r.content is None else digests.xor_words(r.content.encode()) if name == "cumulative" else digests.streamed([r.content.encode()], name))
