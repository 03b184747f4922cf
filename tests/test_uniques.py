"""What has no partner."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidyspark import queries
from tidyspark.operators import records, sieve
from tidyspark.plans import parsing
from tidyspark.plans.config import Config


def rows(spark, pairs, **fields):
    df = spark.createDataFrame([(p, c, i) for i, (p, c) in enumerate(pairs)], "path string, content string, i long")
    return records.as_records(df, F.col("path"), F.col("content"), **fields)


def test_partners_with_the_same_tag_are_partners(spark):
    """Copies that are all tagged are no group of the result with all tagged ones kept, and yet not unique."""
    df = rows(spark, [("t/1", "x"), ("t/2", "x"), ("t/3", "own"), ("u/4", "other")], is_tagged=F.startswith(F.col("path"), F.lit("t/")))
    for how, of_t in (({"keep_all_tagged": True}, True), ({"keep_all_untagged": True}, False)):
        got = {(r.path, r.is_original) for r in sieve.uniques(df, Config(**how)).select("path", "is_original").collect()}
        assert got == {("t/3", of_t), ("u/4", not of_t)}


@pytest.mark.parametrize("unfinished", [False, True])
def test_what_is_not_compared_is_not_unique(spark, unfinished):
    """A null content, but for one with a cached checksum, and a slice that is empty."""
    fields = {"size": F.coalesce(F.octet_length("content"), F.lit(3)), "cached_checksum": F.when(F.col("path") == "cached", F.lit("c0ffee"))}
    df = rows(spark, [("a", "xx"), ("b", "xx"), ("own", "yyyy"), ("unread", None), ("cached", None)], **fields)
    got = {r.path for r in sieve.uniques(df, Config(write_unfinished=unfinished)).collect()}
    assert got == {"own", "cached"}
    got = {r.path for r in sieve.uniques(df, Config(write_unfinished=unfinished, clamp_low=parsing.clamp("2"))).collect()}
    assert got == {"own", "cached"}


ODD = [(0, "own", "en", "src0"), (1, "twice", "en", "src0"), (2, "twice", "de", "src3"), (3, "", "en", "src1"), (4, None, "de", "src2"), (5, None, "fr", "src0"), (6, " ", None, "src4"), (7, "\n", "fr", None)]


def against_sql(spark, folder, name, documents):
    """Rows of a query and of its SQL over some documents."""
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    found, want = queries.QUERIES[name](spark, str(folder)), base.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    return sorted(map(tuple, found.select(*columns).collect())), sorted(want.fetchall())


@pytest.mark.parametrize("name", ["unique_documents", "uniques_sink_documents"])
def test_documents_without_a_text_are_not_unique(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, ODD)
    assert got == want and len(got) == 3
