import re

from tidyspark.llm import jaccard_join, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return spark.createDataFrame([(d, f"a{d % 7} b{d} c d e f g", "aa", f"s{d % 3}", 20) for d in range(60)], SCHEMA)


def test_the_mix_is_joined_from_written_tables(spark):
    """The driver holds what a plan sends out at once: the last plan of the mix has the exchanges of one join and of the order, and broadcasts nothing."""
    mixed = mixing.mixed_documents(documents(spark))
    assert len(re.findall(r"\bExchange ", plan(mixed))) <= 4 and "Broadcast" not in plan(mixed)
    assert {x.doc_id for x in mixed.collect()} <= set(range(60)) and mixed.count() >= 60


def test_what_is_kept_is_joined_from_a_written_table(spark):
    kept = jaccard_join.kept_documents(documents(spark))
    assert len(re.findall(r"\bExchange ", plan(kept))) <= 10
    assert kept.count() == 60
