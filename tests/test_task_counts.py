"""A task's share of the rows doesn't grow with the input, whatever number of shuffle partitions the session has."""

import pytest
from pyspark.sql import functions as F

from tidyspark.operators import directories, rank, records, sieve, stage
from tidyspark.plans import requery
from tidyspark.plans.config import Config

PARTITIONS = "spark.sql.shuffle.partitions"


@pytest.fixture(autouse=True)
def _every_partition_is_a_task(spark, monkeypatch):
    """And a task is asked for by 2 KB, not by megabytes."""
    monkeypatch.setattr(stage, "TASK_BYTES", 2000, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.conf.get(PARTITIONS) == "4"


def table(spark, folder, n):
    spark.range(n).select(F.format_string("o/%04d/%d", F.floor(F.col("id") / 3), F.col("id") % 3).alias("path"), F.sha2((F.col("id") % 7).cast("string"), 256).alias("content"), F.sha2(F.col("id").cast("string"), 256).alias("weight")).write.parquet(f"{folder}/{n}")
    return spark.read.parquet(f"{folder}/{n}")


def test_rows_of_a_task_stay_with_a_larger_input(spark, tmp_path):
    def most(n):
        grouped = table(spark, tmp_path, n).groupBy("path").agg(F.max("weight")).withColumn("task", F.spark_partition_id())
        return stage.once(grouped).groupBy("task").count().agg(F.max("count")).first()[0]

    assert most(8000) < 2 * most(1000)


def test_settings_come_back(spark, tmp_path):
    df = table(spark, tmp_path, 2000)
    old = {name: spark.conf.get(name) for name in (PARTITIONS, *stage.TASK_READS)}
    with pytest.raises(ZeroDivisionError), stage.fitted(df):
        assert int(spark.conf.get(PARTITIONS)) == stage.tasks(df) > 4 and spark.conf.get("spark.sql.files.maxPartitionBytes") == str(1 << 23)
        raise ZeroDivisionError
    assert old == {name: spark.conf.get(name) for name in old}
    spark.conf.set(PARTITIONS, "1000")
    with stage.fitted(df):
        assert spark.conf.get(PARTITIONS) == "1000"
    spark.conf.set(PARTITIONS, "4")
    assert [stage._bytes(text) for text in ("64MB", "67108864b", "16m", "512", "what")] == [1 << 26, 1 << 26, 1 << 24, 512, float("inf")]


def test_packed_directories_are_dealt_by_their_input_and_stay_the_same(spark, tmp_path, monkeypatch):
    cfg, counts, made = Config(rank="a"), [], stage.once
    source = table(spark, tmp_path, 3000)
    files = records.as_records(source, F.col("path"), F.col("content"))

    def told():
        result = made(sieve.duplicates(files, cfg))
        return sorted(map(tuple, requery.packed(files.drop("content"), result, cfg).select("dir", "n_children", "twins", "rank_in_group").collect()))

    got = told()
    signatures = lambda df, name="stage": counts.append(len(found.inputFiles())) or found if (found := made(df, name)) and name == "signatures" else found
    monkeypatch.setattr(directories, "once", signatures)
    assert told() == got and len(got) == 1000 and counts and counts[0] > 4
    monkeypatch.setattr(stage, "TASK_BYTES", 1 << 22, raising=False)
    assert told() == got and counts[1] <= 4


def test_groups_are_ranked_by_as_many_tasks_as_the_members_ask_for(spark, tmp_path):
    members = stage.once(table(spark, tmp_path, 3000).withColumn("group", F.substring("path", 1, 6)))
    ranked = rank.numbered(members, ["group"], F.struct("weight"), members)
    assert ranked.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert ranked.count() == 3000 and ranked.filter("rank_in_group = 1").count() == members.select("group").distinct().count()
