"""Groups that hold a large share of all rows: nothing deals them by their key, and what is told of them is the same."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidyspark.functions import digests
from tidyspark.operators import directories, rank, records, relations, sieve, stage
from tidyspark.plans.config import Config


def rows(spark, pairs, **fields):
    df = spark.createDataFrame([(p, c, i) for i, (p, c) in enumerate(pairs)], "path string, content string, i long")
    return records.as_records(df, F.col("path"), F.col("content"), **fields)


TREE = [(f"o/{i:03}/{k}", "ab"[(i // 7 + k) % 2]) for i in range(120) for k in range(1 + i % 3)] + [(f"{top}/{d}/{k}", f"{d} {k // 2}") for top in "xy" for d in "pqp2" for k in range(4)] + [("z/one", "single")]


def dealt_by(spark, monkeypatch, run):
    """Plans that the run wrote tables of, and the one that it returned, with joins by broadcast only where they are asked for."""
    plans = []
    explain = lambda df: plans.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
    made = stage.once

    def explained(df, name="stage"):
        explain(df)
        return made(df, name)

    for module in (rank, sieve, directories):
        monkeypatch.setattr(module, "once", explained)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        explain(run())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plans


def sort_merge_keys(plans):
    """Keys by which rows are dealt to tasks in order to be joined; tables of groups, a row for each, join by outer joins."""
    return [line for plan in plans for node in re.split(r"\n\n+", plan) if re.match(r"\(\d+\) SortMergeJoin", node) and "LeftOuter" not in node for line in node.splitlines() if line.startswith("Left keys")]


def test_members_meet_their_group_where_they_are(spark, monkeypatch):
    for cfg in (Config(rank="a"), Config(rank="a", keep_hardlinked=True), Config(rank="a", keep_all_tagged=True)):
        group = sieve.group_keys(cfg)
        plans = dealt_by(spark, monkeypatch, lambda cfg=cfg, group=group: rank.totals(rank.mark_originals(sieve.sieve(rows(spark, TREE), cfg), cfg, group), cfg, group))
        assert not [keys for keys in sort_merge_keys(plans) if "checksum" in keys]


def test_directories_meet_their_group_and_what_is_above_where_they_are(spark, monkeypatch):
    cfg = Config(rank="a")

    def run():
        files = rows(spark, TREE)
        members = sieve.sieve(files, cfg)
        dirs = directories.duplicate_dirs(files, members, cfg)
        return directories.leftovers(members, dirs, cfg, sieve.group_keys(cfg))

    plans = dealt_by(spark, monkeypatch, run)
    keys = sort_merge_keys(plans)
    assert keys and not [k for k in keys if re.search(r"checksum|: \[signature#\d+\]", k)]


@pytest.mark.parametrize("how", ({}, {"keep_all_tagged": True, "keep_hardlinked": True}))
def test_hot_groups_change_nothing(spark, monkeypatch, how):
    r = random.Random(5)
    extra = [(f"l/{r.randrange(40)}/{k}", r.choice("abcdeeee")) for k in range(200)]
    cfg = Config(rank="a", **how)

    def told():
        files = rows(spark, TREE + extra, is_tagged=F.col("i") % 3 == 0, inode=F.floor(F.col("i") / 2).cast("long"), link_count=F.lit(2)).filter("path <> 'z/one'")
        members = stage.once(sieve.sieve(files, cfg))
        dirs = stage.once(directories.duplicate_dirs(files, members, cfg))
        group = sieve.group_keys(cfg)
        marked = rank.ranked(rank.mark_originals(members, cfg, group), cfg, group, members).select("path", "is_original", "rank_in_group", "twins")
        left = directories.leftovers(members, dirs, cfg, group).select("path", "is_original", "rank_in_group", "twins")
        parts = directories.parts(files.drop("content"), dirs).select("path", "parent_path")
        return [sorted(map(tuple, found.collect())) for found in (marked, left, parts, dirs.select("dir", "twins", "rank_in_group", "is_original"))]

    want = told()
    monkeypatch.setattr(rank, "HOT_ROWS", 9)
    monkeypatch.setattr(rank, "FEW_GROUPS", 0)
    assert told() == want and all(want)


def test_links_of_one_file_alone_are_no_group(spark):
    """All originals: the links of one file.  A second file of the content makes a group."""
    df = rows(spark, [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "y")], inode=F.when(F.col("i") < 2, 1).when(F.col("i") < 4, 2).otherwise(3))
    got = sieve.duplicates(df, Config(rank="a", keep_hardlinked=True)).select("path", "is_original").collect()
    assert sorted(map(tuple, got)) == [("c", True), ("d", True), ("e", False)]


def test_a_range_is_sorted_by_keys_that_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(rank, "HOT_ROWS", 9)
    cfg = Config(rank="a")
    plans = dealt_by(spark, monkeypatch, lambda: sieve.duplicates(rows(spark, TREE), cfg))
    sorts = [line for plan in plans for node in re.split(r"\n\n+", plan) if re.match(r"\(\d+\) (Sort|Exchange)\b", node) for line in node.splitlines() if line.startswith("Arguments") and ("rangepartitioning" in line or "__by" in line)]
    assert sorts and not [line for line in sorts if "translate" in line]


def test_equal_entries_are_told_in_one_pass(spark):
    entries = rows(spark, TREE).withColumn("checksum", digests.digest(F.col("content"), "sha256"))
    asked = spark.createDataFrame([("same", "x/p"), ("same", "y/p"), ("not", "x/p"), ("not", "x/q"), ("mixed", "x/p"), ("mixed", "x/p/0"), ("missing", "x/p"), ("missing", "none"), ("alone", "x/p"), ("files", "x/p/0"), ("files", "y/p/1")], "ask string, path string")
    found = relations.equal_entries(entries, asked)
    assert {r.ask: (r.n, r.is_equal) for r in found.collect()} == {"same": (2, True), "not": (2, False), "mixed": (2, False), "missing": (2, False), "alone": (1, False), "files": (2, True)}
    assert "Expand" not in found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
