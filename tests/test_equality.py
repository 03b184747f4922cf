"""Equality of files and directories, roots by the thousand, and results without checksums."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidyspark.operators import relations
from tidyspark.plans import requery
from tidyspark.plans.config import Config
from tidyspark.sources import filesystem as fs
from tidyspark.sources.results import read_results


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    base = tmp_path_factory.mktemp("equal")
    files = {
        "a": "1234", "b": "1234", "c": "1234", "d": "diff", "dir_a/x": "xxx", "dir_b/x": "xxx", ".dir_h/.x": "xxx", "renamed/y": "xxx", "more/x": "xxx", "more/y": "xxx", "x": "xxx",
        "e1": "", "e2": "", "with_empty/x": "xxx", "with_empty/e": "", "deep1/s/x": "xxx", "deep1/s/t/y": "1", "deep2/u/y": "1", "deep2/x": "xxx",
    }
    for name, text in files.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    os.makedirs(base / "none1")
    os.makedirs(base / "none2")
    os.symlink("target", base / "l1")
    os.symlink("target", base / "l2")
    (base / "text").write_text("target")
    os.link(base / "a", base / "hard")
    return base


ASKED = {
    ("a", "b"): True, ("a", "b", "c"): True, ("a", "b", "d", "c"): False, ("a",): False, ("a", "nowhere"): False, ("dir_a", "dir_b"): True, ("dir_a", "x"): False, ("dir_a", ".dir_h"): True, ("e1", "e2"): True, ("dir_a", "more"): False,
    ("dir_a", "renamed"): True, ("dir_a", "with_empty"): False, ("none1", "none2"): False, ("l1", "l2"): True, ("l1", "text"): False, ("a", "hard"): True, ("deep1", "deep2"): True, ("dir_a", "dir_b", "renamed", ".dir_h"): True,
}


@pytest.mark.parametrize("layout", [False, True])
def test_equal(spark, base, layout):
    tree = fs.read_tree(spark, [(str(base), 0, False)], hidden="include")
    digest = fs.with_content(tree.filter("kind IN ('file', 'symlink', 'badlink')")).select("path", F.sha2("content", 256).alias("checksum"))
    entries = tree.withColumn("kind", F.when(F.col("kind") == "badlink", "symlink").otherwise(F.col("kind"))).join(digest, "path", "left")
    asked = spark.createDataFrame([(" ".join(k), os.path.join(base, p)) for k in ASKED for p in k], "ask string, path string")
    got = {tuple(r.ask.split()): r.is_equal for r in relations.equal_entries(entries, asked, layout).collect()}
    named = {("dir_a", ".dir_h"), ("dir_a", "renamed"), ("deep1", "deep2"), ("dir_a", "dir_b", "renamed", ".dir_h")}
    assert got == {k: v and not (layout and k in named) for k, v in ASKED.items()}


def test_what_cannot_be_read_equals_nothing(spark):
    rows = [("r/a/x", 3, "c", 1), ("r/b/x", 3, "c", 2), ("r/b/y", 3, None, 3), ("r/b/z", 3, None, 3), ("r/c/x", 3, "c", 4)]
    entries = spark.createDataFrame([(p, s, c, False, False, 0.0, 1, i) for p, s, c, i in rows], "path string, size long, checksum string, is_symlink boolean, is_tagged boolean, mtime double, dev long, inode long")
    asked = spark.createDataFrame([(k, p) for k, v in {"1": ("r/a", "r/b"), "2": ("r/a", "r/c"), "3": ("r/b/y", "r/b/z"), "4": ("r/b/y", "r/a/x")}.items() for p in v], "ask string, path string")
    assert {r.ask: r.is_equal for r in relations.equal_entries(entries, asked).collect()} == {"1": False, "2": True, "3": True, "4": False}


def test_ten_thousand_roots(spark):
    roots = [(f"/r{i % 100}/s{i}", i, i % 3 == 0) for i in range(10_000)] + [("/r5", 20_000, True), ("/r7/s7/deep/", 20_001, False), ("/r7/s7", 20_002, True)]
    paths = [f"/r{i % 100}/s{i}/f" for i in range(0, 10_000, 37)] + ["/r5", "/r5/other", "/r55", "/r7/s7/deep/x", "/r7/s7/deeper", "/r7/s7", "elsewhere"]
    rows = spark.createDataFrame([(p, 9) for p in paths], "path string, path_index int")
    got = {r.path: (r.path_index, r.is_tagged) for r in requery.assigned(rows, roots).collect()}
    want = {}
    for p in paths:
        above = [r for r in roots if p == r[0].rstrip("/") or p.startswith(r[0].rstrip("/") + "/")]
        if above:
            best = max(above, key=lambda r: (len(r[0].rstrip("/")), -r[1]))
            want[p] = (best[1], best[2])
    assert got == want and "/r55" not in got and got["/r7/s7/deep/x"] == (20_001, False) and got["/r7/s7"] == (7, False)


def test_few_roots_and_many_are_told_alike(spark, monkeypatch):
    roots = [("a", 0, False), ("a/b", 1, True), ("a/b/c", 2, False), ("d", 3, True), ("a/b", 4, False)]
    rows = spark.createDataFrame([(p,) for p in ("a/x", "a/bc", "a/b", "a/b/c/d", "d/e", "f")], "path string")
    chain = sorted(map(tuple, requery.assigned(rows, roots).collect()))
    monkeypatch.setattr(requery, "_CHAINED", 0)
    assert chain == sorted(map(tuple, requery.assigned(rows, roots).collect())) and len(chain) == 5


def test_rows_without_checksums_are_grouped_across_tasks(spark):
    """Groups begin at each original; a group of many thousands lies in several ranges, and no task has all rows."""
    n = 40_000
    rows = spark.range(n).select(
        F.lit(0).alias("source_idx"), F.lit("duplicate_file").alias("type"), F.lit(None).cast("string").alias("checksum"), F.concat(F.lit("p"), "id").alias("path"), F.col("id").alias("position"),
        ((F.col("id") % 10 == 0) & ((F.col("id") < 1000) | (F.col("id") > 39_000))).alias("is_original"),
    ).repartition(6)
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        grouped = requery.with_groups(rows)
        assert "SinglePartition" not in grouped._jdf.queryExecution().executedPlan().toString()
        sizes = {r.checksum: r["count"] for r in grouped.groupBy("checksum").count().collect()}
        assert grouped.select("position").distinct().count() == n
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    assert len(sizes) == 100 + 99 and max(sizes.values()) == 39_010 - 990 and sorted(sizes.values())[:-1] == [10] * 198


def test_positions_follow_the_files(spark, tmp_path):
    """Lines of several files: the largest comes last by name but would be read first."""
    for k, n in enumerate((3, 5, 400)):
        (tmp_path / f"{k}.json").write_text("".join(json.dumps({"type": "duplicate_file", "path": f"{k}-{i:03d}", "is_original": i % 3 == 0}) + "\n" for i in range(n)))
    rows = read_results(spark, str(tmp_path), lines=True)
    assert [r.path for r in rows.orderBy("position").collect()] == [f"{k}-{i:03d}" for k, n in enumerate((3, 5, 400)) for i in range(n)]
    found = requery.requery([rows], Config(rank="a", size=(0, 10**9)))
    assert found.columns
