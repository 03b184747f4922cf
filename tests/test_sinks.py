"""Documents that tasks write together."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tidyspark.operators import records, sieve
from tidyspark.plans import pipeline
from tidyspark.plans.config import Config
from tidyspark.sinks import document, formats, scripts
from tidyspark.sources import filesystem as fs
from tidyspark.sources.results import with_marks
from tidyspark.streaming import incremental


def numbers(spark, n=1000, parts=7):
    return spark.range(0, n, 1, parts).select(F.format_string("%05dé", "id").alias("value"))


def test_segments_are_joined_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    document.write(numbers(spark), path, "<", ", ", ">", ["first"], ["last"])
    assert open(path, encoding="utf-8").read() == "<" + ", ".join(["first", *(f"{i:05d}é" for i in range(1000)), "last"]) + ">"
    document.write(numbers(spark, 3, 8), path, separator="\n")
    assert open(path, encoding="utf-8").read() == "00000é\n00001é\n00002é"
    document.write(numbers(spark, 0), path, "[", ",", "]", empty="nothing")
    assert open(path).read() == "nothing" and os.listdir(tmp_path) == ["out"]


def test_an_aborted_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    document.write(numbers(spark, 2), path)
    before = open(path, "rb").read()
    bad = numbers(spark).select(F.when(F.col("value").startswith("00990"), F.raise_error(F.lit("stop"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception, match="stop"):
        document.write(bad, path)
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["out"]


def test_a_result_has_the_order_of_ranks(spark, tmp_path):
    df = records.as_records(spark.createDataFrame([(f"p{i:03d}", f"c{i % 40}") for i in range(400)], "path string, content string"), F.col("path"), F.col("content"))
    report = pipeline.run(df, Config(rank="a", sort_groups="a"))
    path = str(tmp_path / "r.json")
    formats.write_json(report.duplicates.repartition(5), path, {"cwd": "/"}, {"duplicates": 360})
    rows = json.load(open(path))
    assert rows[0]["cwd"] == "/" and rows[-1]["duplicates"] == 360
    assert [r["path"] for r in rows[1:-1]] == [f"p{i:03d}" for k in range(40) for i in range(k, 400, 40)]
    formats.write_pretty(report.duplicates, str(tmp_path / "text"))
    lines = open(tmp_path / "text").read().splitlines()
    assert lines == list(formats.pretty(report.duplicates)) and lines[0] == "# duplicate file:" and lines[1] == "    ls p000" and len(lines) == 401


def test_no_sink_brings_rows_to_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    df = records.as_records(spark.createDataFrame([("a", "x"), ("b", "x")], "path string, content string"), F.col("path"), F.col("content"))
    found = sieve.duplicates(df, Config(rank="a"))
    group = sieve.group_keys(Config(rank="a"))
    planned = formats.actions(found, group)

    def none(*_, **__):
        raise AssertionError("rows came to the driver")

    for name in ("toLocalIterator", "collect", "toPandas"):
        monkeypatch.setattr(type(found) if name in type(found).__dict__ else DataFrame, name, none)
    formats.write_json(found, str(tmp_path / "j"))
    formats.write_blocks(found, group, str(tmp_path / "b"))
    scripts.write_script(planned, str(tmp_path / "s"))
    formats.write_pretty(found, str(tmp_path / "p"))
    monkeypatch.undo()
    assert open(tmp_path / "b").read() == "a\nb\n\n"


def test_the_script_removes_an_equal_directory(spark, tmp_path):
    base = tmp_path / "t"
    for name, text in (("a/x", "same"), ("a/s/y", "other"), ("b/z", "other"), ("b/it's", "same"), ("c/x", "same"), ("c/y", "other")):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    tree = fs.read_tree(spark, [(str(base), 0, False)], hidden="partial")
    report = pipeline.run(tree, Config(rank="a", merge_directories=True), [str(base)])
    planned = formats.directory_actions(report.directories, formats.PRESETS["link"] + ("remove",))
    assert {os.path.basename(r.path): r.action for r in planned.collect()} == {"a": "keep", "b": "remove", "c": "remove"}
    script = str(tmp_path / "do.sh")
    scripts.write_script(planned, script)
    subprocess.run([script], check=True, capture_output=True)
    assert sorted(os.listdir(base)) == ["a", "b", "c"]
    (base / "c/more").write_text("new since then")
    done = subprocess.run([script, "-x"], capture_output=True, text=True)
    assert done.returncode == 1 and "original has changed" in done.stderr and sorted(os.listdir(base)) == ["a", "c"]


def test_script_options(spark, tmp_path):
    base, script = tmp_path / "t", str(tmp_path / "do.sh")
    copies = ("o/original", "d/deep/er/copy", "d/full/copy", "d/full/other one")

    def fresh():
        for name in copies:
            (base / name).parent.mkdir(parents=True, exist_ok=True)
            (base / name).write_text("different" if "other" in name else "same")
        for folder in ("d/deep/er", "d/deep", "d/full", "d"):
            os.utime(base / folder, (1e9, 1e9))

    def run(*options, answers="", code=0):
        done = subprocess.run([script, *options], input=answers, capture_output=True, text=True)
        assert done.returncode == code, done.stderr
        return done.stdout, {os.path.relpath(os.path.join(folder, x), base) for folder, _, files in os.walk(base) for x in files}

    fresh()
    cfg = Config(rank="d")
    found = sieve.duplicates(fs.read_tree(spark, [(str(base), 0, False)]).filter("kind = 'file'"), cfg)
    scripts.write_script(formats.actions(found, sieve.group_keys(cfg)), script)
    lines = [x for x in open(script).read().splitlines() if x.startswith(("keep ", "remove "))]
    assert [x.split()[0] for x in lines].count("remove") == 2 and "deep" not in [x for x in lines if x.startswith("keep")][0]
    gone = {x.split("'")[1].removeprefix(f"{base}/") for x in lines if x.startswith("remove")}

    for options in ((), ("-n",), ("-x", "-n", "-c"), ("-k", "-c")):
        shown, left = run(*options)
        assert left == set(copies) and shown.count("rm -f") == 2
    assert run("-x", "-i", answers="no\nNo\n")[1] == run("-x", "-i")[1] == set(copies)
    assert len(run("-x", "-i", answers="n\ny\n")[1]) == 3
    fresh()
    assert run("-x", "-q") == ("", set(copies) - gone) and (base / "d/deep/er").is_dir() and os.stat(base / "d/deep/er").st_mtime > 1e9
    fresh()
    assert run("-x", "-k")[1] == set(copies) - gone and os.stat(base / "d/deep/er").st_mtime == 1e9
    fresh()
    assert run("-xck")[1] == set(copies) - gone and sorted(os.listdir(base / "d")) == ["full"] and os.stat(base / "d").st_mtime == 1e9
    assert "usage" in run("-h")[0]
    run("-z", code=2)
    run("file", code=2)


def test_marks_of_what_is_deduplicated(spark, tmp_path):
    rows = [("a", 1, 5.0, "x", True, 1), ("b", 2, 5.0, "x", False, 2), ("c", 3, 5.0, "x", False, 3), ("d", 4, 5.0, "x", False, 4), ("e", 5, 5.0, None, False, 5)]
    found = spark.createDataFrame(rows, "path string, inode long, mtime double, checksum string, is_original boolean, rank_in_group int").withColumn("dev", F.lit(7).cast("long")).withColumn("g", F.lit(1))
    capable, cache = spark.createDataFrame([(7,)], "dev long"), str(tmp_path / "cache")

    def plan(df, handlers=("clone", "hardlink")):
        return formats.actions(df, ["g"], handlers, reflink_devices=capable)

    def told(df):
        return {r.path: r.action for r in df.collect()}

    first = plan(found)
    assert told(first) == {"a": "keep", "b": "clone", "c": "clone", "d": "clone", "e": "clone"}
    incremental.mark_deduplicated(first, cache, "sha256")
    incremental.mark_deduplicated(first.filter("path = 'b'"), cache, "sha256")
    later = found.withColumn("mtime", F.when(F.col("path") == "c", 6.0).otherwise(F.col("mtime"))).withColumn("checksum", F.when(F.col("path") == "d", "y").otherwise(F.col("checksum")))
    marks = incremental.read_cache(spark, cache)
    assert told(plan(with_marks(later, marks, "sha256"))) == {"a": "keep", "b": "skip", "c": "clone", "d": "clone", "e": "clone"}
    assert told(plan(with_marks(later, marks, "sha256"), ("hardlink",)))["b"] == "hardlink"  # a mark is of extents, not of links
    assert told(plan(with_marks(later, marks, "md5")))["b"] == "clone"
