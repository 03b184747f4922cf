"""Digests against their libraries, scripts against a shell, re-queries and reports by hand."""

import hashlib
import json
import os
import subprocess
import sys
import threading
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from tidyspark.functions import digests
from tidyspark.operators import directories, lint, rank, records, sieve
from tidyspark.plans import parsing, requery, settings
from tidyspark.plans.config import Config
from tidyspark.plans.pipeline import Run, run
from tidyspark.sinks import formats, scripts
from tidyspark.sources import filesystem as fs

TEXTS = ["", "abc", "é" * 50, "x" * 100_000, None]


def rows(spark, pairs):
    df = spark.createDataFrame([(p, c, float(i)) for i, (p, c) in enumerate(pairs)], "path string, content string, t double")
    return records.as_records(df, F.col("path"), F.col("content"), mtime=F.col("t"))


@pytest.mark.parametrize("name", ["md5", "sha1", "sha256", "sha384", "sha512", "sha3-256", "sha3-384", "sha3-512", "blake2b", "blake2s", "xxhash", "cumulative"])
def test_digest_values(spark, name):
    def known(raw):
        if name == "xxhash":
            return f"{xxhash.xxh64_intdigest(raw, seed=42):016x}"
        if name == "cumulative":
            lanes = [0] * 8
            padded = raw + b"\0" * (64 - len(raw) % 64)
            for k in range(0, len(padded), 8):
                lanes[k // 8 % 8] ^= int.from_bytes(padded[k : k + 8], "big")
            return "".join(f"{x:016x}" for x in lanes)
        return hashlib.new(name.replace("-", "_") if name.startswith("sha3") else name, raw).hexdigest()

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", digests.digest(F.col("t"), name).alias("d")).collect()}
    assert got == {i: None if t is None else known(t.encode()) for i, t in enumerate(TEXTS)}
    raw = TEXTS[3].encode()
    assert digests.streamed((raw[k : k + 777] for k in range(0, len(raw), 777)), name) == got[3]


@pytest.mark.parametrize("name, empty, lanes, block", [
    ("blake2bp", "b5ef811a8038f70b628fa8b294daae7492b1ebe343a80eaabbf1f6ae664dd67b9d90b0120791eab81dc96985f28849f6a305186a85501b405114bfa678df9380", 4, 128),
    ("blake2sp", "dd0e891776933f43c7d032b08a917e25741f8aa9a12c12e1cac8801500f2ca4f", 8, 64),
])
def test_parallel_digests(spark, name, empty, lanes, block):
    """The published digest of nothing, and the tree worked out leaf by leaf."""
    make, size = (hashlib.blake2b, 64) if name == "blake2bp" else (hashlib.blake2s, 32)

    def known(raw):
        root = make(digest_size=size, fanout=lanes, depth=2, inner_size=size, node_depth=1, last_node=True)
        for k in range(lanes):
            mine = b"".join(raw[at : at + block] for at in range(k * block, len(raw), lanes * block))
            root.update(make(mine, digest_size=size, fanout=lanes, depth=2, inner_size=size, node_offset=k, last_node=k == lanes - 1).digest())
        return root.hexdigest()

    assert digests.streamed([], name) == empty
    for n in (1, block, lanes * block - 1, lanes * block, 5 * lanes * block + 77):
        raw = bytes(k * 7 % 251 for k in range(n))
        assert digests.streamed((raw[k : k + 100] for k in range(0, n, 100)), name) == known(raw)
    df = spark.createDataFrame([("",), (None,), ("x" * 3000,)], "t string")
    assert [r.d for r in df.select(digests.digest(F.col("t"), name).alias("d")).collect()] == [empty, None, known(b"x" * 3000)]


def test_shell_script(spark, tmp_path):
    for name, text in (("a", "same"), ("it's b", "same"), ("c", "same"), ("other", "differs")):
        (tmp_path / name).write_text(text)
    files = fs.read_tree(spark, [(str(tmp_path), 0, False)]).filter("kind = 'file'")
    cfg = Config(rank="a")
    found = sieve.duplicates(files, cfg)
    planned = formats.actions(found, sieve.group_keys(cfg), formats.PRESETS["default"])
    script = str(tmp_path / "do.sh")
    scripts.write_script(planned, script)
    shown = subprocess.run([script], capture_output=True, text=True, check=True).stdout
    assert sorted(os.listdir(tmp_path)) == ["a", "c", "do.sh", "it's b", "other"] and shown.count("rm -f") == 2
    (tmp_path / "c").write_text("changed")
    done = subprocess.run([script, "-x"], capture_output=True, text=True)
    assert done.returncode == 1 and "original has changed" in done.stderr and sorted(os.listdir(tmp_path)) == ["a", "c", "do.sh", "other"]
    links = formats.actions(found.filter("NOT path LIKE '%it_s b'"), sieve.group_keys(cfg), formats.PRESETS["hardlink"])
    (tmp_path / "c").write_text("same")
    scripts.write_script(links, script)
    subprocess.run([script, "-x"], capture_output=True, check=True)
    assert os.path.samefile(tmp_path / "a", tmp_path / "c")


def test_consumer(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text("same")
    files = fs.read_tree(spark, [(str(tmp_path), 0, False)]).filter("kind = 'file'")
    cfg = Config(rank="a")
    formats.write_json(sieve.duplicates(files, cfg), str(tmp_path / "r.json"), {"cwd": "/"}, {"duplicates": 2})
    scripts.write_consumer(str(tmp_path / "r.py"), str(tmp_path / "r.json"))
    assert subprocess.run([sys.executable, str(tmp_path / "r.py")], capture_output=True, text=True, check=True).stdout.count("=") == 2
    (tmp_path / "b").write_text("new")
    assert subprocess.run([sys.executable, str(tmp_path / "r.py"), "-x"], capture_output=True).returncode == 1
    assert sorted(os.listdir(tmp_path)) == ["a", "b", "r.json", "r.py"]
    formats.write_json(sieve.duplicates(files.filter("path LIKE '%a'"), cfg), str(tmp_path / "e.json"), {"cwd": "/"}, {"duplicates": 0}, no_body=True)
    assert [set(x) >= {"progress"} for x in json.load(open(tmp_path / "e.json"))] == [True, True]


def test_actions_of_every_kind(spark):
    cfg = Config(rank="a")
    df = rows(spark, [("o", "x"), ("p", "x"), ("q", "x"), ("r", "x")])
    df = df.withColumn("dev", F.when(F.col("path") == "r", 2).otherwise(1).cast("long")).withColumn("inode", F.when(F.col("path").isin("o", "p"), 7).otherwise(F.hash("path")).cast("long"))
    found = sieve.duplicates(df, cfg)
    capable = spark.createDataFrame([(1,)], "dev long")
    told = lambda **how: {r.path: r.action for r in formats.actions(found, sieve.group_keys(cfg), **how).collect()}
    assert told(handlers=formats.PRESETS["clone"], reflink_devices=capable) == {"o": "keep", "p": "skip", "q": "clone", "r": "symlink"}
    assert told(handlers=formats.PRESETS["clone"], reflink_devices=capable, can_clone=False) == {"o": "keep", "p": "skip", "q": "reflink", "r": "symlink"}
    assert told(handlers=formats.PRESETS["link"]) == {"o": "keep", "p": "skip", "q": "hardlink", "r": "symlink"}
    assert told(handlers=("hardlink",)) == {"o": "keep", "p": "skip", "q": "hardlink", "r": "skip"}
    assert told(command="gzip") == {"o": "keep", "p": "cmd", "q": "cmd", "r": "cmd"} and set(told().values()) == {"keep", "remove"}
    shared = formats.actions(found.withColumn("extents", F.lit("e")), sieve.group_keys(cfg), formats.PRESETS["reflink"], reflink_devices=capable)
    assert {r.path: r.action for r in shared.collect()}["q"] == "skip"


def test_unfinished_checksums(spark):
    pairs = [("d/a", "xx"), ("e/a", "xx"), ("lone", "yy"), ("single", "long one")]
    df = rows(spark, pairs)
    plain = {r.path: getattr(r, "checksum", None) for r in sieve.uniques(df, Config()).collect()}
    told = {r.path: r.checksum for r in sieve.uniques(df, Config(write_unfinished=True)).collect()}
    assert plain == {"lone": None, "single": None} and told == {"lone": hashlib.sha256(b"yy").hexdigest(), "single": None}
    cfg = Config(rank="a")
    members = sieve.sieve(df, cfg)
    dirs = directories.duplicate_dirs(df, members, cfg)
    left = directories.leftovers(members, dirs, cfg, sieve.group_keys(cfg))
    assert dirs.count() == 2 and {r.path for r in directories.unfinished(members, left).collect()} == {"d/a", "e/a"}


def test_requery_parts(spark, tmp_path):
    df = rows(spark, [("r/a/x", "1"), ("r/b/x", "1"), ("r/a/y", "2"), ("r/b/y", "2"), ("r/c", "1")])
    cfg = Config(rank="a")
    result = sieve.duplicates(df, cfg)
    dirs = requery.packed(df.drop("content"), result, cfg)
    assert {r["dir"]: r.is_original for r in dirs.collect()} == {"r/a": True, "r/b": False}
    parts = directories.parts(result, dirs.select("dir", "is_original")).select("type", "path", "checksum", "size", F.lit(False).alias("is_original"))
    whole = dirs.select("type", F.col("dir").alias("path"), F.col("signature").alias("checksum"), "size", "is_original").unionByName(parts)
    assert sorted(r.path for r in requery.unpacked(whole).collect()) == ["r/a/x", "r/a/y", "r/b/x", "r/b/y"]
    found = requery.statistics(whole.filter("type = 'duplicate_dir'").withColumn("n_children", F.lit(2))).first()
    assert (found.duplicates, found.duplicate_sets, found.duplicate_bytes) == (2, 1, 2)
    now = spark.createDataFrame([("r/a/x", 0.04, 0o644, 1, 1), ("r/b/x", 9.0, 0o644, 1, 1), ("r/c", 4.0, 0o600, 2, 1)], "path string, mtime double, mode int, dev long, root_dev long")
    there = requery.still_there(result, now)
    assert sorted(r.path for r in there.collect()) == ["r/a/x", "r/c"]
    assert [r.path for r in requery.filtered(there, Config(permissions="r")).collect()] == ["r/a/x"]
    assert [r.path for r in requery.filtered(there, Config(cross_devices=False)).collect()] == ["r/a/x"]
    # Rows without checksums are groups as they stand in the result.
    bare = [("duplicate_file", f"p{k}", 3, 0, 0.0, None, k in (0, 2)) for k in range(5)]
    formats.write_json(spark.createDataFrame(bare, "type string, path string, size long, depth int, mtime double, checksum string, is_original boolean").coalesce(1), str(tmp_path / "r.json"))
    from tidyspark.sources.results import read_results

    again = {r.path: r.twins for r in requery.requery([read_results(spark, str(tmp_path / "r.json"))], cfg).collect()}
    assert again == {"p0": 2, "p1": 2, "p2": 3, "p3": 3, "p4": 3}


def test_settings():
    cfg, preset = settings.from_settings({"traverse-match": "extension", "general-find-symlinks": "follow", "traverse-hidden": "partial", "computation-keep-all-tagged": "tagged", "general-find-hardlinks": False, "traverse-cross-mounts": False, "traverse-size-limits": ("1", "2G"), "traverse-max-depth": 7, "computation-algorithm": "sha1", "general-handler-type": "symlink"})
    assert (cfg.match_extension, cfg.symlinks, cfg.hidden, cfg.keep_all_tagged, cfg.hardlinks, cfg.cross_devices, cfg.size, cfg.max_depth, cfg.algorithm, preset) == (True, "follow", "partial", True, False, False, (1, 2 * 1000**3), 7, "sha1", "symlink")
    assert cfg.types == {"duplicate_file"}
    for bad in ({"nothing": 1}, {"traverse-match": "half"}, {"general-handler-type": "burn"}):
        with pytest.raises(parsing.ParseError):
            settings.from_settings(bad)


def test_abort_keeps_what_is_written(spark, tmp_path):
    report = run(rows(spark, [("a", "x"), ("b", "x")]), Config(rank="a"))
    assert Run(spark).write([("json", lambda: formats.write_json(report.duplicates, str(tmp_path / "j.json")))]) == {"aborted": False, "written": ["json"]}
    one = Run(spark)
    slow = spark.range(8).repartition(8).mapInPandas(lambda batches: (time.sleep(20) or b for b in batches), "id long")
    threading.Timer(3, one.abort).start()
    began = time.time()
    told = one.write([("csv", lambda: formats.write_csv(report.duplicates, str(tmp_path / "c"))), ("slow", lambda: formats.discard(slow)), ("late", lambda: formats.discard(slow))])
    assert told == {"aborted": True, "written": ["csv"]} and time.time() - began < 30
    with pytest.raises(ZeroDivisionError):
        Run(spark).write([("bad", lambda: 1 / 0)])


def test_blocks(spark, tmp_path):
    cfg = Config(rank="a")
    found = sieve.duplicates(rows(spark, [("a", "x"), ("b", "x"), ("c", "yy"), ("d", "yy"), ("e", "yy")]), cfg)
    group = sieve.group_keys(cfg)
    for how, want in (({}, {"a\nb", "c\nd\ne"}), ({"omit_first": True}, {"b", "d\ne"}), ({"same_line": True}, {"a b", "c d e"})):
        formats.write_blocks(found, group, str(tmp_path / "blocks"), **how)
        text = (tmp_path / "blocks").read_text()
        assert set(filter(None, text.split("\n" if "same_line" in how else "\n\n"))) == want
        (tmp_path / "blocks").unlink()


def test_pace():
    pace = formats.Pace(2)
    assert pace.sample(0, 100, now=0) is None
    assert pace.sample(10, 100, now=1) == 9 and pace.sample(20, 100, now=2) == 8
    assert pace.sample(80, 100, now=3) == pytest.approx(20 / 35)
    assert formats.progress_line(5, 10, 90.0, 10, True) == "[#####-----]  50%, 1m 30.000s to go"


def test_symbols_of_a_real_binary(spark, tmp_path):
    import struct

    names = b"\0.symtab\0"
    head = b"\x7fELF" + bytes([2, 1, 1]) + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 0, 64, 0, 64, 0, 0, 64, 2, 1)
    section = lambda kind: struct.pack("<IIQQQQIIQQ", 1, kind, 0, 0, 0, 0, 0, 0, 0, 0)
    binaries = [("full", head + section(0) + section(2) + names), ("bare", head + section(0) + section(3) + names), ("text", b"#!/bin/sh")]
    df = spark.createDataFrame([(n, bytearray(b), 0o755, False) for n, b in binaries] + [("plain", bytearray(binaries[0][1]), 0o644, False)], "path string, content binary, mode int, is_symlink boolean")
    assert [r.path for r in lint.nonstripped(df).collect()] == ["full"]


def test_lint_is_reported_in_order(spark):
    df = spark.createDataFrame([(t, f"p{k}", float(k), k % 2 == 0) for k, t in enumerate(parsing.LINT_TYPES[:7])], "type string, path string, mtime double, is_tagged boolean")
    assert [r.type for r in lint.reported(df, Config()).orderBy("lint_rank").collect()] == list(parsing.LINT_TYPES[:7])
    assert lint.reported(df, Config(newer_than=3.0)).count() == 4
    assert {r.is_tagged for r in lint.reported(df, Config(keep_all_tagged=True)).collect()} == {False}
    assert rank.order_groups is not None
