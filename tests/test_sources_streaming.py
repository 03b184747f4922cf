import os

from pyspark.sql import functions as F

from tidyspark.operators import sieve
from tidyspark.plans import parsing
from tidyspark.plans.config import Config
from tidyspark.sources import filesystem as fs
from tidyspark.streaming import incremental


def test_file_tree(spark, tmp_path):
    for name, text in (("a/x", "xxx"), ("b/y", "xxx"), ("b/.hidden/z", "xxx"), (".top", "xxx"), ("c/d/empty", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.link(tmp_path / "a/x", tmp_path / "a/linked")
    os.symlink(tmp_path / "a/x", tmp_path / "good")
    os.symlink(tmp_path / "nowhere", tmp_path / "bad")
    os.makedirs(tmp_path / "really/empty")
    roots = parsing.roots([str(tmp_path)])
    rows = fs.read_tree(spark, roots).collect()
    kinds = {os.path.relpath(r.path, tmp_path): r.kind for r in rows}
    assert kinds["bad"] == "badlink" and kinds["good"] == "symlink" and kinds["b/.hidden"] == "skipped" and kinds[".top"] == "skipped" and kinds["really/empty"] == "dir" and "b/.hidden/z" not in kinds
    with_hidden = {os.path.relpath(r.path, tmp_path) for r in fs.read_tree(spark, roots, hidden="include").collect()}
    assert "b/.hidden/z" in with_hidden
    assert {os.path.relpath(r.path, tmp_path) for r in fs.read_tree(spark, roots, max_depth=1).collect()} == {".", "a", "b", "c", "good", "bad", "really", ".top"}
    files = fs.read_tree(spark, roots).filter("kind = 'file' AND size > 0")
    got = sieve.duplicates(fs.with_content(files), Config(rank="a")).collect()
    assert sorted(os.path.relpath(r.path, tmp_path) for r in got) == ["a/linked", "a/x", "b/y"]
    digests = {r.checksum for r in fs.with_digest(files, "blake2b").collect()}
    assert len(digests) == 1 and len(digests.pop()) == 128
    assert fs.read_tree(spark, [(str(tmp_path / "a/x"), 0, True)]).first().is_tagged
    assert fs.mount_table(spark).count() > 0 and fs.path_list("a\0b\0", True) == ["a", "b"]


def test_cache_and_stamp(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "aa", 5.0), (1, 2, "bb", 6.0)], "dev long, inode long, checksum string, mtime double")
    assert incremental.write_cache(rows, str(tmp_path / "c"), "sha256", Config())
    assert not incremental.write_cache(rows, str(tmp_path / "c"), "sha256", Config(clamp_low=parsing.clamp("1")))
    from tidyspark.sources.results import with_cached

    now = spark.createDataFrame([(1, 1, 5.0, None), (1, 2, 7.0, None)], "dev long, inode long, mtime double, cached_checksum string")
    assert {r.inode: r.cached_checksum for r in with_cached(now, incremental.read_cache(spark, str(tmp_path / "c")), "sha256").collect()} == {1: "aa", 2: None}
    incremental.clear_cache(spark, str(tmp_path / "c"), str(tmp_path / "d"), now.filter("inode = 1"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1
    from tidyspark.sinks.formats import write_stamp

    write_stamp(str(tmp_path / "s"), 60.0, iso8601=True)
    assert incremental.since(Config(), str(tmp_path / "s")).newer_than == 60.0 and incremental.since(Config(), str(tmp_path / "none")).newer_than is None


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("b", "x", 0), ("a", "x", 1), ("c", "y", 2)]
    spark.createDataFrame(rows, "path string, content string, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("path string, content string, ts timestamp").parquet(str(source))
    for name, plan, mode in (("first", incremental.first_seen(stream, "content", "ts"), "append"), ("running", incremental.running_groups(stream, "path", "content", "ts"), "update")):
        query = plan.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("first").count() == 2
    assert sorted((r.original, r.twins) for r in spark.table("running").collect()) == [("a", 2), ("c", 1)]


def test_forgotten_groups_and_sessions(spark, tmp_path):
    """Contents that have not come for long leave the state; chains of equal content end at gaps; lines of a result become rows."""
    schema = "path string, content string, ts timestamp"
    source = tmp_path / "in"

    def add(rows):
        spark.createDataFrame(rows, "path string, content string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s").coalesce(1).write.mode("append").parquet(str(source))

    add([("a", "x", 0), ("b", "x", 5), ("c", "y", 9)])
    stream = spark.readStream.schema(schema).parquet(str(source))
    running = incremental.running_groups(stream, "path", "content", "ts", keep_seconds=100).writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", str(tmp_path / "k")).start()
    chains = incremental.sessions(stream, "ts", ["content"], "10 seconds").writeStream.format("memory").queryName("chains").outputMode("append").option("checkpointLocation", str(tmp_path / "s")).start()
    for rows in ([("d", "z", 1000)], [("e", "z", 2000)], [("f", "x", 2001)], [("g", "w", 3000)]):
        for query in (running, chains):
            query.processAllAvailable()
        add(rows)
    for query in (running, chains):
        query.processAllAvailable()
        query.stop()
    told = [(r.original, r.twins) for r in spark.table("kept").collect()]
    assert ("a", 2) in told and ("f", 1) in told  # the x of old is forgotten
    assert {(r.content, r.n) for r in spark.table("chains").collect()} >= {("x", 2), ("y", 1), ("z", 1), ("x", 1)}

    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "r.txt").write_text('{"description": "head"}\n{"type": "duplicate_file", "path": "p", "size": 3, "checksum": "aa", "is_original": true, "twins": 2, "mtime": 1.5}\n{"aborted": false}\n')
    query = incremental.result_lines(spark.readStream.text(str(lines))).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "l")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("lines").collect()] == [("duplicate_file", "p", 3, "aa", True, 2, 1.5)]
    assert incremental.metrics(query)


def test_roots(tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "nowhere", tmp_path / "bad")
    found, unread = fs.registered([str(tmp_path / "link"), "//", str(tmp_path / "bad"), str(tmp_path / "none"), "//", "/" + str(tmp_path / "a")])
    assert unread == [str(tmp_path / "none")]
    assert [tuple(r) for r in found] == [(str(tmp_path / "a"), 0, False, False, True), (str(tmp_path / "bad"), 1, True, False, False), (str(tmp_path / "a"), 2, False, True, True)]
    monkeypatch.chdir(tmp_path)
    assert fs.registered([])[0][0].path == str(tmp_path)


def test_file_tree_as_a_run(spark, tmp_path):
    """Places that several roots lead to count once; empty directories by what the walk met; unread entries spoil directories."""
    from tidyspark.operators import directories, lint
    from tidyspark.plans.pipeline import run

    for name, text in (("t/a/x", "xxx"), ("t/b/y", "xxx"), ("t/c/.z", "1"), ("t/d/e/deep", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.makedirs(tmp_path / "t/none/in")
    roots = [(str(tmp_path / "t"), 0, False), (str(tmp_path / "t/a"), 1, False)]
    tree = fs.read_tree(spark, roots)
    files = tree.filter("kind = 'file' AND size > 0")
    assert files.count() == 3
    report = run(files, Config(rank="a"))
    assert sorted(os.path.relpath(r.path, tmp_path) for r in report.duplicates.collect()) == ["t/a/x", "t/b/y"]
    empty = [os.path.relpath(r.path, tmp_path) for r in lint.empty_dirs_of_tree(tree).collect()]
    assert empty == ["t/none/in", "t/none"]
    members = sieve.sieve(files.filter("path_index = 0"), Config(rank="a"))
    own = files.filter("path_index = 0")
    assert directories.duplicate_dirs(own, members, Config(rank="a"), [str(tmp_path / "t")]).count() == 2
    errors = spark.createDataFrame([(str(tmp_path / "t/b/locked"),)], "path string")
    assert directories.duplicate_dirs(own, members, Config(rank="a"), [str(tmp_path / "t")], errors).count() == 0
    times = spark.createDataFrame([(str(tmp_path / "t/a"), 9.0), (str(tmp_path / "t/b"), 1.0)], "path string, mtime double")
    first = {os.path.relpath(r["dir"], tmp_path): r.is_original for r in directories.duplicate_dirs(own, members, Config(rank="m"), None, None, times).collect()}
    assert first == {"t/a": False, "t/b": True}


def test_walk_options(spark, tmp_path):
    """Links, hidden entries, permissions, devices and roots that are no directories."""
    for name in ("d/x", "d/.h/y", "d/run"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    os.chmod(tmp_path / "d/run", 0o755)
    os.symlink(tmp_path / "d/x", tmp_path / "d/link")
    os.symlink("nowhere", tmp_path / "lost")
    os.symlink(tmp_path / "d", tmp_path / "d/loop")
    root = [(str(tmp_path / "d"), 0, False)]

    def kinds(roots=root, **how):
        return {os.path.relpath(r.path, tmp_path): (r.kind, r.is_symlink) for r in fs.read_tree(spark, roots, **how).collect()}

    assert kinds()["d/link"] == ("symlink", True) and kinds()["d/loop"] == ("symlink", True)
    assert "d/link" not in kinds(symlinks="ignore")
    followed = kinds(symlinks="follow")
    assert followed["d/link"] == ("file", False) and "d/loop/loop" not in followed
    assert kinds([(str(tmp_path / "lost"), 0, True)]) == {"lost": ("badlink", True)}
    assert kinds([(str(tmp_path / "d/x"), 0, True)]) == {"d/x": ("file", False)}
    assert kinds()["d/.h"][0] == "skipped" and {r.is_hidden for r in fs.read_tree(spark, root, hidden="partial").filter("path LIKE '%/.h/y'").collect()} == {True}
    assert kinds(permissions="x")["d/run"][0] == "file" and kinds(permissions="x")["d/x"][0] == "skipped"
    assert kinds(cross_devices=False)["d/x"][0] == "file"
    assert "d/x" not in kinds(exclude=[str(tmp_path / "d/x")])
    assert [r.content for r in fs.with_content(fs.read_tree(spark, root).filter("kind = 'symlink' AND path LIKE '%link'")).collect()] == [str(tmp_path / "d/x").encode()]
    mounts = fs.mount_table(spark, "22 1 0:21 / /proc rw - proc proc rw\n25 1 8:1 / / rw shared:1 - btrfs /dev/x rw\n")
    assert {r.fs_type: (r.is_ignored, r.can_reflink) for r in mounts.collect()} == {"proc": (True, False), "btrfs": (False, True)}
    users, groups = fs.known_ids(spark)
    assert users.filter("uid = 0").count() == 1 and groups.filter("gid = 0").count() == 1


def test_links_are_compared_by_target(spark, tmp_path):
    (tmp_path / "x").write_text("target")
    for name in ("a", "b"):
        os.symlink("x", tmp_path / name)
    os.symlink("y", tmp_path / "c")
    (tmp_path / "file").write_text("x")
    rows = fs.read_tree(spark, [(str(tmp_path), 0, False)]).filter("kind IN ('file', 'symlink', 'badlink')")
    got = sieve.duplicates(rows, Config(rank="a")).collect()
    assert sorted(os.path.basename(r.path) for r in got) == ["a", "b"]


def test_own_outputs_are_no_part_of_a_walk(spark, tmp_path):
    """Files and folders that results go to are left out, also by way of a linked root; what has the same content stays."""
    tree = tmp_path / "t"
    (tree / "d").mkdir(parents=True)
    (tree / "table.parquet").mkdir()
    for name in ("r.json", "copy.json", "d/do.sh", "d/x", "table.parquet/part-0"):
        (tree / name).write_text("same")
    (tmp_path / "way").symlink_to(tree)
    outputs = [parsing.output(x) for x in (f"json:{tree}/r.json", f"{tree}/d/do.sh", "summary", f"csv:{tree}/table.parquet", f"py:{tree}/not-yet.py")]
    for root in (tree, tmp_path / "way"):
        found = fs.read_tree(spark, [(str(root), 0, False)], outputs=outputs)
        assert {r.path[len(str(root)) :] for r in found.filter("kind = 'file'").collect()} == {"/copy.json", "/d/x"}
    assert fs.read_tree(spark, [(str(tree), 0, False)], outputs=[parsing.output("json")]).filter("kind = 'file'").count() == 5
