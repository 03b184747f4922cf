"""What has to hold at scale: no lost groups, no contents in a shuffle, hot groups sorted across tasks, originals in every group."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidyspark.functions import digests
from tidyspark.operators import contents, directories, rank, records, relations, sieve, stage
from tidyspark.plans import pipeline
from tidyspark.plans.config import Config
from tidyspark.sources import filesystem as fs


def rows(spark, pairs):
    df = spark.createDataFrame([(p, c, float(i)) for i, (p, c) in enumerate(pairs)], "path string, content string, t double")
    return records.as_records(df, F.col("path"), F.col("content"), mtime=F.col("t"))


def test_group_order_of_many_groups(spark):
    n = 300_000
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        heads = spark.range(n).select(F.lit("duplicate_file").alias("type"), F.format_string("d/%07d", (F.col("id") * 7919) % n).alias("path"), F.lit(0.0).alias("mtime"), ((F.col("id") * 31) % 1000).alias("size"), F.lit(0).alias("path_index"), F.lit(1).alias("rank_in_group"), F.col("id").alias("g"))
        both = heads.unionByName(heads.withColumn("rank_in_group", F.lit(2)).withColumn("path", F.concat("path", F.lit("x"))))
        got = stage.once(rank.order_groups(both, "sO", ["g"]).filter("rank_in_group = 1").select("g", "group_rank"), "test")
        want = sorted(range(n), key=lambda i: ((i * 31) % 1000, -((i * 7919) % n)))
        expected = spark.createDataFrame([(g, k + 1) for k, g in enumerate(want)], "g long, right long")
        joined = expected.join(got, "g")
        assert got.count() == n and joined.count() == n and joined.filter("group_rank <> right").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_contents_are_in_no_shuffle(spark, tmp_path, monkeypatch):
    rows(spark, [(f"d/{i}", f"text {i % 7} " * 20) for i in range(200)]).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    plans = []

    def explained(df, name="stage", made=stage.once):
        plans.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return made(df, name)

    for module in (sieve, contents, rank):
        monkeypatch.setattr(module, "once", explained)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert stage.once(sieve.duplicates(source, Config(rank="a", prefix_bytes=16)), "test").count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for plan in plans for node in re.split(r"\n\n+", plan) if re.match(r"\(\d+\) (Broadcast)?Exchange", node) for line in node.splitlines() if line.startswith("Input")]
    assert len(moved) >= 5 and not any("content#" in line for line in moved)
    assert sum(plan.count(f"{tmp_path}/t]") for plan in plans) <= 3


def test_few_slots_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(contents, "SLOTS", 4)
    pairs = [(f"d/{i}", f"text {i if i % 3 else 0}") for i in range(100)]
    got = sieve.sieve(rows(spark, pairs), Config(rank="a")).select("path").collect()
    assert {r.path for r in got} == {p for p, c in pairs if c == "text 0"}


def test_unequal_contents_that_share_a_mark(spark, monkeypatch):
    monkeypatch.setattr(contents, "mark", lambda content: F.hex(F.substring(content, 1, 1)))
    df = rows(spark, [(f"d/{i:02}", f"{'ab'[i % 2]} {i % 5}") for i in range(40)] + [("e/1", "c 1"), ("e/2", "c 1"), ("e/3", "d 1")])
    want = sieve.duplicates(df, Config(rank="a")).select("path", "is_original").collect()
    got = sieve.duplicates(df, Config(rank="a", algorithm="paranoid")).select("path", "is_original", "checksum").collect()
    assert len(want) == 42 and {(r.path, r.is_original) for r in got} == {(r.path, r.is_original) for r in want}
    names = {r.path: r.checksum for r in got}
    assert len(set(names.values())) == 11 and names["d/00"] == names["d/10"] != names["d/02"] and names["e/1"] == "63"


def test_hot_groups_are_sorted_across_tasks(spark, monkeypatch):
    pairs = [(f"d{i % 3}/{random.Random(i).random():.9f}", "hot" if i % 4 else f"rare {i % 20}") for i in range(600)]
    cfg = Config(rank="a", mtime_window=2.5)
    shown = lambda: sorted(tuple(r) for r in sieve.duplicates(rows(spark, pairs).withColumn("mtime", F.floor(F.col("mtime") / 10) * 40 + F.col("mtime") % 10), cfg).select("path", "island", "rank_in_group", "twins", "is_original").collect())
    want = shown()
    monkeypatch.setattr(rank, "HOT_ROWS", 50)
    calls = []
    monkeypatch.setattr(rank, "in_ranges", lambda *a, made=rank.in_ranges: calls.append(1) or made(*a))
    assert shown() == want and len(want) > 400 and calls


def brute_dirs(files):
    """Directories from the top down, by hand."""
    by = {}
    for path, content in files:
        by.setdefault(content, []).append(path)
    dupes = {p: c for c, ps in by.items() if len(ps) > 1 for p in ps}
    all_dirs = {}
    for path, _ in files:
        parts = path.split("/")
        for k in range(1, len(parts)):
            all_dirs.setdefault("/".join(parts[:k]), []).append(path)
    sig = {d: tuple(sorted(dupes[p] for p in ps)) for d, ps in all_dirs.items() if all(p in dupes for p in ps)}
    sig = {d: s for d, s in sig.items() if not (os.path.dirname(d) in sig and sig[os.path.dirname(d)] == s)}
    groups = {}
    for d, s in sig.items():
        groups.setdefault(s, []).append(d)
    closed, out = [], {}
    for s in sorted((s for s in groups if len(groups[s]) > 1), key=lambda s: -len(s)):
        own = [d for d in groups[s] if not any(d.startswith(c + "/") for c in closed)]
        if len(own) > 1:
            own.sort(key=lambda d: (os.path.basename(d), d))
            for k, d in enumerate(own):
                out[d] = k == 0
            closed += own[1:]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_every_reported_group_has_an_original(spark, seed):
    r = random.Random(seed)
    blocks = [[(f"{n}", r.choice("abc")) for n in range(r.randint(1, 2))] for _ in range(3)]
    files = []

    def grow(at, depth):
        for n, c in r.choice(blocks):
            files.append((f"{at}/f{n}", c))
        for k in range(r.randint(0, 2) if depth < 3 else 0):
            grow(f"{at}/s{k}", depth + 1)

    for top in range(5):
        grow(f"r/t{top}", 0)
    files += [("r/u/one/x", "q"), ("r/u/two/x", "q"), ("r/v/one/x", "q"), ("r/v/two/x", "q"), ("r/w/x", "q")]
    df = rows(spark, files)
    cfg = Config(rank="a")
    found = {x["dir"]: x.is_original for x in directories.duplicate_dirs(df, sieve.sieve(df, cfg), cfg).collect()}
    assert found == brute_dirs(files)


def test_originals_inside_a_closed_directory(spark):
    """The best-ranked of four equal directories lies in a closed one: the others still have an original."""
    files = [("r/a/in/x", "1"), ("r/a/y", "2"), ("r/b/in/x", "1"), ("r/b/y", "2"), ("r/zz/x", "1"), ("r/yy/x", "1")]
    df = rows(spark, files)
    got = {x["dir"]: (x.is_original, x.twins) for x in directories.duplicate_dirs(df, sieve.sieve(df, Config(rank="a")), Config(rank="a")).collect()}
    assert got == {"r/a": (True, 2), "r/b": (False, 2), "r/a/in": (True, 3), "r/yy": (False, 3), "r/zz": (False, 3)}
    again = rows(spark, [("r/b/in/x", "1"), ("r/b/y", "2"), ("r/a/jn/x", "1"), ("r/a/y", "2"), ("r/zz/x", "1"), ("r/yy/x", "1")])
    got = {x["dir"]: x.is_original for x in directories.duplicate_dirs(again, sieve.sieve(again, Config(rank="a")), Config(rank="a")).collect()}
    assert got == {"r/a": True, "r/b": False, "r/a/jn": True, "r/yy": False, "r/zz": False}  # r/b/in, the first by name, is closed


def test_layout_counts_where_asked(spark):
    df = rows(spark, [("r/a/s/x", "1"), ("r/a/y", "2"), ("r/b/s/x", "1"), ("r/b/y", "2"), ("r/c/x", "1"), ("r/c/y", "2")])
    cfg = Config(rank="a", honour_layout=True)
    found = {x["dir"] for x in directories.duplicate_dirs(df, sieve.sieve(df, cfg), cfg).collect()}
    assert {"r/a", "r/b"} <= found and "r/c" not in found


def test_unread_contents_are_unequal(spark):
    df = rows(spark, [("a", None), ("b", None)]).withColumn("size", F.lit(3).cast("long"))
    assert not relations.equal_verdict(df, 2).first().is_equal
    assert not relations.equal_verdict(rows(spark, [("a", "x"), ("b", None)]), 2).first().is_equal
    assert relations.equal_verdict(rows(spark, [("a", "x"), ("b", "x")]), 2).first().is_equal
    assert relations.equal_verdict(df.withColumn("inode", F.lit(5).cast("long")), 2).first().is_equal  # links of one file


def test_files_are_read_in_stages(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)

    write("a/one", b"x" * 50_000)
    write("b/two", b"x" * 50_000)
    write("b/late", b"x" * 49_999 + b"y")
    write("b/early", b"y" + b"x" * 49_999)
    write("c/small", b"xy")
    write("c/same", b"xy")
    write("c/other", b"xz")
    os.link(tmp_path / "a/one", tmp_path / "a/linked")
    with open(tmp_path / "unique", "wb") as f:  # no one has time to read that
        f.truncate(1 << 42)
    for name in ("twin1", "twin2"):
        with open(tmp_path / name, "wb") as f:
            f.write(name.encode())
            f.truncate(1 << 41)
    files = fs.read_tree(spark, [(str(tmp_path), 0, False)]).filter("kind = 'file'")
    want = {"a/one", "a/linked", "b/two", "c/small", "c/same"}
    for algorithm in ("blake2b", "sha256", "paranoid", "xxhash", "cumulative"):
        got = sieve.duplicates(files, Config(algorithm=algorithm, rank="a")).collect()
        assert {os.path.relpath(r.path, tmp_path) for r in got} == want, algorithm
        assert sum(r.is_original for r in got) == 2
    found = sieve.uniques(files, Config()).select("path").collect()
    assert "unique" in {os.path.relpath(r.path, tmp_path) for r in found}


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(RuntimeError):
        stage.shared_dir(Session)


def test_a_run_leaves_no_stage_behind(spark, tmp_path):
    folder = stage.shared_dir(spark)
    before = set(os.listdir(folder))
    cfg = Config(rank="a", merge_directories=True, sort_groups="a")
    with stage.passing():
        report = pipeline.run(rows(spark, [("r/a/f", "same"), ("r/b/f", "same"), ("r/c/f", "same"), ("r/c/g", "other")]), cfg, ["r"])
        with stage.passing():
            stage.once(spark.range(3), "inner")
            inside = set(os.listdir(folder))
        left = set(os.listdir(folder))
        assert left < inside and before < left  # the inner block ended with its own table alone
        report.directories.write.parquet(str(tmp_path / "dirs"))
        report.duplicates.write.parquet(str(tmp_path / "files"))
    assert set(os.listdir(folder)) == before
    assert {r["dir"] for r in spark.read.parquet(str(tmp_path / "dirs")).collect()} == {"r/a", "r/b"}
    with pytest.raises(ZeroDivisionError), stage.passing():
        stage.once(spark.range(3), "failing")
        1 / 0
    assert set(os.listdir(folder)) == before
    kept = stage.once(spark.range(3), "kept")
    assert kept.count() == 3 and set(os.listdir(folder)) > before
    stage.forget(kept)


def test_chained_digests():
    raw = random.Random(1).randbytes(1_200_000)
    for name in ("sha256-chain", "BLAKE2B-chain", "sha3-chain"):
        for length in (0, 5, 1 << 14, (1 << 14) + 1, 1 << 20, len(raw)):
            whole = digests.streamed([raw[:length]], name)
            assert whole == digests.streamed([raw[i : min(i + 999, length)] for i in range(0, length, 999)], name)
            assert (whole == digests.streamed([raw[:length]], name.lower().removesuffix("-chain"))) == (length <= 1 << 14)
            for at in (b for b in digests.LINKS if b <= length):
                again = digests.new_state(name, at, digests.streamed([raw[:at]], name))
                again.update(raw[at:length])
                assert again.hexdigest() == whole
    for name in ("xxhash-chain", "paranoid-chain", "-chain"):
        with pytest.raises(ValueError):
            digests.canonical_name(name)


def test_stages_of_a_chain_read_nothing_twice(spark, tmp_path, monkeypatch):
    """What an earlier stage has read is overwritten before the next one: only a stage that reads it again can see that."""
    big = random.Random(2).randbytes((1 << 20) + 70_000)
    late = big[:-1] + bytes([big[-1] ^ 1])
    middle = big[:500_000] + b"\0\1" + big[500_002:]
    expected = {"big1", "big2", "mid1", "mid2"}
    real = contents.once

    def run(algorithm, spoil):
        for name, text in {"big1": big, "big2": big, "late": late, "middle": middle, "mid1": big[:90_000], "mid2": big[:90_000], "short": big[:16384]}.items():
            (tmp_path / name).write_bytes(text)
        files = fs.read_tree(spark, [(str(tmp_path), 0, False)]).filter("kind = 'file'")
        seen = []

        def spoiling(df, name):
            out = real(df, name)
            if spoil and name == "survivors":
                seen.append(name)
                done = [0, 1 << 14, 1 << 20][min(len(seen), 3) - 1]
                with open(tmp_path / "big2", "r+b") as f:
                    f.write(b"#" * done)
            return out

        monkeypatch.setattr(contents, "once", spoiling)
        got = sieve.duplicates(files, Config(algorithm=algorithm, rank="a")).select("path", "checksum").collect()
        return {os.path.relpath(r.path, tmp_path): r.checksum for r in got}

    plain = run("blake2b", False)
    chained = run("blake2b-chain", False)
    assert set(plain) == set(chained) == expected
    assert chained["big1"] == digests.streamed([big], "blake2b-chain") and chained["mid2"] == digests.streamed([big[:90_000]], "blake2b-chain")
    assert run("blake2b-chain", True) == chained
    assert set(run("blake2b", True)) == {"mid1", "mid2"}


def test_columns_and_files_have_the_same_chain(spark, tmp_path):
    text = "abc " * 20_000
    for name in ("a", "b"):
        (tmp_path / name).write_text(text)
    files = fs.read_tree(spark, [(str(tmp_path), 0, False)]).filter("kind = 'file'")
    cfg = Config(algorithm="sha256-chain", rank="a")
    want = digests.streamed([text.encode()], "sha256-chain")
    assert {r.checksum for r in sieve.duplicates(files, cfg).collect()} == {want}
    assert {r.checksum for r in sieve.duplicates(rows(spark, [("a", text), ("b", text)]), cfg).collect()} == {want}
