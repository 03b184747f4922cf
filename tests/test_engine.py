"""Small file trees as rows, with the outcomes that their options ask for."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidyspark.operators import directories, lint, rank, records, relations, sieve, tree
from tidyspark.plans import parsing, query_language, requery
from tidyspark.plans.config import Config
from tidyspark.plans.pipeline import run
from tidyspark.sinks import formats, scripts

SCHEMA = "path string, content string, mtime double, inode long, is_tagged boolean, link_count int, is_symlink boolean, extra int"


def table(spark, rows):
    full = [(p, c, *(more + (0.0, None, False, 1, False)[len(more) :]), 1) for p, c, *rest in rows for more in [tuple(rest)]]
    df = spark.createDataFrame(full, SCHEMA)
    return records.as_records(df, F.col("path"), F.col("content"), mtime=F.col("mtime"), inode=F.coalesce("inode", F.xxhash64("path")), is_tagged=F.col("is_tagged"), link_count=F.col("link_count"), is_symlink=F.col("is_symlink"))


def found(df):
    return {r.path: r.is_original for r in df.collect()}


@pytest.mark.parametrize("prefix, algorithm", [(16384, "sha256"), (0, "blake2b"), (2, "md5"), (2, "xxhash"), (0, "paranoid")])
def test_stages_and_algorithms_agree(spark, prefix, algorithm):
    rows = [("a/one", "xxxyyy"), ("b/two", "xxxyyy"), ("c", "xxxzzz"), ("d", "x"), ("e", ""), ("f", "xxxyyy"), ("g", None), ("h", "zz"), ("i", "zy")]
    cfg = Config(prefix_bytes=prefix, algorithm=algorithm, rank="a")
    got = sieve.duplicates(table(spark, rows).filter("size > 0 OR size IS NULL"), cfg).collect()
    assert sorted((r.path, r.rank_in_group, r.twins, r.is_original) for r in got) == [("a/one", 2, 3, False), ("b/two", 3, 3, False), ("f", 1, 3, True)]


ORIGS = [("stuff/a", "xxx"), ("stuff/b", "yyy"), ("more/a", "xxx"), ("more/c", "zzz"), ("more/d", "zzz"), ("back/a", "xxx", 0.0, None, True), ("back/b", "yyy", 0.0, None, True), ("back/b2", "yyy", 0.0, None, True), ("back/y", "only", 0.0, None, True)]


def brute(rows, **how):
    out = {}
    for content in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == content), key=lambda r: ((len(r) > 4) == bool(how.get("keep_all_untagged") or how.get("must_match_untagged")), r[0].rpartition("/")[2], r[0]))
        tagged = [len(r) > 4 for r in own]
        if len(own) < 2 or (how.get("must_match_tagged") or how.get("keep_all_untagged")) and not any(tagged) or (how.get("must_match_untagged") or how.get("keep_all_tagged")) and all(tagged):
            continue
        marks = [k == 0 or t and bool(how.get("keep_all_tagged")) or not t and bool(how.get("keep_all_untagged")) for k, t in enumerate(tagged)]
        if not all(marks):
            out |= {r[0]: m for r, m in zip(own, marks)}
    return out


@pytest.mark.parametrize("flags", [(), ("keep_all_tagged",), ("keep_all_untagged",), ("must_match_tagged",), ("must_match_untagged",), ("keep_all_tagged", "must_match_tagged"), ("keep_all_untagged", "must_match_untagged")])
def test_tags(spark, flags):
    how = dict.fromkeys(flags, True)
    assert found(sieve.duplicates(table(spark, ORIGS), Config(rank="a", **how))) == brute(ORIGS, **how)


def test_mtime_window(spark):
    rows = [(n, "xxx", t) for n, t in zip("abcd", (42.0, 42.0, 44.0, 45.0))]
    for window, members, sets in ((-1, 4, 1), (0, 2, 1), (1, 4, 2), (2, 4, 1)):
        got = sieve.duplicates(table(spark, rows), Config(mtime_window=window)).collect()
        assert (len(got), len({getattr(r, "island", 0) if window >= 0 else 0 for r in got})) == (members, sets)
    assert sieve.duplicates(table(spark, [("a", "xxx", 42.0), ("b", "yyy", 44.0), ("c", "xxx", 46.0)]), Config(mtime_window=3)).count() == 0


def test_names_and_clamps(spark):
    rows = [("d1/a.png", "xxx"), ("d2/A.PNG", "xxx"), ("d3/a.jpg", "xxx"), ("d4/b", "xxx")]
    for how, want in (({"match_basename": True}, {"d1/a.png", "d2/A.PNG"}), ({"match_extension": True}, {"d1/a.png", "d2/A.PNG"}), ({"match_stem": True}, {"d1/a.png", "d2/A.PNG", "d3/a.jpg"}), ({"differing_basename": True}, {"d1/a.png", "d3/a.jpg", "d4/b"})):
        assert set(found(sieve.duplicates(table(spark, rows), Config(rank="p", **how)))) == want, how
    ends = [("a", "1234567890"), ("b", "x23456789x")]
    for low, high, n in (("1", "9", 2), (".1", ".9", 2), ("10%", "90%", 2), ("0", "9", 0)):
        assert sieve.duplicates(table(spark, ends), Config(clamp_low=parsing.clamp(low), clamp_high=parsing.clamp(high))).count() == n


def test_newer_than(spark):
    rows = [("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 1.0), ("d", "y", 1.0)]
    assert set(found(sieve.duplicates(table(spark, rows), Config(newer_than=2.0)))) == {"a", "b"}


def test_rank_orders(spark):
    rows = [(f"{d}/{n}", "xxx", t) for (d, n, t) in (("b_dir", "a", 3.5), ("a_dir", "c", 3.25), ("c_dir", "b", 1.0), ("d", "longer", 2.0))]
    keys = {"a": lambda r: r[0].rpartition("/")[2], "m": lambda r: r[2], "l": lambda r: len(r[0].rpartition("/")[2]), "d": lambda r: r[0].count("/")}
    df = table(spark, rows).cache()
    for spec in ["".join(c) for c in itertools.permutations("aml", 2)] + ["A", "M", "L", "Lm", "x<o>", "X<o>", "r<a_dir>A"]:
        order = sorted(rows)
        for c in reversed(parsing.rank(spec)):
            key = (lambda r, p=c.pattern: p not in r[0].rpartition("/")[2]) if c.letter == "x" else (lambda r, p=c.pattern: p not in r[0]) if c.letter == "r" else keys[c.letter]
            order.sort(key=key, reverse=c.reverse)
        got = sieve.duplicates(df, Config(rank=spec)).orderBy("rank_in_group").collect()
        if "L" not in spec:
            assert [r.path for r in got] == [r[0] for r in order], spec
        assert got[0].is_original


def test_hardlinks(spark):
    rows = [("a", "xxx", 0.0, 1, False, 2), ("b", "xxx", 0.0, 1, False, 2), ("sub/a", "xxx", 0.0, 2, False, 2), ("sub/b", "xxx", 0.0, 2, False, 2)]
    cfg = Config(rank="a")
    group = sieve.group_keys(cfg)
    all_four = sieve.duplicates(table(spark, rows), cfg)
    assert rank.totals(all_four, cfg, group).first().total_lint_size == 3
    assert rank.totals(sieve.duplicates(table(spark, rows[2:]), cfg), cfg, group).first().total_lint_size == 0
    kept = found(sieve.duplicates(table(spark, rows), Config(rank="a", keep_hardlinked=True)))
    assert sum(kept.values()) == 2
    assert sieve.duplicates(table(spark, rows), Config(hardlinks=False)).count() == 2


def test_links_never_match_files(spark):
    assert sieve.duplicates(table(spark, [("foo", "xxx"), ("file", "foo"), ("link", "foo", 0.0, None, False, 1, True)]), Config()).count() == 0


def test_directories(spark):
    files = table(spark, [("r/a/sub2/x", "1"), ("r/a/sub1/y", "2"), ("r/b/x", "1"), ("r/b/y", "2"), ("r/c", "1"), ("r/d/e/z", "3"), ("r/d/only", "4"), ("r/f/e/z", "3")])
    cfg = Config(rank="a")
    members = sieve.sieve(files, cfg)
    dirs = directories.duplicate_dirs(files, members, cfg, ["r"])
    assert sorted((r["dir"], r.n_children, r.is_original) for r in dirs.collect()) == [("r/a", 2, True), ("r/b", 2, False), ("r/d/e", 1, True), ("r/f", 1, False)]
    assert {(r.path, r.parent_path) for r in directories.parts(files.drop("content"), dirs).collect()} == {("r/a/sub2/x", "r/a"), ("r/a/sub1/y", "r/a"), ("r/b/x", "r/b"), ("r/b/y", "r/b"), ("r/d/e/z", "r/d/e"), ("r/f/e/z", "r/f")}
    left = directories.leftovers(members, dirs, cfg, sieve.group_keys(cfg))
    assert sorted(r.path for r in left.collect()) == ["r/a/sub2/x", "r/c"]
    layout = Config(rank="a", honour_layout=True)
    assert "r/b" not in {r["dir"] for r in directories.duplicate_dirs(files, members, layout, ["r"]).collect()}


def test_lint(spark):
    dirs = spark.createDataFrame([(d,) for d in ("r/full", "r/none", "r/none/in", "r/full/empty")], "path string")
    files = spark.createDataFrame([("r/full/x",)], "path string")
    assert {r.path for r in lint.empty_dirs(dirs, files).collect()} == {"r/none", "r/none/in", "r/full/empty"}
    people = spark.createDataFrame([(1, 1, "ok"), (9, 1, "u"), (1, 9, "g"), (9, 9, "ug"), (None, 1, "n")], "uid long, gid long, path string")
    known = spark.createDataFrame([(1,)], "uid long"), spark.createDataFrame([(1,)], "gid long")
    assert {r.path: r.type for r in lint.bad_ids(people, *known).collect()} == {"ok": None, "u": "baduid", "g": "badgid", "ug": "badugid", "n": "baduid"}
    assert not lint.has_symbols(b"\x7fELF" + b"\0" * 80) and not lint.has_symbols(None)


def test_reports_and_sinks(spark, tmp_path):
    df = table(spark, [*ORIGS, ("it's, \"odd\"", "xxx")])
    report = run(df, Config(rank="a", sort_groups="nS"))
    assert report.footer.first().duplicates == 6 and {r.group_rank for r in report.duplicates.collect()} == {1, 2, 3}
    out = report.duplicates
    formats.write_json(out, str(tmp_path / "r.json"), header={"cwd": "/"}, footer={"duplicates": 6})
    from tidyspark.sources.results import read_header, read_results

    back = read_results(spark, str(tmp_path / "r.json"))
    assert sorted(r.path for r in back.collect()) == sorted(r.path for r in out.collect()) and read_header(spark, str(tmp_path / "r.json")).first().cwd == "/"
    again = requery.requery([back], Config(rank="a"))
    assert found(again).keys() == found(out).keys()
    formats.write_json(out, str(tmp_path / "r.json"))
    assert len(list(tmp_path.glob("r.*.json"))) == 1
    formats.write_csv(out, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == out.count()
    group = sieve.group_keys(Config())
    assert any("odd" in r.value for r in scripts.script_lines(formats.actions(out, group)).collect())
    assert formats.summary(out, group, 10).first().duplicates == 6 and len(list(formats.pretty(out))) == out.count() + 1
    assert query_language.query(out, "size:3 count:2").count() == 2
    assert sorted(r.path for r in formats.unique_paths(report.uniques).withColumnRenamed("value", "path").collect()) == ["back/y"]


def test_relations(spark):
    df = table(spark, [("a", "x"), ("b", "x"), ("c", "y")])
    assert relations.equal_verdict(df.filter("path < 'c'"), 2).first().is_equal and not relations.equal_verdict(df, 3).first().is_equal
    assert not relations.equal_verdict(df.filter("path = 'a'"), 2).first().is_equal
    tree_rows = {r.path: (r.n, r.size) for r in tree.roll_up(table(spark, [("r/a/x", "12"), ("r/y", "1")])).collect()}
    assert tree_rows == {"r": (2, 3), "r/a": (1, 2)}


def test_large_group_of_copies(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("d/"), F.col("id")).alias("path"), F.lit("same").alias("content"))
    got = sieve.duplicates(records.as_records(rows, F.col("path"), F.col("content")), Config(rank="a"))
    assert got.filter("is_original").collect()[0].path == "d/0" and got.count() == 20_000
