"""Duplicate directories: directories all of whose files have a duplicate and whose contents are the same multiset.

What a directory holds is counted apart from what the sieve may look at: files that a filter leaves out, files that can't be read and places that the
walk didn't enter count, too, and have no duplicate, so no directory above them is a copy.

Every file is exploded to its ancestors, so counts and signatures of all levels come from one aggregation and no level-by-level
roll-up.  A signature is the number of files and the sums of two independent 64-bit hashes of their digests (with relative paths where the
layout counts): it tells multisets apart whatever the order, combines before the shuffle, and never gathers the files of a directory.

Which directories are reported is settled from the top down, as the originals of a group stay open to further reports while its other
directories are closed.  A round settles all groups that have no unsettled directory above theirs, so there are as many rounds as reported
candidates are nested; without nesting there is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.config import Config
from . import rank
from .stage import once


#: Kinds of rows of a walk behind which anything may lie.
UNKNOWN = ("skipped", "error")


def below(files: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """Each file with each directory above it (``dir``), none above the roots.  Where ``unknown`` is true the path itself may be a directory."""
    above = C.ancestors(F.col("path"))
    if "unknown" in files.columns:
        above = F.when(F.col("unknown"), F.array_append(above, F.col("path"))).otherwise(above)
    out = files.withColumn("dir", F.explode(above))
    if roots:
        inside = F.lit(False)
        for root in roots:
            clean = root.rstrip("/")
            inside = inside | (F.col("dir") == clean) | F.startswith(F.col("dir"), F.lit(clean + "/"))
        out = out.filter(inside)
    return out


def counted(source: DataFrame, cfg: Config) -> DataFrame:
    """``path, size, is_tagged, mtime, unknown``: what counts for the directories above, once a path, whatever the filters of the run.

    Everything but directories does, and empty files where those are lint of their own don't.  Records of a table without ``kind`` are files; a size that isn't known counts.
    """
    kind = F.col("kind") if "kind" in source.columns else F.lit("file")
    some = kind.isin(*UNKNOWN) | F.col("size").isNull() | (F.col("size") > 0) | F.lit("emptyfile" not in cfg.types)
    rows = source.filter((kind != "dir") & some).select("path", "size", "is_tagged", "mtime", kind.isin(*UNKNOWN).alias("unknown"))
    return rows.groupBy("path").agg(F.max("size").alias("size"), F.max("is_tagged").alias("is_tagged"), F.max("mtime").alias("mtime"), F.max("unknown").alias("unknown"))


def times(source: DataFrame) -> DataFrame | None:
    """``path, mtime`` of the directories of a walk."""
    return source.filter("kind = 'dir'").select("path", "mtime") if "kind" in source.columns else None


def signatures(files: DataFrame, members: DataFrame, cfg: Config, roots: list[str] | None = None, errors: DataFrame | None = None) -> DataFrame:
    """``dir, files, size, tagged, all_tagged, mtime, signature`` of directories all of whose files are in ``members``.

    ``files`` is what counts (see ``counted``); ``members`` path and checksum of those with a duplicate.  Nothing is known of what lies behind a path of ``errors``, so that no
    directory at or above it is a duplicate.
    """
    columns = ["path", "size", "is_tagged", "mtime", "unknown"]
    if "unknown" not in files.columns:
        files = files.withColumn("unknown", F.lit(False))
    if errors is not None:
        unread = errors.select("path", F.lit(0).cast("long").alias("size"), F.lit(False).alias("is_tagged"), F.lit(None).cast("double").alias("mtime"), F.lit(True).alias("unknown"))
        files = files.select(*columns).unionByName(unread.dropDuplicates(["path"]))
    known = members.select("path", "checksum")
    relative = F.substring(F.col("path"), F.length("dir") + 2, F.length("path"))
    item: list[Column] = [F.col("checksum"), *([relative] if cfg.honour_layout else [])]
    halves = [half for salt in (0, 1) for h in [F.xxhash64(F.lit(salt), *item)] for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]  # sums of 32 bits can't overflow
    sums = [F.sum(F.when(F.col("checksum").isNotNull(), half)).alias(f"__s{i}") for i, half in enumerate(halves)]
    joined = below(files.select(*columns).join(known, "path", "left"), roots)
    found = joined.groupBy("dir").agg(
        F.count("*").alias("files"), F.count(F.when(~F.col("unknown"), F.col("checksum"))).alias("dupes"), F.sum("size").alias("size"), F.sum(F.col("is_tagged").cast("long")).alias("tagged"), F.min("is_tagged").alias("all_tagged"), F.max("mtime").alias("mtime"), *sums,
    )
    signature = F.sha2(F.concat_ws("/", "files", *(f"__s{i}" for i in range(len(sums)))), 256)
    return found.filter("files = dupes").withColumn("signature", signature).drop("dupes", *(f"__s{i}" for i in range(len(sums))))


def qualified(dirs: DataFrame, cfg: Config) -> DataFrame:
    """Directories that share their signature with another one, which is no ancestor's only child holding the same files."""
    # A directory whose only content is one directory has that one's signature: the topmost of such a chain stands for it.
    chain = dirs.select(F.col("dir").alias("__child"), F.col("signature"), F.col("files"), C.dirname(F.col("dir")).alias("__parent"))
    if not cfg.honour_layout:
        same = dirs.select(F.col("dir").alias("__parent"), "signature", "files")
        only = chain.groupBy("__parent", "signature", "files").agg(F.min("__child").alias("dir"), F.count("*").alias("__n")).filter("__n = 1")  # a child with all of its parent's files is alone in having them
        inner = once(only.join(same, ["__parent", "signature", "files"]).select("dir"), "inner")
        dirs = dirs.join(inner, "dir", "left_anti")
    counts = dirs.groupBy("signature").agg(F.count("*").alias("twins"), F.count("*").alias("__n"), F.max(F.col("tagged") > 0).alias("__some"), F.min(F.col("tagged") > 0).alias("__every"))
    rule = F.col("twins") >= 2
    if cfg.needs_tagged:
        rule &= F.col("__some")
    if cfg.needs_untagged:
        rule &= ~F.col("__every")
    return rank.with_groups(dirs, counts, ["signature"], rule, "twins")


def marked(dirs: DataFrame, cfg: Config) -> DataFrame:
    """Groups of two or more in a written table, with ``twins``, ``is_original`` and ``rank_in_group``: most tagged files first (fewest where untagged ones are kept), then the rank criteria."""
    as_record = dirs.withColumn("path", F.col("dir")).withColumn("is_symlink", F.lit(False)).withColumn("is_tagged", F.col("tagged") > 0).withColumn("depth", C.path_depth(F.col("dir"))).withColumn("link_count", F.lit(1)).withColumn("outer_link_count", F.lit(0)).withColumn("path_index", F.lit(0))
    first = F.col("tagged") if cfg.keep_all_untagged else -F.col("tagged")
    out = rank.numbered(as_record.drop("twins"), ["signature"], F.struct(first.alias("t"), rank.order(cfg).alias("o")), dirs).filter("twins >= 2")
    protected = F.col("all_tagged") if cfg.keep_all_tagged else (F.col("tagged") == 0) if cfg.keep_all_untagged else F.lit(False)
    return out.withColumn("is_original", (F.col("rank_in_group") == 1) | protected).select(*(c for c in dirs.columns if c != "twins"), "twins", "depth", "rank_in_group", "is_original")


def settled(dirs: DataFrame, cfg: Config) -> DataFrame:
    """The reported directories of a written table of candidates.

    All but the first of a reported group are closed: no directory below them is reported.  What is left of a group is ranked anew, so
    every group has an original; a group with fewer than two left is none.
    """
    above = F.explode(C.ancestors(F.col("dir"))).alias("above")
    own = lambda rows: rows.select(F.col("dir").alias("above"), F.lit(True).alias("__own"))
    some = F.col("__own").isNotNull()
    counts = once(dirs.select(above).groupBy("above").agg(F.count("*").alias("__n")).join(own(dirs), "above", "left").filter(some | (F.col("__n") > rank.HOT_ROWS)), "above")
    if not counts.filter(some).limit(1).count():
        return marked(dirs, cfg)
    nested = once(rank.with_groups(dirs.select("dir", "signature", above), counts, ["above"], some), "nested")
    counts = counts.filter(some).drop("__own")
    below_any = lambda rows: rank.with_groups(nested, counts.join(own(rows), "above", "left"), ["above"], some)
    found = []
    left = dirs
    while left.limit(1).count():
        waiting = below_any(left).join(left.select("dir"), "dir", "left_semi").select("signature", F.lit(True).alias("__waits")).distinct()
        groups = left.groupBy("signature").agg(F.count("*").alias("__n")).join(waiting, "signature", "left")
        left = once(rank.with_groups(left, groups, ["signature"], F.lit(True), "__waits"), "left")
        ready = left.filter("__waits IS NULL").drop("__waits")
        done = once(marked(ready, cfg), "settled")
        found.append(done)
        inside = below_any(done.filter("rank_in_group > 1")).select("dir").distinct()
        left = once(left.filter("__waits").drop("__waits").join(inside, "dir", "left_anti"), "left")
    return reduce(DataFrame.unionByName, found)


def duplicate_dirs(files: DataFrame, members: DataFrame, cfg: Config, roots: list[str] | None = None, errors: DataFrame | None = None, dir_times: DataFrame | None = None) -> DataFrame:
    """Reported directories: ``dir, signature, n_children, size, twins, rank_in_group, is_original, type``."""
    found = signatures(files, members, cfg, roots, errors)
    if dir_times is not None:  # the rank criteria look at a directory's own time where it is known (``path, mtime``)
        own = dir_times.select(F.col("path").alias("dir"), F.col("mtime").alias("__own")).dropDuplicates(["dir"])
        found = found.join(own, "dir", "left").withColumn("mtime", F.coalesce("__own", "mtime")).drop("__own")
    twins = once(qualified(once(found, "signatures"), cfg), "twins")
    if cfg.hidden == "partial":  # hidden directories are not reported, and what is left of their groups is ranked without them
        twins = once(twins.filter(~F.startswith(C.basename(F.col("dir")), F.lit("."))), "twins")
    found = settled(twins, cfg)
    if cfg.keep_all_tagged or cfg.keep_all_untagged:  # groups of protected directories alone go
        found = rank.with_groups(found, found.groupBy("signature").agg(F.count("*").alias("__n"), F.min("is_original").alias("__all")), ["signature"], ~F.col("__all"))
    return found.select("dir", "signature", F.col("files").alias("n_children"), "size", "mtime", "depth", "twins", "rank_in_group", "is_original", F.lit("duplicate_dir").alias("type"))


def parts(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """``part_of_directory`` rows: every file below a reported directory, with ``parent_path``."""
    inside = below(files)
    inside = rank.met(inside, dirs.select("dir", "is_original"), ["dir"], rank.hot_keys(inside, ["dir"]))
    return inside.withColumnRenamed("dir", "parent_path").withColumn("type", F.lit("part_of_directory"))


def leftovers(members: DataFrame, dirs: DataFrame, cfg: Config, group: list[str]) -> DataFrame:
    """Duplicate files outside the reported directories that are closed, grouped and ranked anew; hidden ones go in partial mode."""
    closed = dirs.filter("rank_in_group > 1").select("dir")
    inside = below(members.select("path"))
    covered = rank.met(inside, closed, ["dir"], rank.hot_keys(inside, ["dir"]), "left_semi").select("path").distinct()
    left = members.join(covered, "path", "left_anti")
    if cfg.hidden == "partial":
        left = left.filter(~F.col("is_hidden"))
    left = once(left, "uncovered")
    left = once(rank.with_groups(left, left.groupBy(*group).agg(F.count("*").alias("__n")), group, F.col("__n") >= 2), "leftovers")
    return rank.ranked(rank.mark_originals(left, cfg, group), cfg, group, left).withColumn("type", F.lit("duplicate_file"))


def unfinished(members: DataFrame, reported: DataFrame) -> DataFrame:
    """Duplicates that are no row of the result, as ``unique_file`` rows with their checksums: those inside closed directories, and those whose partners all are.

    ``reported`` has the paths of duplicate files in the result.
    """
    return members.join(reported.select("path").distinct(), "path", "left_anti").withColumn("type", F.lit("unique_file")).withColumn("is_original", F.lit(True))
