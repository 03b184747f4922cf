"""The equality sieve: records group by size and names, then by a digest of a prefix, then by the whole content.

Only metadata and digests go through a shuffle: the records without content are written once, and the stages work on that table.
Contents are read where they are, in a column (two scans) or in files (only those that still have a partner); see ``contents``.
Byte comparison alone moves contents, of records whose digest has a partner.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.digests import digest
from ..plans.config import Config
from . import rank
from .contents import InColumn, InFile, sliced
from .records import effective, newer, one_per_inode
from .stage import once

TOLERANCE = 1e-6


def name_keys(cfg: Config) -> dict[str, Column]:
    """Further keys of a group; no extension equals no extension alone."""
    path, out = F.col("path"), {}
    if cfg.match_basename:
        out["key_basename"] = C.fold_case(C.basename(path))
    if cfg.match_extension:
        out["key_extension"] = F.coalesce(C.fold_case(C.extension(path)), F.lit("\0"))
    if cfg.match_stem:
        out["key_stem"] = C.fold_case(C.stem(path))
    return out


def size_keys(cfg: Config) -> list[str]:
    return ["eff_size", "start", "is_symlink", *name_keys(cfg)]


def qualified(records: DataFrame, cfg: Config, group: list[str]) -> DataFrame:
    """Records of groups that have two members and the (un)tagged and new members that are asked for."""
    asked = [F.count("*").alias("__n"), F.max("is_new").alias("__new")]
    rule = (F.col("__n") >= 2) & F.col("__new")
    if cfg.needs_tagged:
        asked.append(F.max("is_tagged").alias("__tagged"))
        rule &= F.col("__tagged")
    if cfg.needs_untagged:
        asked.append(F.min("is_tagged").alias("__all_tagged"))
        rule &= ~F.col("__all_tagged")
    if cfg.differing_basename:
        name = C.fold_case(C.basename(F.col("path")))
        asked += [F.min(name).alias("__low"), F.max(name).alias("__high")]
        rule &= F.col("__low") != F.col("__high")
    counts = records.groupBy(*group).agg(*asked)
    return rank.with_groups(records, counts, group, rule)


def prepared(records: DataFrame, cfg: Config) -> DataFrame:
    """Records with effective sizes, name keys and outer link counts."""
    return _described(newer(effective(records, cfg), cfg), cfg)


def _described(records: DataFrame, cfg: Config) -> DataFrame:
    for name, key in name_keys(cfg).items():
        records = records.withColumn(name, key)
    if cfg.hardlinks:
        return rank.with_outer_links(records, size_keys(cfg))
    return one_per_inode(records.withColumn("outer_link_count", F.col("link_count") - 1), F.col("path_index"))


def sieve(records: DataFrame, cfg: Config) -> DataFrame:
    """Members of groups of equal content: the records without content, and with ``checksum``.

    Contents are in the column ``content``; records without that column are files, read by path.  Records have a path each.
    A null content, as of a record that can't be read, leaves the record out.  With a cached checksum in every member of a size
    group nothing is read for it.  ``paranoid`` groups by the content itself and shows its sha256.
    """
    group = size_keys(cfg)
    paranoid = cfg.algorithm == "paranoid"
    ready = newer(effective(records, cfg), cfg)
    source = (InColumn if "content" in records.columns else InFile)(ready, cfg.prefix_bytes, cfg.algorithm)
    rows = once(_described(source.rows(), cfg), "records")
    known = source.known(rows)
    if known is not None:
        members = known.withColumn("checksum", F.coalesce("cached_checksum", "checksum")).filter("checksum IS NOT NULL").drop("prefix")
        return split(qualified(members, cfg, _content_keys(cfg)), cfg, rows)
    some_cached = bool(rows.filter("cached_checksum IS NOT NULL").limit(1).count())

    def alive(members: DataFrame, beginning: Column) -> DataFrame:
        """Members that share size, names and beginning with another one."""
        members = members.withColumn("__begin", beginning.cast("string"))
        if some_cached:  # a group in which a checksum is cached can't be told apart by beginnings: its members share one
            cached = members.groupBy(*group).agg(F.count("*").alias("__n"), F.count("cached_checksum").alias("__cached"))
            members = rank.with_groups(members, cached, group, F.lit(True), "__cached").withColumn("__begin", F.when(F.col("__cached") > 0, F.lit("")).otherwise(F.col("__begin"))).drop("__cached")
        begun = [*group, "__begin"]
        return rank.with_groups(members, members.groupBy(*begun).agg(F.count("*").alias("__n")), begun, F.col("__n") >= 2).drop("__begin")

    members = source.staged(qualified(rows, cfg, group) if source.reads_files else rows, alive)
    if paranoid:
        members = source.compared(members, group)
    else:
        found = source.digests(members, F.col("cached_checksum").isNull(), cfg.algorithm)
        members = found.withColumn("checksum", F.coalesce("cached_checksum", "checksum")).filter("checksum IS NOT NULL")
    members = once(members.drop("prefix"), "digests")  # what follows reads it several times, and the contents should be read once
    return split(qualified(members, cfg, _content_keys(cfg)), cfg, rows)


def _content_keys(cfg: Config) -> list[str]:
    return [*size_keys(cfg), "checksum"]


def group_keys(cfg: Config) -> list[str]:
    """What names a group of the result."""
    return [*_content_keys(cfg), *(["island"] if cfg.mtime_window >= 0 else [])]


def split(members: DataFrame, cfg: Config, rows: DataFrame) -> DataFrame:
    """Groups of equal content, cut by differing basenames and by gaps in time, and qualified again.  ``rows`` is the written table that the members are of."""
    keys = _content_keys(cfg)
    if cfg.differing_basename:
        heads = members.groupBy(*keys).agg(F.count("*").alias("__n"), F.min_by(F.struct("path"), rank.order(cfg)).alias("__head"))
        members = rank.with_groups(members, heads, keys, F.lit(True), "__head")
        same = (C.fold_case(C.basename(F.col("path"))) == C.fold_case(C.basename(F.col("__head.path")))) & (F.col("path") != F.col("__head.path"))
        members = members.filter(~same).drop("__head")
    if cfg.mtime_window >= 0:
        members = islands(members, keys, cfg.mtime_window, rows.count() > rank.HOT_ROWS)
    if cfg.differing_basename or cfg.mtime_window >= 0:
        members = qualified(members, cfg, group_keys(cfg))
    return members


def islands(members: DataFrame, keys: list[str], window: float, many_rows: bool = True) -> DataFrame:
    """Adds ``island``: how many gaps in time beyond the window lie before a member, in its group."""
    by_time = Window.partitionBy(*keys).orderBy("mtime", "path")
    far = lambda a, b: F.when(a - b > window + TOLERANCE, 1).otherwise(0)
    gap = far(F.col("mtime"), F.lag("mtime").over(by_time))
    summed = lambda rows, step, over: rows.withColumn("__gap", step).withColumn("island", F.sum("__gap").over(over).cast("long")).drop("__gap")
    upto = Window.unboundedPreceding, Window.currentRow
    if many_rows:
        members = once(members, "members")
    few, many = rank.cut_by_heat(members, keys, members) if many_rows else (members, None)
    if many is None:
        return summed(few, gap, by_time.rowsBetween(*upto))
    # A group that is sorted across tasks: gaps within a part, gaps between parts, and their sums over the parts before.
    placed = rank.in_ranges(many, [*map(F.col, keys), F.col("mtime"), F.col("path")])
    inside = Window.partitionBy(*keys, "__part").orderBy("__at")
    local = summed(placed, far(F.col("mtime"), F.lag("mtime").over(inside)), inside.rowsBetween(*upto))
    ends = once(local, "islands").groupBy(*keys, "__part").agg(F.min("mtime").alias("__from"), F.max("mtime").alias("__to"), F.max("island").alias("__gaps"))
    parts = Window.partitionBy(*keys).orderBy("__part")
    ends = ends.withColumn("__gap", far(F.col("__from"), F.lag("__to").over(parts)))
    ends = ends.withColumn("__before", F.sum(F.col("__gap") + F.col("__gaps")).over(parts.rowsBetween(*upto)) - F.col("__gaps")).select(*keys, "__part", "__before")
    many = local.join(F.broadcast(ends), [*keys, "__part"]).withColumn("island", F.col("island") + F.col("__before")).drop("__part", "__at", "__before")
    return summed(few, gap, by_time.rowsBetween(*upto)).unionByName(many)


def duplicates(records: DataFrame, cfg: Config) -> DataFrame:
    """Members of duplicate groups with checksum, rank, twins and original flag."""
    group = group_keys(cfg)
    members = once(sieve(records, cfg), "members")
    return rank.ranked(rank.mark_originals(members, cfg, group), cfg, group, members).withColumn("type", F.lit("duplicate_file"))


def _readable(records: DataFrame, cfg: Config) -> DataFrame:
    """Without the records that the sieve has nothing to compare of: their content is null, and no cached checksum stands for it."""
    if "content" not in records.columns:
        return records
    return records.filter("content IS NOT NULL" if cfg.algorithm == "paranoid" else "content IS NOT NULL OR cached_checksum IS NOT NULL")


def _hashed(records: DataFrame, cfg: Config) -> DataFrame:
    """Records without content, with ``checksum`` where another record has the size: those are the ones that a run would have to read."""
    ready = effective(records, cfg)
    keys = ["eff_size", "start", "is_symlink"]
    shared = ready.drop("content").groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__shared", F.col("__n") > 1)
    algorithm = "sha256" if cfg.algorithm == "paranoid" else cfg.algorithm
    if "content" in records.columns:
        told = _readable(ready, cfg).withColumn("checksum", F.coalesce("cached_checksum", digest(sliced(F.col("content")), algorithm))).drop("content")
    else:
        sized = rank.with_groups(ready, shared, keys, F.col("__shared"))
        read = InFile(ready, 0).digests(sized, F.col("cached_checksum").isNull(), algorithm).select("path", F.coalesce("cached_checksum", "checksum").alias("checksum"))
        told = ready.join(read.dropDuplicates(["path"]), "path", "left")
    told = rank.with_groups(told, shared, keys, F.lit(True), "__shared")
    return told.withColumn("checksum", F.when(F.col("__shared"), F.col("checksum"))).drop("__shared", "start", "eff_size")


def uniques(records: DataFrame, cfg: Config, members: DataFrame | None = None) -> DataFrame:
    """Records without a partner; with ``keep_all_tagged`` (``_untagged``) those of the other side are no originals.

    A partner is one whatever its tag and age: a group that is not reported for these has no unique record.  Where ``members`` are given, records that are none of them count as unique.
    Only what is compared can be unique: a record with a null content or an empty slice is not.  With ``write_unfinished`` they have a checksum if they had to be read.
    """
    if members is None:
        members = sieve(records, replace(cfg, must_match_tagged=False, must_match_untagged=False, keep_all_tagged=False, keep_all_untagged=False, newer_than=None))
    others = members.select("path").distinct()
    compared = _hashed(records, cfg) if cfg.write_unfinished else _readable(effective(records, cfg), cfg).drop("content", "start", "eff_size")
    out = compared.join(others, "path", "left_anti").withColumn("type", F.lit("unique_file"))
    original = F.lit(True) if not (cfg.keep_all_tagged or cfg.keep_all_untagged) else (F.col("is_tagged") if cfg.keep_all_tagged else ~F.col("is_tagged"))
    return out.withColumn("is_original", original)
