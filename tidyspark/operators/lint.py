"""Other lint: empty, dangling, orphaned and unstripped records."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import columns as C
from ..plans import parsing
from ..plans.config import Config
from .directories import UNKNOWN


def type_rank(kind: Column) -> Column:
    """Place of a lint type in the order of emission."""
    return F.array_position(F.array(*map(F.lit, parsing.LINT_TYPES)), kind).cast("int") - 1


def bad_ids(records: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds ``type``: baduid, badgid, badugid or null.  ``users`` has uid and ``groups`` gid, the ids that are known."""
    u, g = users.select(F.col("uid"), F.lit(True).alias("__u")).distinct(), groups.select(F.col("gid"), F.lit(True).alias("__g")).distinct()
    out = records.join(u, "uid", "left").join(g, "gid", "left")
    no_user, no_group = F.col("__u").isNull(), F.col("__g").isNull()
    return out.withColumn("type", F.when(no_user & no_group, "badugid").when(no_user, "baduid").when(no_group, "badgid")).drop("__u", "__g")


def dangling(records: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Records whose reference ``key`` is in no row of ``targets``."""
    return records.join(targets.select(key).distinct(), key, "left_anti").withColumn("type", F.lit("badlink"))


def bad_links(records: DataFrame) -> DataFrame:
    """Symlinks whose target is missing (``target_exists`` false)."""
    return records.filter("is_symlink AND NOT target_exists").withColumn("type", F.lit("badlink"))


def empty_files(records: DataFrame) -> DataFrame:
    return records.filter("size = 0 AND NOT is_symlink").withColumn("type", F.lit("emptyfile"))


def empty_dirs(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Directories without a file anywhere below.  ``files`` has whatever makes a directory non-empty, skipped entries among it."""
    full = files.select(F.explode(C.ancestors(F.col("path"))).alias("path")).distinct()
    return dirs.join(full, "path", "left_anti").withColumn("type", F.lit("emptydir"))


def empty_dirs_of_tree(tree: DataFrame) -> DataFrame:
    """Empty directories of a scanned tree (``path, kind``), children before their parents.

    Any entry but a directory makes those above it non-empty: files, links, entries that were skipped (hidden, of another device, not permitted) and such as can't be read.
    A directory that was not entered or can't be listed is not known to be empty.
    """
    found = empty_dirs(tree.filter("kind = 'dir'").dropDuplicates(["path"]), tree.filter("kind <> 'dir'"))
    found = found.join(tree.filter(F.col("kind").isin(*UNKNOWN)).select("path").distinct(), "path", "left_anti")
    return found.orderBy(F.desc("path"))


_SECTION_SYMBOLS = 2  # type of a section with a symbol table


def symbols_in(read: Callable[[int, int], bytes]) -> bool:
    """Whether an ELF file has a section with a symbol table; ``read`` gives a number of bytes from a place on.  Only the header and the table of sections are read."""
    head = read(0, 64)
    if len(head) < 52 or head[:4] != b"\x7fELF" or head[4] not in (1, 2) or head[5] not in (1, 2):
        return False
    end, wide = "<" if head[5] == 1 else ">", head[4] == 2
    try:
        place = struct.unpack_from(end + ("Q" if wide else "I"), head, 40 if wide else 32)[0]
        step, count = struct.unpack_from(end + "HH", head, 58 if wide else 46)
        table = read(place, step * count)
        return any(struct.unpack_from(end + "I", table, k * step + 4)[0] == _SECTION_SYMBOLS for k in range(count))
    except struct.error:
        return False


def has_symbols(content: bytes | None) -> bool:
    """The same of a content."""
    return bool(content) and symbols_in(lambda start, n: content[start : start + n])


def _symbols_of(path: str) -> bool:
    try:
        with open(path, "rb", buffering=0) as f:
            return symbols_in(lambda start, n: os.pread(f.fileno(), n, start))
    except OSError:
        return False


@F.pandas_udf(BooleanType())
def not_stripped(content: pd.Series) -> pd.Series:
    return content.map(has_symbols)


@F.pandas_udf(BooleanType())
def file_not_stripped(path: pd.Series) -> pd.Series:
    return path.map(_symbols_of)


def nonstripped(records: DataFrame) -> DataFrame:
    """Executable regular files (``mode`` has an execute bit) with a symbol table in ``content``; without that column they are read by path, a few hundred bytes of each."""
    found = file_not_stripped("path") if "content" not in records.columns else not_stripped("content")
    return records.filter((F.col("mode").bitwiseAND(F.lit(0o111)) != 0) & ~F.col("is_symlink")).filter(found).withColumn("type", F.lit("nonstripped"))


def classified(records: DataFrame, cfg: Config) -> DataFrame:
    """Adds ``type`` by the fixed precedence: empty, (ids and stripping are looked up before, in ``id_type`` and ``has_symbols``), size, duplicate candidate.

    Null means that the record plays no further part.
    """
    kinds = cfg.types
    column = lambda name: F.col(name) if name in records.columns else F.lit(None)
    by_id = column("id_type").cast("string")
    return records.withColumn(
        "type",
        F.when(F.lit("emptyfile" in kinds) & (F.col("size") == 0), "emptyfile")
        .when(by_id.isin(*kinds), by_id)
        .when(F.lit("nonstripped" in kinds) & column("has_symbols").cast("boolean"), "nonstripped")
        .when(F.col("size").between(*cfg.size), "duplicate_file"),
    )


def reported(lint: DataFrame, cfg: Config) -> DataFrame:
    """Other lint that is new enough and not protected, with its place in the order of emission (``lint_rank``)."""
    if cfg.newer_than is not None:
        lint = lint.filter(F.col("mtime") >= cfg.newer_than)
    if cfg.keep_all_tagged:
        lint = lint.filter(~F.col("is_tagged"))
    if cfg.keep_all_untagged:
        lint = lint.filter("is_tagged")
    return lint.withColumn("lint_rank", type_rank(F.col("type")))
