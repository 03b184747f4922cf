"""Set operations on results and relations of pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.digests import digest
from ..plans.config import Config
from . import directories


def union_results(results: list[DataFrame]) -> DataFrame:
    """All rows with ``source_idx``; groups with equal type and checksum are one from then on."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (r.withColumn("source_idx", F.lit(k)) for k, r in enumerate(results)))


def distinct_entries(rows: DataFrame, group: list[str]) -> DataFrame:
    """Each path once in its group; parts of directories are exempt."""
    part = F.col("type") == "part_of_directory"
    return rows.filter(~part).dropDuplicates([*group, "path"]).unionByName(rows.filter(part))


def without(rows: DataFrame, others: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(others.select(key).distinct(), key, "left_anti")


def in_both(rows: DataFrame, side: Column, group: list[str]) -> DataFrame:
    """Rows of groups with members on both sides."""
    counts = rows.groupBy(*group).agg(F.max(side).alias("__a"), F.min(side).alias("__b")).filter("__a AND NOT __b")
    return rows.join(counts.select(*group), group, "left_semi")


def equal_verdict(records: DataFrame, asked: int) -> DataFrame:
    """One row ``n, contents, is_equal``: whether all ``asked`` (two or more) records are there and have one content (or are links of one file).

    A content that can't be read (null) equals none, not even another such; ``contents`` counts those that can be read.
    """
    known = digest(F.col("content"), "sha256")
    key = F.when(known.isNotNull(), F.struct(F.col("is_symlink"), F.col("size"), known))
    found = records.agg(F.count("*").alias("n"), F.count(key).alias("__read"), F.count_distinct(key).alias("contents"), F.count_distinct("dev", "inode").alias("__files"), F.count("inode").alias("__known"))
    one_content = (F.col("contents") == 1) & (F.col("__read") == F.col("n"))
    one_file = (F.col("__files") == 1) & (F.col("__known") == F.col("n"))
    good = (F.col("n") == asked) & F.lit(asked >= 2) & (one_content | one_file)
    return found.select("n", "contents", good.alias("is_equal"))


def equal_entries(entries: DataFrame, asked: DataFrame, honour_layout: bool = False) -> DataFrame:
    """``ask, n, is_equal`` for each question of ``asked`` (ask, path): whether all its paths, two or more, are there and equal.

    ``entries`` are records with ``checksum`` (null for what can't be read) and, of a walk, ``kind``.  Files are equal by content, links by target, directories by the multiset
    of what they hold, hidden and empty files among it (with names, if the layout counts).  A directory equals no file, one that holds nothing or something that can't be read equals none;
    links of one file are equal whether or not it can be read.
    """
    everything = Config(types=frozenset({"duplicate_file", "duplicate_dir"}), honour_layout=honour_layout)
    known = entries.filter("checksum IS NOT NULL")
    dirs = directories.signatures(directories.counted(entries, everything), known.select("path", "checksum").dropDuplicates(["path"]), everything)
    kind = F.col("kind") if "kind" in entries.columns else F.lit("file")
    single = entries.filter(kind != "dir").select("path", F.when(F.col("checksum").isNotNull(), F.concat_ws("/", F.lit("file"), "is_symlink", "size", "checksum")).alias("__key"), F.struct("dev", "inode").alias("__file"))
    whole = dirs.select(F.col("dir").alias("path"), F.concat_ws("/", F.lit("dir"), "signature").alias("__key"), F.lit(None).cast(single.schema["__file"].dataType).alias("__file"))
    found = asked.join(single.unionByName(whole).dropDuplicates(["path"]), "path", "left").groupBy("ask")
    one = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))
    told = found.agg(F.count("*").alias("n"), one("__key").alias("__content"), one("__file").alias("__links"))
    same = F.coalesce(F.col("__content"), F.lit(False)) | F.coalesce(F.col("__links"), F.lit(False))
    return told.select("ask", "n", ((F.col("n") >= 2) & same).alias("is_equal"))


#: Fixed codes of link relations.
REFLINK, NONE, NOT_FILE, WRONG_SIZE, MAYBE_REFLINK, SAME_FILE, PATH_DOUBLE, HARDLINK, SYMLINK, XDEV, ERROR = 0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11


def link_relation(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``link_code`` to rows with two record structs; sharing of extents is only known where both have ``extents``."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    same = (x("dev") == y("dev")) & (x("inode") == y("inode"))
    names = pairs.schema[a].dataType.fieldNames()
    extents = F.when(x("extents") == y("extents"), REFLINK).otherwise(NONE) if "extents" in names else F.lit(NONE)
    code = (
        F.when(x("size").isNull() | y("size").isNull(), ERROR)
        .when(x("is_symlink") | y("is_symlink"), NOT_FILE)
        .when(x("size") != y("size"), WRONG_SIZE)
        .when(same & (x("path") == y("path")), SAME_FILE)
        .when(same & (x("parent_inode") == y("parent_inode")) & (C.basename(x("path")) == C.basename(y("path"))), PATH_DOUBLE)
        .when(same, HARDLINK)
        .when(x("dev") != y("dev"), XDEV)
        .otherwise(extents)
    )
    return pairs.withColumn("link_code", code.cast("int"))


def hash_list(records: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """``path, checksum`` of every record."""
    return records.select("path", digest(F.col("content"), algorithm).alias("checksum"))


def block_digests(records: DataFrame, block: int = 16384) -> DataFrame:
    """``path, block, checksum`` of each block of a content, for comparing contents in part."""
    raw = F.col("content").cast("binary")
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(raw) - 1) / block).cast("int")))
    out = records.select("path", raw.alias("__raw"), F.explode(steps).alias("block"))
    return out.select("path", "block", F.sha2(F.substring("__raw", (F.col("block") * block + 1).cast("int"), F.lit(block)), 256).alias("checksum"))


def _stretches(a: bytes, b: bytes, at: int, block: int) -> list[tuple[int, int]]:
    """Equal stretches of two byte ranges as (start, length), in whole blocks; a node whose bytes are equal isn't looked into, others are halved."""
    out, stack = [], [(0, max(len(a), len(b)))]
    while stack:
        lo, hi = stack.pop()
        if a[lo:hi] == b[lo:hi]:
            if out and out[-1][0] + out[-1][1] == at + lo:
                out[-1] = (out[-1][0], out[-1][1] + hi - lo)
            else:
                out.append((at + lo, hi - lo))
        elif hi - lo > block:
            middle = lo + max(block, (hi - lo) // 2 // block * block)
            stack += [(middle, hi), (lo, middle)]
    return out


def equal_ranges(pairs: DataFrame, block: int = 1 << 14, node: int = 1 << 24) -> DataFrame:
    """``a, b, start, length``: the longest stretches of whole blocks (the last may be shorter) in which two files, ``a`` and ``b`` of sizes ``size_a`` and ``size_b``, are equal.

    Files are compared node by node, each by a task that reads that range of both, so one pair of large files is spread; a node that differs is halved down to blocks.  A pair of which
    one can't be read has no stretch; neither has what lies beyond the end of the shorter file.
    """

    from ..sources.filesystem import read_range

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, at, shorter in zip(*(c.to_pylist() for c in batch.columns)):
                one, other = (read_range(p, at, min(node, shorter - at)) for p in (a, b))
                if one is not None and other is not None and one and other:
                    out += [(a, b, start, n) for start, n in _stretches(one, other, at, block)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["a", "b", "start", "length"])

    shorter = F.least("size_a", "size_b")
    starts = F.when(shorter > 0, F.sequence(F.lit(0).cast("long"), shorter - 1, F.lit(node).cast("long")))
    nodes = pairs.select("a", "b", F.explode(starts).alias("at"), shorter.cast("long").alias("shorter"))
    found = nodes.repartition("a", "b", "at").mapInArrow(compared, "a string, b string, start long, length long")
    order = Window.partitionBy("a", "b").orderBy("start")  # a few rows for each node
    fresh = F.coalesce(F.lag(F.col("start") + F.col("length")).over(order) != F.col("start"), F.lit(True))
    islands = found.withColumn("__island", F.sum(fresh.cast("long")).over(order))
    return islands.groupBy("a", "b", "__island").agg(F.min("start").alias("start"), F.sum("length").alias("length")).drop("__island")
