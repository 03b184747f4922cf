"""Earlier results, checksum caches and time stamps as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import in_ranges
from ..plans import parsing

RESULT_SCHEMA = (
    "id long, type string, progress int, checksum string, path string, size long, depth int, inode long, disk_id long, is_original boolean, n_children long, twins long, parent_path string, hardlink_of long, mtime double, "
    "description string, cwd string, args string, version string, checksum_type string, merge_directories boolean, aborted boolean, total_files long, ignored_files long, ignored_folders long, duplicates long, duplicate_sets long, total_lint_size long"
)
_ELEMENT = ("id", "type", "progress", "checksum", "path", "size", "depth", "inode", "disk_id", "is_original", "n_children", "twins", "parent_path", "hardlink_of", "mtime")

DEDUPLICATED = ":deduplicated"  # after the algorithm's name, in a cache: what a file held when it got its original's extents


def read_document(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A whole result, header and footer among it: a JSON array, or a document a line."""
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", not lines).json(path)


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The elements of a result, with their place in it (``position``: they are read once, in ranges of files and of places in a file, and written so)."""
    read = read_document(spark, path, lines).filter("path IS NOT NULL").select(*_ELEMENT, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    placed = in_ranges(read, [F.col("__file"), F.col("__block"), F.col("__id")])
    return placed.select(*_ELEMENT, F.col("__at").alias("position"))


def read_header(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return read_document(spark, path, lines).filter("path IS NULL AND total_files IS NULL").select("description", "cwd", "args", "version", "checksum_type", "merge_directories")


def with_cached(records: DataFrame, cache: DataFrame, algorithm: str, tolerance: float = 1e-6) -> DataFrame:
    """Fills ``cached_checksum`` from a cache (dev, inode, algorithm, checksum, mtime) where the time still agrees."""
    known = cache.filter(F.col("algorithm") == algorithm).select("dev", "inode", F.col("mtime").alias("__then"), F.col("checksum").alias("__checksum"))
    out = records.join(known, ["dev", "inode"], "left")
    fresh = F.abs(F.col("mtime") - F.col("__then")) <= tolerance
    return out.withColumn("cached_checksum", F.when(fresh, F.col("__checksum")).otherwise(F.col("cached_checksum"))).drop("__then", "__checksum")


def with_marks(members: DataFrame, cache: DataFrame, algorithm: str, tolerance: float = 1e-6) -> DataFrame:
    """Adds ``is_deduplicated``: a mark in the cache has the member's checksum, and its time still agrees.  ``formats.actions`` then plans no clone or reflink for it."""
    marks = cache.filter(F.col("algorithm") == algorithm + DEDUPLICATED).select("dev", "inode", F.col("mtime").alias("__then"), F.col("checksum").alias("__marked"))
    same = (F.col("__marked") == F.col("checksum")) & (F.abs(F.col("mtime") - F.col("__then")) <= tolerance)
    return members.join(marks, ["dev", "inode"], "left").withColumn("is_deduplicated", F.coalesce(same, F.lit(False))).drop("__then", "__marked")


def read_stamp(path: str) -> float:
    """The time in the first line of a file."""
    with open(path) as f:
        return parsing.stamp(f.readline())
