"""Entry B: earlier results read again, filtered, regrouped and ranked anew."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..functions import columns as C
from ..operators import directories, rank, relations, sieve
from ..operators.stage import once
from .config import Config

GROUP = ["type", "checksum"]


def still_there(rows: DataFrame, now: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Rows whose path exists with about the same time in ``now`` (path, mtime; mode, dev and root_dev are taken over if it has them)."""
    further = [c for c in ("mode", "dev", "root_dev") if c in now.columns]
    current = now.select("path", F.col("mtime").alias("__now"), *further)
    return rows.drop(*further).join(current, "path").filter(F.abs(F.col("mtime") - F.col("__now")) <= tolerance).drop("__now")


def filtered(rows: DataFrame, cfg: Config, types: list[str] | None = None) -> DataFrame:
    """Depth, size (of duplicates only), hidden, permission, device and type filters.

    Permissions need ``mode`` bits and devices need ``root_dev`` in the rows, as ``still_there`` takes them from a scan.
    """
    dupes = F.col("type").isin("duplicate_file", "duplicate_dir")
    out = rows.filter(~dupes | F.col("size").between(*cfg.size))
    if cfg.max_depth is not None:
        out = out.filter(F.col("depth") <= cfg.max_depth)
    if cfg.hidden == "ignore":
        out = out.filter(~C.is_hidden(F.col("path")))
    if cfg.permissions:
        bits = sum({"r": 0o4, "w": 0o2, "x": 0o1}[c] for c in cfg.permissions)
        out = out.filter(F.col("mode").bitwiseAND(F.lit(bits)) == bits)
    if not cfg.cross_devices:
        out = out.filter("dev = root_dev")
    return out.filter(F.col("type").isin(*types)) if types else out


def with_groups(rows: DataFrame) -> DataFrame:
    """Rows with ``checksum`` in each: those of a result that has none are grouped as they stand, a group from each original on.

    Needs ``position``, the row's place in its result, where checksums are missing; without it such rows are groups of their own.
    """
    if "position" not in rows.columns:
        return rows.withColumn("checksum", F.coalesce("checksum", F.concat(F.lit("none "), F.xxhash64("type", "path").cast("string"))))
    bare, known = rows.filter("checksum IS NULL"), rows.filter("checksum IS NOT NULL")
    # The last original before a row: one for all rows of a group, found in the order of positions.  A result's rows are ordered in ranges across
    # tasks; a window looks through one range, and what is open at its end is handed on by a row for each range.
    kind = ["source_idx", "type"]
    placed = rank.in_ranges(bare, [F.col("source_idx"), F.col("type"), F.col("position")])
    begins = F.when(F.col("is_original"), F.struct("position"))
    inside = Window.partitionBy(*kind, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = placed.groupBy(*kind, "__part").agg(F.max(begins).alias("__end"))
    earlier = Window.partitionBy(*kind).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*kind, "__part", F.last("__end", ignorenulls=True).over(earlier).alias("__open"))
    begin = F.coalesce(F.last(begins, ignorenulls=True).over(inside), F.col("__open"))["position"]
    named = F.concat_ws(" ", F.lit("none"), "source_idx", F.coalesce(begin, F.lit(-1)))
    return known.unionByName(placed.join(ends, [*kind, "__part"]).withColumn("checksum", named).select(*known.columns))


#: With more roots than this a trie is searched; with fewer a chain of comparisons stays in the JVM.
_CHAINED = 16


def _trie(roots: list[tuple[str, int, bool]]) -> dict:
    """Components of the roots as nested dictionaries; under None what a root has, the first of equal ones."""
    trie: dict = {}
    for root, ordinal, tag in sorted(roots, key=lambda r: r[1], reverse=True):
        node = trie
        for part in root.rstrip("/").split("/"):
            node = node.setdefault(part, {})
        node[None] = (ordinal, tag)
    return trie


def _longest(trie: dict, path: str) -> tuple[int | None, bool | None]:
    node, found = trie, (None, None)
    for part in path.split("/"):
        node = node.get(part)
        if node is None:
            break
        found = node.get(None, found)
    return found


def assigned(rows: DataFrame, roots: list[tuple[str, int, bool]]) -> DataFrame:
    """Rows below a root, with ordinal and tag of the longest root above; component bounds count, and of equal roots the first.

    The roots are a command line's, or a list's.
    """
    if len(roots) > _CHAINED:
        trie = _trie(roots)

        def looked_up(batches):
            for b in batches:
                found = [_longest(trie, p) for p in b.column("path").to_pylist()]
                kept = [f[0] is not None for f in found]
                table = b.append_column("path_index", pa.array([f[0] for f in found], pa.int32())).append_column("is_tagged", pa.array([f[1] for f in found], pa.bool_()))
                yield table.filter(pa.array(kept))

        rows = rows.drop("path_index", "is_tagged").filter("path IS NOT NULL")
        return rows.mapInArrow(looked_up, StructType([*rows.schema.fields, StructField("path_index", IntegerType()), StructField("is_tagged", BooleanType())]))
    path, index, tagged = F.col("path"), F.lit(None).cast("int"), F.lit(None).cast("boolean")
    for root, ordinal, tag in sorted(roots, key=lambda r: (len(r[0]), -r[1])):
        clean = root.rstrip("/")
        hit = (path == clean) | F.startswith(path, F.lit(clean + "/"))
        index, tagged = F.when(hit, F.lit(ordinal)).otherwise(index), F.when(hit, F.lit(tag)).otherwise(tagged)
    return rows.withColumn("path_index", index).withColumn("is_tagged", tagged).filter("path_index IS NOT NULL")


def requery(results: list[DataFrame], cfg: Config, roots: list[tuple[str, int, bool]] | None = None, types: list[str] | None = None, now: DataFrame | None = None) -> DataFrame:
    """Union, stale check, filters, regrouping by type and checksum, match options, ranks and originals."""
    rows = relations.union_results(results)
    if now is not None:
        rows = still_there(rows, now)
    rows = filtered(with_groups(rows), cfg, types)
    rows = assigned(rows, roots) if roots else rows.withColumn("path_index", F.col("source_idx")).withColumn("is_tagged", F.lit(False))
    rows = relations.distinct_entries(rows, GROUP)
    for name, default in (("is_symlink", F.lit(False)), ("outer_link_count", F.lit(0)), ("link_count", F.lit(1)), ("dev", F.lit(0)), ("inode", F.xxhash64("path"))):
        if name not in rows.columns:
            rows = rows.withColumn(name, default)
    rows = rows.withColumn("is_new", F.lit(True) if cfg.newer_than is None else F.col("mtime") >= cfg.newer_than)
    group = list(GROUP)
    for name, key in sieve.name_keys(cfg).items():
        rows = rows.withColumn(name, key)
        group.append(name)
    dupes = sieve.qualified(rows.filter(F.col("type").isin("duplicate_file", "duplicate_dir")), cfg, group)
    dupes = once(dupes.drop("is_original"), "requery")
    return rank.ranked(rank.mark_originals(dupes, cfg, group), cfg, group, dupes)


def packed(files: DataFrame, results: DataFrame, cfg: Config) -> DataFrame:
    """Duplicate directories from a result without them."""
    return directories.duplicate_dirs(files, results.filter("type = 'duplicate_file'"), cfg.for_directories())


def unpacked(results: DataFrame) -> DataFrame:
    """Duplicate files from a result with directories: parts of directories become members of their own."""
    part = F.col("type") == "part_of_directory"
    kept = results.filter(part | (F.col("type") == "duplicate_file"))
    return kept.withColumn("type", F.lit("duplicate_file")).dropDuplicates(["checksum", "path"])


def statistics(rows: DataFrame) -> DataFrame:
    """duplicates (a directory counts its files), sets and bytes of a result."""
    weight = F.when(F.col("type") == "duplicate_dir", F.coalesce("n_children", F.lit(1))).otherwise(1) if "n_children" in rows.columns else F.lit(1)
    extra = ~F.col("is_original")
    return rows.agg(F.sum(F.when(extra, weight).otherwise(0)).cast("long").alias("duplicates"), F.count_distinct("type", "checksum").alias("duplicate_sets"), F.sum(F.when(extra, F.col("size")).otherwise(0)).cast("long").alias("duplicate_bytes"))
