"""The record contract: what every operator reads, and how a table becomes records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..plans.config import Config

RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()), T.StructField("depth", T.IntegerType()), T.StructField("path_index", T.IntegerType()),
        T.StructField("dev", T.LongType()), T.StructField("inode", T.LongType()), T.StructField("parent_inode", T.LongType()), T.StructField("link_count", T.IntegerType()),
        T.StructField("is_symlink", T.BooleanType()), T.StructField("is_tagged", T.BooleanType()), T.StructField("is_hidden", T.BooleanType()), T.StructField("cached_checksum", T.StringType()),
    ]
)


def as_records(df: DataFrame, path: Column, content: Column | None = None, **fields: Column) -> DataFrame:
    """Map any table to records: ``path`` and ``content`` (string or binary), and further record columns by name.

    Defaults: size is the content's bytes, depth the path's, inode a number of the path, one link, nothing tagged or hidden.
    """
    given = {"path": path, **fields}
    if content is not None:
        given["content"] = content
        given.setdefault("size", F.octet_length(content))
    known = {"inode": F.xxhash64(path), "parent_inode": F.xxhash64(C.dirname(path)), "dev": F.lit(0), "link_count": F.lit(1), "depth": C.path_depth(path), "path_index": F.lit(0), "mtime": F.lit(0.0), "is_symlink": F.lit(False), "is_tagged": F.lit(False), "is_hidden": C.is_hidden(path), "cached_checksum": F.lit(None)}
    out = [given.get(f.name, known.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in RECORD]
    return df.select(*out, *([given["content"].alias("content")] if content is not None else []), *(given[k].alias(k) for k in given if k not in RECORD.fieldNames() and k != "content"))


def effective(records: DataFrame, cfg: Config) -> DataFrame:
    """Adds ``start`` and ``eff_size``, the slice of the content that counts; rows with an empty slice go."""

    def at(clamp, default: Column) -> Column:
        if clamp is None:
            return default
        return F.floor(F.col("size") * clamp.share).cast("long") if clamp.share is not None else F.lit(clamp.offset)

    start = at(cfg.clamp_low, F.lit(0))
    end = F.least(F.col("size"), at(cfg.clamp_high, F.col("size")))
    if cfg.clamp_high and cfg.clamp_high.offset is not None:
        end = F.least(F.col("size"), F.lit(max(1, cfg.clamp_high.offset)))
    out = records.withColumn("start", start.cast("long")).withColumn("eff_size", end.cast("long"))
    return out.filter("start < eff_size OR size = 0") if cfg.clamp_low or cfg.clamp_high else out


def newer(records: DataFrame, cfg: Config) -> DataFrame:
    return records.withColumn("is_new", F.lit(True) if cfg.newer_than is None else F.col("mtime") >= cfg.newer_than)


def without_path_doubles(records: DataFrame, order: Column) -> DataFrame:
    """One record for each place (device, inode, parent, basename): the one that comes first in ``order``, then by path."""
    place = Window.partitionBy("dev", "inode", "parent_inode", C.basename(F.col("path"))).orderBy(order, "path_index", "path")
    return records.withColumn("__nth", F.row_number().over(place)).filter("__nth = 1").drop("__nth")


def one_per_inode(records: DataFrame, order: Column) -> DataFrame:
    """The first link of each file in ``order``."""
    links = Window.partitionBy("dev", "inode").orderBy(order, "path")
    return records.withColumn("__nth", F.row_number().over(links)).filter("__nth = 1").drop("__nth")


def selected(records: DataFrame, cfg: Config) -> DataFrame:
    """Size, depth, hidden and symlink predicates; they reach the scan."""
    out = records.filter(F.col("size").between(*cfg.size))
    if cfg.max_depth is not None:
        out = out.filter(F.col("depth") <= cfg.max_depth)
    if cfg.hidden == "ignore":
        out = out.filter(~F.col("is_hidden"))
    return out.filter(~F.col("is_symlink")) if cfg.symlinks == "ignore" else out


def on_known_devices(records: DataFrame, mounts: DataFrame) -> DataFrame:
    """Without records on ignored file systems (``mounts``: dev, is_ignored; a handful of rows)."""
    return records.join(mounts.filter("is_ignored").select("dev").distinct(), "dev", "left_anti")
