"""Incremental runs: high-water marks, checksum caches, and duplicates in streams."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import digest
from ..plans import parsing
from ..plans.config import Config
from ..sources.results import DEDUPLICATED, read_stamp


def since(cfg: Config, stamp_file: str) -> Config:
    """The settings with ``newer_than`` from a stamp file; unchanged if there is none yet."""
    try:
        return replace(cfg, newer_than=read_stamp(stamp_file))
    except (FileNotFoundError, parsing.ParseError):
        return cfg


def write_cache(members: DataFrame, path: str, algorithm: str, cfg: Config, uniques: DataFrame | None = None) -> bool:
    """Append checksums to a cache; a clamped run has none that are worth keeping.  Those of unique files are kept with ``write_unfinished`` alone."""
    if cfg.clamp_low or cfg.clamp_high:
        return False
    if uniques is not None and cfg.write_unfinished:
        columns = ["dev", "inode", "checksum", "mtime"]
        members = members.select(*columns).unionByName(uniques.select(*columns))
    members.filter("checksum IS NOT NULL").select("dev", "inode", F.lit(algorithm).alias("algorithm"), "checksum", "mtime").dropDuplicates(["dev", "inode"]).write.mode("append").parquet(path)
    return True


def mark_deduplicated(planned: DataFrame, path: str, algorithm: str) -> None:
    """Note in a cache which files got the extents of their original: those planned to be cloned or reflinked, to be called when that is done."""
    marked = planned.filter(F.col("action").isin("clone", "reflink") & F.col("checksum").isNotNull())
    marked.select("dev", "inode", F.lit(algorithm + DEDUPLICATED).alias("algorithm"), "checksum", "mtime").dropDuplicates(["dev", "inode"]).write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each file and algorithm."""
    rows = spark.read.parquet(path)
    return rows.groupBy("dev", "inode", "algorithm").agg(F.max_by("checksum", "mtime").alias("checksum"), F.max("mtime").alias("mtime"))


def clear_cache(spark: SparkSession, path: str, to: str, files: DataFrame) -> None:
    """The cache without some files, written to a new place."""
    spark.read.parquet(path).join(files.select("dev", "inode").distinct(), ["dev", "inode"], "left_anti").write.mode("overwrite").parquet(to)


def first_seen(stream: DataFrame, content: str, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream without repeats of a content within the watermark; the first one seen is the original and stays it."""
    keyed = stream.withColumn("checksum", digest(F.col(content), "sha256")).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["checksum"])


def running_groups(stream: DataFrame, path: str, content: str, time: str, keep_seconds: int = 86400) -> DataFrame:
    """Updates ``checksum, original, twins, changed`` of each content: the smallest path is the original, so a later record may take over.

    A content that has not come for ``keep_seconds`` of event time is forgotten, so that the state holds no more than such a stretch brings.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, n, latest = state.get if state.exists else (None, 0, 0)
        before = best
        for pdf in batches:
            low = pdf["path"].min()
            best, n = low if best is None else min(best, low), n + len(pdf)
            latest = max(latest, int(pdf["at"].max()))
        state.update((best, n, latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1000 * keep_seconds)
        yield pd.DataFrame([(key[0], best, n, before is not None and before != best)], columns=["checksum", "original", "twins", "changed"])

    keyed = stream.select(F.col(path).alias("path"), digest(F.col(content), "sha256").alias("checksum"), F.col(time).alias("__time")).withWatermark("__time", f"{keep_seconds} seconds")
    keyed = keyed.withColumn("at", F.unix_millis("__time"))
    return keyed.groupBy("checksum").applyInPandasWithState(update, "checksum string, original string, twins long, changed boolean", "original string, n long, latest long", "update", "EventTimeTimeout")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str) -> DataFrame:
    """Chains of equal content in time: windows that gaps longer than ``gap`` separate."""
    return stream.withWatermark(time, gap).groupBy(*keys, F.session_window(time, gap).alias("chain")).agg(F.count("*").alias("n"))


def result_lines(lines: DataFrame) -> DataFrame:
    """Elements from a stream of result lines (column ``value``); headers and footers go."""
    schema = "type string, path string, size long, checksum string, is_original boolean, twins long, mtime double"
    return lines.select(F.from_json("value", schema).alias("r")).filter("r.path IS NOT NULL").select("r.*")


def metrics(query) -> list[dict]:
    """Progress of a streaming query as plain numbers."""
    return [{k: p[k] for k in ("batchId", "numInputRows", "processedRowsPerSecond") if k in p} for p in map(lambda x: x if isinstance(x, dict) else json.loads(x.json), query.recentProgress)]
