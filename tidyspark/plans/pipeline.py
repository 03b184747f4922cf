"""Entry A: from records to the reported rows."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import directories, rank, records, sieve
from ..operators.stage import once
from .config import Config


@dataclass
class Report:
    duplicates: DataFrame
    uniques: DataFrame
    directories: DataFrame | None
    parts: DataFrame | None
    footer: DataFrame


def run(source: DataFrame, cfg: Config, roots: list[str] | None = None) -> Report:
    """The sieve runs now and once; each part of the report is a plan on its members until it is written.

    Records without a content are files; places that several roots lead to count once.  Of a walk (rows with a ``kind``) files and links are compared, all else counts for directories only.
    """
    if cfg.merge_directories:
        cfg = cfg.for_directories()
    comparable = source.filter(F.col("kind").isin("file", "symlink")) if "kind" in source.columns else source
    files = records.selected(comparable, cfg)
    if "content" not in files.columns:
        files = records.without_path_doubles(files, rank.order(cfg, found=False))
    group = sieve.group_keys(cfg)
    members = once(sieve.sieve(files, cfg))  # read by all parts of the report
    found = rank.ranked(rank.mark_originals(members, cfg, group), cfg, group, members).withColumn("type", F.lit("duplicate_file"))
    dirs = parts = None
    if cfg.merge_directories:
        dirs = once(directories.duplicate_dirs(directories.counted(source, cfg), members, cfg, roots, dir_times=directories.times(source)), "directories")
        parts = directories.parts(files.drop("content"), dirs)
        found = directories.leftovers(members, dirs, cfg, group)
    if cfg.sort_groups:
        found = rank.order_groups(found, cfg.sort_groups, group)
    footer = rank.totals(found, cfg, group).crossJoin(files.agg(F.count("*").alias("total_files")))  # one row each
    return Report(found, sieve.uniques(files, cfg, members), dirs, parts, footer)


class Run:
    """Results being written; another thread may abort that, and what is written until then stays."""

    def __init__(self, spark: SparkSession):
        self._context, self._group, self._stop = spark.sparkContext, f"run-{uuid.uuid4()}", threading.Event()

    def abort(self) -> None:
        self._stop.set()
        self._context.cancelJobGroup(self._group)

    def write(self, sinks: list[tuple[str, Callable[[], None]]]) -> dict:
        """Call the sinks in turn; tells whether the run was aborted, and which of them came to their end."""
        written: list[str] = []
        self._context.setJobGroup(self._group, "results", interruptOnCancel=True)
        for name, sink in sinks:
            if self._stop.is_set():
                break
            try:
                sink()
            except Exception:
                if not self._stop.is_set():
                    raise
                break
            written.append(name)
        return {"aborted": self._stop.is_set(), "written": written}
