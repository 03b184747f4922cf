"""A file tree as a stream: each batch has the files that have come or changed since the one before.

An offset is a time.  A batch has the files whose inode changed after its start and up to its end, by the system's own time of change, which no copy or move can set back; the end lies ``delay``
seconds behind the clock, so that whatever has such a time is there to be listed.  Offsets are in the query's checkpoint: a restarted query goes on where it ended, and reads no file twice
that has not changed again.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .filesystem import SCHEMA, Walker, _batch

_SMALLEST = -(1 << 62)


class _Changed(Walker):
    """Rows of files changed within a stretch of time only."""

    after, upto = _SMALLEST, 1 << 62

    def _row(self, path, depth, index, own=None, link=False, hidden=False, kind="file", exists=True):
        if kind != "file" or own is None or not self.after < own.st_ctime_ns <= self.upto:
            return None
        return super()._row(path, depth, index, own, link, hidden, kind, exists)


class _Part(InputPartition):
    def __init__(self, items: list[tuple], after: int, upto: int):
        self.items, self.after, self.upto = items, after, upto


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.settings = json.loads(options["settings"])
        self.delay, self.parts, self.since = float(options.get("delay", "2")), int(options.get("parts", "64")), int(options.get("since", str(_SMALLEST)))

    def initialOffset(self) -> dict:
        return {"ns": self.since}

    def latestOffset(self) -> dict:
        return {"ns": max(self.since, time.time_ns() - int(self.delay * 1e9))}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        """Directories are listed here until there is one for each part; tasks walk what is below."""
        walker = _Changed(**self.settings)
        walker.after, walker.upto = start["ns"], end["ns"]
        items = [(path, index, 0, []) for index, path in enumerate(walker.roots)]
        while len(items) < self.parts:
            inner = [x for item in items for x in walker._visit(*item)[1]]
            if not inner or len(inner) > 64 * self.parts:
                break
            files = [x for x in items if not os.path.isdir(x[0]) or os.path.islink(x[0])]  # they stay, a directory's own row is of no interest
            if files == items:
                break
            items = files + inner
        return [_Part(items[k :: self.parts], start["ns"], end["ns"]) for k in range(min(self.parts, len(items)))]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        walker = _Changed(**self.settings)
        walker.after, walker.upto = partition.after, partition.upto
        rows: list[tuple] = []
        for row in walker.walk(iter(partition.items), 1 << 62):
            if row:
                rows.append(row)
            if len(rows) == 4096:
                yield _batch(rows).drop_columns(["raw", "above"])
                rows = []
        if rows:
            yield _batch(rows).drop_columns(["raw", "above"])


class TreeStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)


def stream_tree(spark: SparkSession, roots: list[tuple[str, int, bool]], since: float | None = None, delay: float = 2, parts: int = 64, **options) -> DataFrame:
    """Files of the roots as they come, in the columns of a walk; ``since`` (seconds, as in a stamp) leaves out what was there before."""
    spark.dataSource.register(TreeStream)
    settings = {"roots": [r[0] for r in roots], "tagged": [bool(r[2]) for r in roots], **options}
    reader = spark.readStream.format("file_tree").option("settings", json.dumps(settings)).option("delay", delay).option("parts", parts)
    return (reader if since is None else reader.option("since", int(since * 1e9))).load()
