"""One text file from rows in order, written by the tasks.

A data source writer: each task writes the values of its partition to a segment beside the file, and tells its name and how many values it has.  The commit
joins the segments in the order of partitions and puts the whole in its place; an aborted write, or a task that is run again, leaves nothing.  No row comes to the driver.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Segment(WriterCommitMessage):
    partition: int
    name: str
    values: int


def _folder(path: str, run: str) -> str:
    return f"{path}.segments-{run}"


def _removed(folder: str) -> None:
    """Under another name first, so that no task that still runs can begin a segment in it."""
    gone = f"{folder}.gone"
    try:
        os.rename(folder, gone)
    except FileNotFoundError:
        return
    shutil.rmtree(gone, ignore_errors=True)


class DocumentWriter(DataSourceArrowWriter):
    """``opening``, the values with ``separator`` between them, ``closing``; ``before`` and ``after`` are further values, ``empty`` is the whole text if there are none."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.folder = _folder(self.path, options["run"])
        self.shape = json.loads(options["shape"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        separator, values = self.shape["separator"], 0
        with open(os.path.join(self.folder, name), "w", encoding="utf-8", newline="") as out:
            for batch in iterator:
                for value in batch.column(0).to_pylist():
                    out.write((separator if values else "") + value)
                    values += 1
        return Segment(task.partitionId(), name, values)

    def commit(self, messages: list[Segment | None]) -> None:
        shape, parts = self.shape, [s for s in sorted((m for m in messages if m), key=lambda m: m.partition) if s.values]
        whole = os.path.join(self.folder, "whole")
        with open(whole, "wb") as out:
            if not (parts or shape["before"] or shape["after"]):
                out.write(shape["empty"].encode())
            else:
                out.write(shape["opening"].encode())
                first = True
                for piece in (*shape["before"], *parts, *shape["after"]):
                    out.write(b"" if first else shape["separator"].encode())
                    first = False
                    if isinstance(piece, str):
                        out.write(piece.encode())
                        continue
                    with open(os.path.join(self.folder, piece.name), "rb") as segment:
                        shutil.copyfileobj(segment, out, 1 << 24)
                out.write(shape["closing"].encode())
        os.replace(whole, self.path)
        _removed(self.folder)

    def abort(self, messages: list[Segment | None]) -> None:
        _removed(self.folder)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write(values: DataFrame, path: str, opening: str = "", separator: str = "", closing: str = "", before: list[str] | None = None, after: list[str] | None = None, empty: str | None = None) -> None:
    """Write the one text column of ``values`` in the order of its rows; the folder of ``path`` is one that all machines see.

    ``empty`` is the text without any value, by default the opening and the closing.
    """
    shape = {"opening": opening, "separator": separator, "closing": closing, "before": before or [], "after": after or [], "empty": opening + closing if empty is None else empty}
    values.sparkSession.dataSource.register(DocumentSource)
    path, run = os.path.abspath(path), uuid.uuid4().hex
    os.makedirs(_folder(path, run))  # here, so that a task can't bring it back after an abort
    try:
        values.write.format("one_document").mode("append").option("path", path).option("run", run).option("shape", json.dumps(shape)).save()
    finally:
        _removed(_folder(path, run))
