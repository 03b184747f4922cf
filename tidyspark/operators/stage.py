"""Points at which a plan that is read several times is computed once.

The rows are written below ``spark.checkpoint.dir``, the folder that all machines of a cluster see, so neither a long
lineage nor a lost executor makes earlier stages run again.  A session on one machine without the setting gets a folder of its own; on a
cluster that would be a different disk on each machine, so there the setting has to be made.  The files go when the application ends, and
earlier where ``forget`` is called or a block of ``passing`` ends.

A setting such as ``spark.sql.shuffle.partitions`` is a fixed number, so what one task sorts or hashes would grow with the input.  A plan written by ``once`` is dealt to as many tasks
as the files that it reads ask for.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
PARTITIONS = "spark.sql.shuffle.partitions"
TASK_BYTES = 1 << 22  # of compressed input for each task of a shuffle; rows of paths and digests take ten bytes in a file and two hundred in a sort
TASK_READS = {"spark.sql.files.maxPartitionBytes": 1 << 23, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 1 << 23}  # the most that a task reads of a file, and of small partitions put together
_own: list[str] = []
_sizes: dict[str, int] = {}  # bytes of the tables written here, by folder
_fitting = threading.Lock()  # settings are the session's, so one plan at a time is written with its own
_passing: ContextVar[list | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"{_SETTING} has to name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidyspark-"))
    return _own[0]


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def tasks(df: DataFrame) -> int:
    """How many tasks the files that a plan reads ask for, one for each ``TASK_BYTES``; 1 for a plan that reads none."""
    total, own = 0, set()
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for file in df.inputFiles():
        folder = file.rsplit("/", 2)[-2]
        if folder in _sizes:
            own.add(folder)
        else:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
            total += path.getFileSystem(hadoop).getFileStatus(path).getLen()
    return max(1, -(-(total + sum(_sizes[folder] for folder in own)) // TASK_BYTES))


def _bytes(setting: str) -> float:
    """A size as Spark writes it, such as ``64MB`` or ``67108864b``."""
    found = re.fullmatch(r"\s*(\d+)\s*([bkmgtp]?)(ib|b)?\s*", setting.lower())
    return int(found[1]) << 10 * max(0, "bkmgtp".index(found[2] or "b")) if found else float("inf")


@contextmanager
def fitted(df: DataFrame) -> Iterator[None]:
    """Inside the block shuffles have ``tasks(df)`` partitions, if the session has fewer, and what one task reads of a file or a shuffle is bounded."""
    spark, n = df.sparkSession, tasks(df)
    if n <= int(spark.conf.get(PARTITIONS)):
        yield
        return
    with _fitting:
        old = {name: spark.conf.get(name) for name in (PARTITIONS, *TASK_READS)}
        try:
            spark.conf.set(PARTITIONS, str(max(n, int(old[PARTITIONS]))))
            for name, most in TASK_READS.items():
                if _bytes(old[name]) > most:
                    spark.conf.set(name, str(most))
            yield
        finally:
            for name, value in old.items():
                spark.conf.set(name, value)


def once(df: DataFrame, name: str = "stage") -> DataFrame:
    """Compute ``df`` once, by as many tasks as its input asks for; returns the written table."""
    with fitted(df):
        return written(df, name)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Compute ``df`` once, as the session is set; returns the written table."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(place)
    path, system = _path(spark, place)
    system.deleteOnExit(path)
    _sizes[path.getName()] = system.getContentSummary(path).getLength()
    if (places := _passing.get()) is not None:
        places.append((system, path))
    return spark.read.schema(schema).parquet(place)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``once`` wrote and nothing reads any more."""
    for file in df.inputFiles()[:1]:
        path, system = _path(df.sparkSession, file.rpartition("/")[0])
        system.delete(path, True)


@contextmanager
def passing() -> Iterator[None]:
    """What this thread writes inside the block by ``once`` is deleted when the block ends, also by an error: plans on it are to be written or collected inside.

    An inner block ends with its own tables alone.  A long session holds no more than its open blocks that way.
    """
    places: list = []
    token = _passing.set(places)
    try:
        yield
    finally:
        _passing.reset(token)
        for system, path in places:
            system.delete(path, True)
