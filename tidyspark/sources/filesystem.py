"""Records of file trees.

A tree is walked in rounds.  The tasks of a round visit the paths dealt to them and what lies below, until each has spent its share of visits; what they have not come to
is dealt anew among the tasks of the next round, whose share is larger.  So a tree of any shape is spread within a few rounds: all of it below one entry, one
directory with millions of files, or a long chain.  Hidden, depth and device limits are options and prune the walk itself.  Every executor has to see the trees, as on a shared mount.
"""

from __future__ import annotations

import contextlib
import os
import stat
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import canonical_name, streamed
from ..operators.stage import once
from ..plans import parsing

SCHEMA = (
    "path string, size long, mtime double, depth int, path_index int, dev long, inode long, parent_inode long, link_count int, is_symlink boolean, is_tagged boolean, is_hidden boolean, "
    "cached_checksum string, kind string, mode int, uid long, gid long, target_exists boolean"
)

#: Fixed names of file systems that hold no files of their own.
IGNORED_FILE_SYSTEMS = ("bindfs", "nullfs", "proc", "cgroup", "configfs", "sys", "devtmpfs", "debugfs")


class Root(NamedTuple):
    """A path to scan: ``path, ordinal, tagged`` as the scan takes them, whether all below counts as one volume, and whether its real path is known."""

    path: str
    ordinal: int
    tagged: bool
    one_volume: bool
    resolved: bool


def registered(arguments: list[str], default: str = ".") -> tuple[list[Root], list[str]]:
    """Roots with their real paths, and arguments that can't be read.

    ``//`` alone switches the tag; a path that begins with ``//`` is one volume.  A link that leads nowhere stays as it is; it is reported as a bad link.
    """
    found, unread = [], []
    for path, _, tagged in parsing.roots(arguments, default):
        if not os.access(path, os.R_OK) and not os.path.islink(path):
            unread.append(path)
            continue
        real = os.path.realpath(path)
        resolved = os.path.exists(real)
        found.append(Root(real if resolved else os.path.abspath(path), len(found), tagged, path.startswith("//"), resolved))
    return found, unread


_ABOVE = "above array<struct<dev:bigint,inode:bigint>>"
_TODO = f"raw binary, path_index int, depth int, {_ABOVE}"
_FOUND = f"{SCHEMA}, raw binary, {_ABOVE}"
_PLACES = pa.list_(pa.struct([("dev", pa.int64()), ("inode", pa.int64())]))
_FIRST_SHARE, _LARGEST_SHARE = 512, 1 << 20  # visits of a task in the first round, and at most


class Walker:
    """Visits paths below roots."""

    def __init__(self, roots: list[str], tagged: list[bool], hidden: str = "ignore", symlinks: str = "see", max_depth: int | None = None, cross_devices: bool = True, permissions: str = "", exclude: tuple[str, ...] = (), outputs: tuple[str, ...] = ()):
        self.roots, self.tags, self.hidden, self.symlinks, self.max_depth, self.crossdev = roots, tagged, hidden, symlinks, max_depth, cross_devices
        self.mask = sum({"r": os.R_OK, "w": os.W_OK, "x": os.X_OK}[c] for c in permissions)
        self.skip = set(exclude)
        self.outputs, self.own = outputs, None
        self.devices: dict[int, int | None] = {}

    def walk(self, items: Iterator[tuple], visits: int) -> Iterator[tuple]:
        """Rows of the items (path, root, depth, places above), and of what lies below them for as many visits; ``todo`` rows of what is left."""
        for item in items:
            stack = [item]
            while stack:
                row, inside = self._visit(*stack.pop())
                visits -= 1
                yield from row
                if visits > 0:
                    stack += inside
                    continue
                for path, index, depth, above in (*stack, *inside):
                    yield (*[None] * 3, depth, index, *[None] * 8, "todo", *[None] * 4, os.fsencode(path), above)
                stack = []

    def _device(self, index: int) -> int | None:
        if index not in self.devices:
            try:
                self.devices[index] = os.stat(self.roots[index]).st_dev
            except OSError:
                self.devices[index] = None
        return self.devices[index]

    def _written(self, found: os.stat_result) -> bool:
        """Whether that is one of the outputs, by whatever path; they are looked up once a task, as numbers of devices hold for one machine."""
        if self.own is None:
            self.own = set()
            for path in self.outputs:
                with contextlib.suppress(OSError):  # not written yet
                    at = os.stat(path)
                    self.own.add((at.st_dev, at.st_ino))
        return (found.st_dev, found.st_ino) in self.own

    def _visit(self, path: str, index: int, depth: int, above: list[tuple[int, int]]) -> tuple[list[tuple], list[tuple]]:
        """The rows of one path, and the items inside it."""
        row = lambda *a, **k: self._row(path, depth, index, *a, **k)
        hidden = depth > 0 and any(p.startswith(".") for p in os.path.relpath(path, self.roots[index]).split("/"))
        if path in self.skip:
            return [], []
        if depth and os.path.basename(path).startswith(".") and self.hidden == "ignore":
            return [row(hidden=True, kind="skipped")], []
        try:
            own = os.lstat(path)
            link = stat.S_ISLNK(own.st_mode)
            exists = not link or os.path.exists(path)
            if link and (self.symlinks == "follow" or depth == 0) and exists:
                own, link = os.stat(path), False
        except OSError:
            return [row(kind="error")], []
        if self._written(own):
            return [], []
        if not exists:
            return [row(own, True, hidden, "badlink", False)], []
        if link:
            return [row(own, True, hidden, "symlink")] if self.symlinks == "see" else [], []
        if stat.S_ISREG(own.st_mode):
            fine = not self.mask or os.access(path, self.mask)
            return [row(own, False, hidden, "file" if fine else "skipped")], []
        if not stat.S_ISDIR(own.st_mode) or not self.crossdev and own.st_dev != self._device(index):
            return [row(own, False, hidden, "skipped")], []
        found, here = [row(own, False, hidden, "dir")], (own.st_dev, own.st_ino)
        if here in above:  # a loop ends
            return found, []
        if depth == self.max_depth:
            return [*found, row(own, False, hidden, "skipped")], []
        try:
            names = sorted(os.listdir(path), reverse=True)
        except OSError:
            return [*found, row(kind="error")], []
        return found, [(os.path.join(path, n), index, depth + 1, [*above, here]) for n in names]

    def _row(self, path: str, depth: int, index: int, own=None, link: bool = False, hidden: bool = False, kind: str = "file", exists: bool = True) -> tuple:
        try:
            parent = os.stat(os.path.dirname(path) or ".").st_ino
        except OSError:
            parent = None
        shown = path.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace")
        tagged = self.tags[index]
        if own is None:
            return (shown, None, None, depth, index, None, None, parent, None, link, tagged, hidden, None, kind, *[None] * 6)
        return (shown, own.st_size, own.st_mtime_ns / 1e9, depth, index, own.st_dev, own.st_ino, parent, own.st_nlink, link, tagged, hidden, None, kind, own.st_mode, own.st_uid, own.st_gid, exists, None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [pa.field(n, kinds[t]) for n, t in (x.split() for x in SCHEMA.split(", "))] + [pa.field("raw", pa.binary()), pa.field("above", _PLACES)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))


def _round(todo: DataFrame, walker: Walker, visits: int) -> DataFrame:
    """The written rows of one round; ``todo`` rows are for the next one."""
    waiting, parallel = todo.count(), todo.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(waiting, max(4 * parallel, waiting >> 16)))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = ((os.fsdecode(raw), index, depth, [(x["dev"], x["inode"]) for x in above]) for b in batches for raw, index, depth, above in zip(*(c.to_pylist() for c in b.columns)))
        rows: list[tuple] = []
        for row in walker.walk(items, visits):
            rows.append(row)
            if len(rows) == 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return once(todo.repartition(tasks).mapInArrow(visited, _FOUND), "walk")


def read_tree(spark: SparkSession, roots: list[tuple[str, int, bool]], hidden: str = "ignore", symlinks: str = "see", max_depth: int | None = None, cross_devices: bool = True, permissions: str = "", exclude: list[str] | tuple[str, ...] = (), outputs: list[tuple[str, str]] | tuple = ()) -> DataFrame:
    """One row per entry: kind is file, symlink, dir, badlink, skipped (left out, but makes its directory non-empty) or error.

    A directory at ``max_depth`` has a row of each kind, dir and skipped, as nothing is known of its inside; one that can't be listed is dir and error.
    ``outputs``, as ``parsing.output`` tells them, are where the results go: what is there already, a file or a folder, is no part of the walk, by whatever path it is
    reached.  Sockets, pipes and devices are skipped.  The walk runs now, in rounds; the rows are read from what it has written.
    """
    walker = Walker([r[0] for r in roots], [bool(r[2]) for r in roots], hidden, symlinks, max_depth, cross_devices, permissions, tuple(exclude), tuple(os.path.abspath(place) for _, place in outputs if place not in ("stdout", "stderr")))
    todo = spark.createDataFrame([(os.fsencode(path), index, 0, []) for index, path in enumerate(walker.roots)], _TODO)
    rounds, visits = [], _FIRST_SHARE
    while not rounds or not todo.isEmpty():
        found = _round(todo, walker, visits)
        rounds.append(found.filter("kind <> 'todo'").drop("raw", "above"))
        todo = found.filter("kind = 'todo'").select("raw", "path_index", "depth", "above")
        visits = min(8 * visits, _LARGEST_SHARE)
    return reduce(DataFrame.unionByName, rounds)


def read_range(path: str, start: int = 0, length: int | None = None, link: bool = False) -> bytes | None:
    """Bytes of a file, the target of a link, or null if it can't be read."""
    try:
        if link:
            return os.readlink(path).encode()
        with open(path, "rb") as f:
            f.seek(start)
            return f.read() if length is None else f.read(length)
    except OSError:
        return None


def with_content(records: DataFrame, most: int | None = None) -> DataFrame:
    """Adds ``content`` to records, read where their task runs; links have their target, unreadable files null."""

    def rows(batches):
        for b in batches:
            got = [read_range(p, 0, most, bool(s)) for p, s in zip(b.column("path").to_pylist(), b.column("is_symlink").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*b.schema.names, "content"])

    return records.mapInArrow(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", content binary")


def with_digest(records: DataFrame, algorithm: str = "blake2b", chunk: int = 1 << 20) -> DataFrame:
    """Adds ``checksum`` of whole files without holding one in memory; each inode is read once."""
    canonical_name(algorithm)

    def chunks(path):
        with open(path, "rb") as f:
            while block := f.read(chunk):
                yield block

    def rows(batches):
        for b in batches:
            out = []
            for path in b.column("path").to_pylist():
                try:
                    out.append(streamed(chunks(path), algorithm))
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("dev"), b.column("inode"), pa.array(out, pa.string())], names=["dev", "inode", "checksum"])

    once = records.groupBy("dev", "inode").agg(F.min("path").alias("path")).select("path", "dev", "inode")
    return records.join(once.mapInArrow(rows, "dev long, inode long, checksum string"), ["dev", "inode"])


def known_ids(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The users and groups of this machine."""
    import grp
    import pwd

    return spark.createDataFrame([(u.pw_uid,) for u in pwd.getpwall()], "uid long"), spark.createDataFrame([(g.gr_gid,) for g in grp.getgrall()], "gid long")


def mount_table(spark: SparkSession, text: str | None = None) -> DataFrame:
    """``dev, fs_type, is_ignored, can_reflink`` of this machine's mounts."""
    if text is None:
        with open("/proc/self/mountinfo") as f:
            text = f.read()
    rows = []
    for line in text.splitlines():
        left, _, right = line.partition(" - ")
        major, minor = map(int, left.split()[2].split(":"))
        kind = right.split()[0]
        rows.append((os.makedev(major, minor), kind, kind in IGNORED_FILE_SYSTEMS, kind in ("btrfs", "xfs", "ocfs2")))
    return spark.createDataFrame(rows, "dev long, fs_type string, is_ignored boolean, can_reflink boolean")


def path_list(text: str, null_separated: bool = False) -> list[str]:
    """Paths from standard input, one a line or separated by NUL."""
    return [p for p in text.split("\0" if null_separated else "\n") if p]
