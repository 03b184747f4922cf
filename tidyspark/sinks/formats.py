"""What results look like outside: lines as DataFrames, so that each sink is a plan until it is written."""

from __future__ import annotations

import json
import os
import time
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.config import Config
from . import document

_ELEMENT = ("id", "type", "progress", "checksum", "path", "size", "depth", "inode", "disk_id", "is_original", "n_children", "twins", "parent_path", "hardlink_of", "mtime")


def elements(rows: DataFrame, unique: bool = False) -> DataFrame:
    """Rows in the columns of a result, in its order."""
    if not unique:
        rows = rows.filter("type <> 'unique_file'")
    has = set(rows.columns)
    given = {"id": C.record_id(F.col("path")).cast("long"), "progress": F.lit(100), "disk_id": F.col("dev") if "dev" in has else F.lit(None).cast("long")}
    return rows.select(*(F.col(c).alias(c) if c in has else given.get(c, F.lit(None)).alias(c) for c in _ELEMENT))


class Figures:
    """What a summary and statistics tell of the rows of a result, gathered while these are written: no job of its own.

    ``of`` gives the rows to write in place of others; a sort has to come before it, as its sampling would count rows twice.  The figures are there once the rows have been written.
    """

    def __init__(self):
        self._seen = Observation()

    def of(self, members: DataFrame) -> DataFrame:
        extra = ~F.col("is_original")
        size = lambda when: F.coalesce(F.sum(F.when(when, F.col("size"))), F.lit(0)).cast("long")
        ones = lambda when: F.coalesce(F.sum(when.cast("long")), F.lit(0))
        return members.observe(
            self._seen, F.count(F.lit(1)).alias("rows"), ones(extra).alias("duplicates"), ones(F.col("rank_in_group") == 1).alias("duplicate_sets"), size(F.col("is_original")).alias("original_bytes"), size(extra).alias("duplicate_bytes")
        )

    def get(self) -> dict[str, int]:
        return self._seen.get


def json_lines(rows: DataFrame, unique: bool = False) -> DataFrame:
    return elements(rows, unique).select(F.to_json(F.struct(*_ELEMENT)).alias("value"))


def write_json(rows: DataFrame, path: str, header: dict | None = None, footer: dict | None = None, oneline: bool = False, unique: bool = False, no_body: bool = False, figures: Figures | None = None) -> None:
    """``oneline``: a directory of documents, one a line, written by the tasks.  Otherwise one array in one file, written in segments by the tasks (see ``document``).

    With ``rank_in_group`` and ``group_rank`` in the rows the array has them in that order.  ``no_body`` leaves the elements out.  ``figures`` are gathered on the way.
    """
    order = [c for c in ("group_rank", "checksum", "rank_in_group") if c in rows.columns]
    rows = rows.orderBy(*order) if order and not oneline else rows
    lines = json_lines(figures.of(rows) if figures else rows, unique)
    if no_body:
        lines = lines.limit(0)
    if oneline:
        lines.write.mode("overwrite").text(path)
        return
    backup(path)
    before = [json.dumps({"progress": 0, **header})] if header is not None else []
    after = [json.dumps({"aborted": False, "progress": 100, **footer})] if footer is not None else []
    document.write(lines, path, "[\n", ",\n", "\n]\n", before, after, empty="[]\n")


def csv_rows(rows: DataFrame, unique: bool = False) -> DataFrame:
    """``type, path, size, checksum``, without parts of directories; an empty checksum is empty text."""
    if not unique:
        rows = rows.filter("type <> 'unique_file'")
    checksum = F.coalesce(F.col("checksum"), F.lit("")) if "checksum" in rows.columns else F.lit("")
    return rows.filter("type <> 'part_of_directory'").select("type", "path", "size", checksum.alias("checksum"))


def write_csv(rows: DataFrame, path: str, no_header: bool = False, unique: bool = False) -> None:
    csv_rows(rows, unique).write.mode("overwrite").option("header", not no_header).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def unique_paths(rows: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Paths of unique files; of the protected side only, if one is."""
    out = rows.filter("type = 'unique_file'")
    if cfg and (cfg.keep_all_tagged or cfg.keep_all_untagged):
        out = out.filter("is_original")
    return out.select(F.col("path").alias("value"))


def write_uniques(rows: DataFrame, path: str, print0: bool = False, cfg: Config | None = None) -> None:
    unique_paths(rows, cfg).write.mode("overwrite").option("lineSep", "\0" if print0 else "\n").text(path)


def blocks(members: DataFrame, group: list[str], omit_first: bool = False, same_line: bool = False) -> DataFrame:
    """Members in the order of groups and ranks with ``value``, the path and what ends it: a blank line ends a block, or a line where blocks are on one.

    A group is a stretch of rows, never one text.
    """
    shown = members.filter("NOT is_original") if omit_first else members
    last = shown.groupBy(*group).agg(F.max("rank_in_group").alias("__last"))
    ends = F.when(F.col("rank_in_group") == F.col("__last"), F.lit("\n" if same_line else "\n\n")).otherwise(F.lit(" " if same_line else "\n"))
    return shown.join(last, group).orderBy(*group, "rank_in_group").select(*group, "rank_in_group", F.concat("path", ends).alias("value"))


def write_blocks(members: DataFrame, group: list[str], path: str, omit_first: bool = False, same_line: bool = False) -> None:
    """All blocks in one file, written in segments by the tasks."""
    backup(path)
    document.write(blocks(members, group, omit_first, same_line).select("value"), path)


#: Order in which actions are tried, by preset.
PRESETS = {"clone": ("clone", "reflink", "hardlink", "symlink"), "link": ("reflink", "hardlink", "symlink"), "reflink": ("reflink", "hardlink", "symlink"), "hardlink": ("hardlink", "symlink"), "symlink": ("symlink",), "default": ("cmd", "remove")}


def actions(members: DataFrame, group: list[str], handlers: tuple[str, ...] = PRESETS["default"], command: str | None = None, reflink_devices: DataFrame | None = None, can_clone: bool = True) -> DataFrame:
    """Adds ``action`` and ``original_path``: what a script would do with each row.  Nothing is done to a file here.

    The first handler that accepts a row wins: clone and reflink need a capable device on both sides (``reflink_devices``: dev), clone a kernel that can, too; hardlink the
    original's device; cmd a command; symlink and remove always accept.  A row that shares the original's extents already (``extents``, or the mark ``is_deduplicated``) needs no clone or reflink, and one that
    is a link of the original's file no hardlink: these handlers accept it and skip it.
    """
    extents = F.col("extents") if "extents" in members.columns else F.lit(None).cast("string")
    members = members.withColumn("__extents", extents)
    head = members.filter("is_original").groupBy(*group).agg(F.min_by(F.struct("path", "dev", "inode", "__extents"), "rank_in_group").alias("__o"))
    out = members.join(head, group, "left")
    if reflink_devices is not None:
        out = out.join(reflink_devices.select("dev", F.lit(True).alias("__can")).distinct(), "dev", "left")
    else:
        out = out.withColumn("__can", F.lit(False))
    same_device = F.col("dev") == F.col("__o.dev")
    same_file = same_device & (F.col("inode") == F.col("__o.inode"))
    sharing = F.coalesce(F.col("__can"), F.lit(False)) & same_device
    shared = same_file | F.coalesce(F.col("__extents") == F.col("__o.__extents"), F.lit(False))
    if "is_deduplicated" in members.columns:
        shared |= F.coalesce("is_deduplicated", F.lit(False))
    single = F.col("type") != "duplicate_dir" if "type" in members.columns else F.lit(True)  # a directory can't be a link of another's contents
    accepts: dict[str, Column] = {"cmd": F.lit(command is not None), "clone": single & sharing & F.lit(can_clone), "reflink": single & sharing, "hardlink": single & same_device, "symlink": single, "remove": F.lit(True)}
    done = {"clone": shared, "reflink": shared, "hardlink": same_file}
    chain = F.coalesce(*(F.when(accepts[h], F.when(done[h], "skip").otherwise(h) if h in done else F.lit(h)) for h in handlers), F.lit("skip"))
    return out.withColumn("action", F.when(F.col("is_original"), "keep").otherwise(chain)).withColumn("original_path", F.col("__o.path")).drop("__o", "__can", "__extents")


def directory_actions(dirs: DataFrame, handlers: tuple[str, ...] = PRESETS["default"], command: str | None = None) -> DataFrame:
    """The same for reported directories (``dir, signature``); only a command and ``remove`` accept them."""
    nowhere = F.lit(None).cast("long")
    return actions(dirs.select(F.col("dir").alias("path"), "*").withColumn("dev", nowhere).withColumn("inode", nowhere), ["signature"], handlers, command)


#: Actions for other lint.
LINT_ACTIONS = {"emptydir": "remove_dir", "emptyfile": "remove", "badlink": "remove", "nonstripped": "strip", "baduid": "set_user", "badgid": "set_group", "badugid": "set_user_and_group"}


def lint_actions(lint: DataFrame) -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in LINT_ACTIONS.items() for x in pair))
    return lint.withColumn("action", table[F.col("type")])


def pretty_lines(rows: DataFrame) -> DataFrame:
    """Text for people, in order: a headline per type, then its rows by path."""
    heads = rows.select("type").distinct().select("type", F.lit("").alias("path"), F.concat(F.lit("# "), F.replace("type", F.lit("_"), F.lit(" ")), F.lit(":")).alias("value"), F.lit(0).alias("__row"))
    lines = rows.select("type", "path", F.concat(F.lit("    "), F.when(F.col("is_original"), "ls").otherwise("rm"), F.lit(" "), F.col("path")).alias("value"), F.lit(1).alias("__row"))
    return heads.unionByName(lines).orderBy("type", "__row", "path").select("value")


def pretty(rows: DataFrame) -> Iterator[str]:
    """The lines for a terminal, one after the other."""
    return (r["value"] for r in pretty_lines(rows).toLocalIterator())


def write_pretty(rows: DataFrame, path: str) -> None:
    document.write(pretty_lines(rows).select(F.concat("value", F.lit("\n")).alias("value")), path)


def summary(members: DataFrame, group: list[str], total_files: int, outputs: list[tuple[str, str]] = ()) -> DataFrame:
    """One row: files, duplicates, sets, the size of the duplicates for people, and which results were written where (``format: path``)."""
    written = F.array(*(F.lit(f"{kind}: {path}") for kind, path in outputs if path not in ("stdout", "stderr"))).cast("array<string>")
    extra = F.sum(F.when(~F.col("is_original"), F.col("size")).otherwise(0))
    return members.agg(F.lit(total_files).cast("long").alias("total_files"), F.sum((~F.col("is_original")).cast("long")).alias("duplicates"), F.count_distinct(*group).alias("duplicate_sets"), C.human_size(F.coalesce(extra, F.lit(0))).alias("size")).withColumn("outputs", written)


def stats(members: DataFrame, uniques: DataFrame, read_bytes: DataFrame) -> DataFrame:
    """Bytes of originals, duplicates, others and of what was read, and two shares: duplicates of the bytes read, and of all bytes."""
    a = members.agg(F.sum(F.when(F.col("is_original"), F.col("size")).otherwise(0)).alias("original_bytes"), F.sum(F.when(~F.col("is_original"), F.col("size")).otherwise(0)).alias("duplicate_bytes"))
    b, c = uniques.agg(F.sum("size").alias("unique_bytes")), read_bytes.agg(F.sum("bytes").alias("read_bytes"))
    one = a.crossJoin(b).crossJoin(c)  # one row each
    whole = F.col("original_bytes") + F.col("duplicate_bytes") + F.col("unique_bytes")
    return one.withColumn("read_ratio", F.col("duplicate_bytes") / F.nullif("read_bytes", F.lit(0))).withColumn("total_ratio", F.col("duplicate_bytes") / F.nullif(whole, F.lit(0)))


def write_stamp(path: str, started: float, iso8601: bool = False) -> None:
    """The start of the run, for the next one's newer-than."""
    with open(path, "w") as f:
        f.write(time.strftime("%Y-%m-%dT%H:%M:%S+0000", time.gmtime(started)) if iso8601 else f"{started:.6f}")


def discard(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def backup(path: str) -> str | None:
    """Move an existing result out of the way; its new name has the time of its last change."""
    if not os.path.exists(path):
        return None
    stem, ending = os.path.splitext(path)
    new = f"{stem}.{time.strftime('%Y-%m-%dT%H-%M-%SZ', time.gmtime(os.path.getmtime(path)))}{ending}"
    os.rename(path, new)
    return new


def progress(spark) -> dict[str, int]:
    """Tasks done and to do in the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
    return {"done": sum(s.numCompletedTasks for s in stages), "total": sum(s.numTasks for s in stages)}


class Pace:
    """Time to go from the mean speed of the last samples: what remains by what was done a second."""

    def __init__(self, samples: int = 10):
        self._seen: deque[tuple[float, float]] = deque(maxlen=samples + 1)

    def sample(self, done: float, total: float, now: float | None = None) -> float | None:
        """Seconds to go, once there are two samples with progress between them."""
        self._seen.append((time.monotonic() if now is None else now, done))
        (then, before), (at, upto) = self._seen[0], self._seen[-1]
        if upto <= before or at <= then:
            return None
        return max(total - done, 0) * (at - then) / (upto - before)


def progress_line(done: int, total: int, to_go: float | None, width: int = 30, ascii_only: bool = False) -> str:
    """A bar with the share that is done and the time to go."""
    share = min(done / total, 1.0) if total else 1.0
    full = int(share * width)
    bar = ("#" if ascii_only else "█") * full + ("-" if ascii_only else "░") * (width - full)
    return f"[{bar}] {100 * share:3.0f}%" + ("" if to_go is None else f", {C.elapsed(to_go)} to go")
