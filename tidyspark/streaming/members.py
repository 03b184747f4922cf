"""Copies in a stream, one by one: who belongs to a content now, who is its original, and what changes when members come and leave."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.digests import digest

_CHANGES = "checksum string, shard int, path string, role string, change int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_AT_ONCE = 1 << 16


def _heirs(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The members that are the smallest path at some time, if nothing more comes: each leaves later than all smaller ones."""
    out: list[tuple[str, int]] = []
    for path, leaves in sorted(rows, key=lambda r: (r[0], -r[1])):
        if not out or leaves > out[-1][1]:
            out.append((path, leaves))
    return out


class _Members(StatefulProcessor):
    """Per content: when each path leaves (a map on disk), the line of heirs (a list), and a timer for each time at which somebody leaves."""

    def __init__(self, keep: int, grain: int):
        self.keep, self.grain = keep, grain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.leaves = handle.getMapState("leaves", "path string", "leaves long")
        self.heirs = handle.getListState("heirs", "path string, leaves long")

    def _line(self) -> list[tuple[str, int]]:
        return [(r[0], r[1]) for r in self.heirs.get()] if self.heirs.exists() else []

    def _keep(self, line: list[tuple[str, int]]) -> None:
        if line:
            self.heirs.put(line)
        else:
            self.heirs.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, line = timerValues.getCurrentWatermarkInMs(), self._line()
        for pdf in rows:
            before, new, gained, due = line[0][0] if line else None, [], [], set()
            for path, at in pdf.groupby("path", sort=False)["at"].max().items():
                leaves = -(-(int(at) + self.keep) // self.grain) * self.grain
                known = self.leaves.getValue((path,))
                if leaves <= now or known is not None and known[0] >= leaves:
                    continue
                if known is None:
                    new.append(path)
                self.leaves.updateValue((path,), (leaves,))
                gained.append((path, leaves))
                due.add(leaves)
            if not gained:
                continue
            for leaves in due:
                self.handle.registerTimer(leaves)
            line = _heirs(line + gained)
            self._keep(line)
            after = line[0][0]
            out = [(p, "original" if p == after else "duplicate", 1) for p in new]
            if before is not None and before != after:
                out += [(before, "original", -1), (before, "duplicate", 1)]
                out += [] if after in new else [(after, "duplicate", -1), (after, "original", 1)]
            if out:
                yield self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, line = expiredTimerInfo.getExpiryTimeInMs(), self._line()
        before = line[0][0] if line else None
        line = [r for r in line if r[1] > now]
        self._keep(line)
        while gone := [k[0] for k in islice((k for k, v in self.leaves.iterator() if v[0] <= now), _AT_ONCE)]:
            for path in gone:
                self.leaves.removeKey((path,))
            yield self._told(key, [(p, "original" if p == before else "duplicate", -1) for p in gone])
        if line and line[0][0] != before:
            yield self._told(key, [(line[0][0], "duplicate", -1), (line[0][0], "original", 1)])

    @staticmethod
    def _told(key, rows: list[tuple[str, str, int]]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["path", "role", "change"]).astype({"change": "int32"})
        out.insert(0, "checksum", key[0])
        out.insert(1, "shard", pd.Series([key[1]] * len(out), dtype="int32"))
        return out

    def close(self) -> None:
        pass


def member_changes(stream: DataFrame, path: str, content: str, time: str, keep_seconds: int = 86400, grain_seconds: int = 3600, delay_seconds: int = 3600, shards: int = 1) -> DataFrame:
    """A log of changes ``checksum, shard, path, role, change`` (+1 or -1), role ``original`` or ``duplicate``; what the log adds up to is who is what now.

    A path is a member of its content from its first row until ``keep_seconds`` of event time after its latest one, rounded up to ``grain_seconds``; a row at or behind
    the watermark is late and changes nothing.  The smallest path is the original: a smaller one that comes later takes over, and when it leaves, the next one gets the role; either
    way the old role is taken back.  Repeated rows change nothing.  Rows with a null path, content or time take no part; an empty stream has no changes.

    State is on disk (the RocksDB provider has to be set), a path and a number a member.  When members leave, those of their content are read once, in bounded numbers; the line of
    heirs is held in memory, some log(n) paths if times and paths are unrelated, all of them if later rows always have larger paths.  ``shards`` spreads a content over as
    many keys, each with an original of its own; ``current`` tells the one of all.
    """
    if "RocksDB" not in stream.sparkSession.conf.get(_PROVIDER):
        raise ValueError(f"{_PROVIDER} has to be the RocksDB provider")
    rows = stream.select(F.col(path).cast("string").alias("path"), digest(F.col(content), "sha256").alias("checksum"), F.col(time).alias("__time"))
    rows = rows.filter("path IS NOT NULL AND checksum IS NOT NULL AND __time IS NOT NULL").withWatermark("__time", f"{delay_seconds} seconds")
    rows = rows.select("checksum", F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int").alias("shard"), "path", F.unix_millis("__time").alias("at"), "__time")
    return rows.groupBy("checksum", "shard").transformWithStateInPandas(_Members(1000 * keep_seconds, 1000 * grain_seconds), _CHANGES, "Append", "EventTime")


def current(changes: DataFrame) -> DataFrame:
    """``checksum, path, is_original`` of all members that a log of changes leaves; one original a content, whatever the shards. A log without rows has none."""
    held = changes.groupBy("checksum", "path", "role").agg(F.sum("change").alias("n")).filter("n <> 0")
    heads = held.filter("role = 'original'").groupBy("checksum").agg(F.min("path").alias("__head"))
    return held.join(heads, "checksum").select("checksum", "path", (F.col("path") == F.col("__head")).alias("is_original"))
