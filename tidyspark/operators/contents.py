"""Where the sieve gets digests from, without a content in any shuffle.

Contents in a column stand in the records: digests are taken where the rows are scanned, and only they travel.  A content that is no longer than
the first prefix gets its digest at once; of longer ones a second scan takes the digests if they still have a partner.  It finds them by a table of at
most ``SLOTS`` hash slots, so that what is broadcast has a fixed size.  A record whose slot is shared by chance is hashed in vain, and no more.

Contents in files are read by path where their task runs, once for each inode: first a prefix, then longer ones, each only of files that
still have a partner, and the rest in chunks.  A file without a partner of its size is never opened.  A chained digest goes on where the last stage stopped;
with others a stage reads the shorter prefix again.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import CHAIN, LINKS, canonical_name, digest, new_state
from .stage import once

SLOTS = 1 << 18
STAGE_GROWTH = 64  # of a prefix to the one before
LONGEST_PREFIX = 1 << 26


def sliced(content: Column, most: int | None = None) -> Column:
    """The part of the content that counts, as bytes; of that the first ``most``."""
    length = F.col("eff_size") - F.col("start")
    length = length if most is None else F.least(F.lit(most), length)
    return F.substring(content.cast("binary"), (F.col("start") + 1).cast("int"), length.cast("int"))


def mark(content: Column) -> Column:
    """What contents are sorted by before their bytes are compared."""
    return F.sha2(content, 256)


class InColumn:
    """Contents in the column ``content`` of records that have ``start`` and ``eff_size``."""

    reads_files = False
    _keys = ["path", "start", "eff_size", "prefix"]

    def __init__(self, records: DataFrame, prefix_bytes: int, algorithm: str):
        beginning = F.xxhash64(sliced(F.col("content"), prefix_bytes)) if prefix_bytes else F.lit(0).cast("long")
        self._records = records.withColumn("prefix", F.when(F.col("content").isNotNull(), beginning))
        self._algorithm = algorithm
        self._long = (F.col("eff_size") - F.col("start") > prefix_bytes) & F.col("cached_checksum").isNull()

    def rows(self) -> DataFrame:
        """The records without content; ``prefix`` is a hash of its beginning, null if there is none, and ``checksum`` the digest of a short one."""
        if self._algorithm == "paranoid":
            return self._records.drop("content")
        short = F.when(~self._long & F.col("cached_checksum").isNull(), sliced(F.col("content")))
        return self._records.withColumn("checksum", digest(short, self._algorithm)).drop("content")

    def known(self, rows: DataFrame) -> DataFrame | None:
        """The written rows with their checksums, if no content is long."""
        if self._algorithm == "paranoid" or rows.filter(self._long).limit(1).count():
            return None
        return rows

    def staged(self, members: DataFrame, alive: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
        return alive(members, F.col("prefix"))

    def _of(self, members: DataFrame) -> DataFrame:
        """Records with content that may be among the members; no other row is left but by chance."""
        slot = F.pmod(F.xxhash64("eff_size", "start", "prefix"), F.lit(SLOTS)).cast("int")
        slots = F.broadcast(members.select(slot.alias("__slot")).distinct())  # at most SLOTS integers
        return self._records.filter("content IS NOT NULL").withColumn("__slot", slot).join(slots, "__slot", "left_semi")

    def digests(self, members: DataFrame, wanted: Column, algorithm: str) -> DataFrame:
        """Members with ``checksum`` where ``wanted``."""
        taken = self._of(members.filter(wanted & self._long)).filter(self._long).select(*self._keys, digest(sliced(F.col("content")), algorithm).alias("__digest"))
        found = members.join(taken.dropDuplicates(self._keys), self._keys, "left")
        return found.withColumn("checksum", F.coalesce("checksum", "__digest")).drop("__digest")

    def compared(self, members: DataFrame, group: list[str]) -> DataFrame:
        """Members with content and ``checksum``, which equals another one's of the group where the bytes do, and only there.

        Contents travel once for that, in a grouping that combines before the shuffle; members take part by digest.  Where unequal contents share a
        digest, all but one of them get a longer name, and the members concerned find theirs by content.
        """
        of_content = ["start", "eff_size", "checksum"]
        taken = self._of(members).select(*self._keys, sliced(F.col("content")).alias("__content")).withColumn("checksum", mark(F.col("__content")))
        shared = once(taken.groupBy(*of_content, "__content").count().groupBy(*of_content).count().filter("count > 1").drop("count"), "shared")
        told = members.drop("checksum").join(taken.select(*self._keys, "checksum").distinct(), self._keys)
        if not shared.limit(1).count():
            return told
        heads = taken.join(shared, of_content, "left_semi").groupBy(*of_content, "__content").agg(F.min("path").alias("__head"))
        named = heads.join(heads.groupBy(*of_content).agg(F.min("__head").alias("__first")), of_content)
        named = named.withColumn("__name", F.when(F.col("__head") != F.col("__first"), F.concat_ws(":", "checksum", "__head")))
        renamed = taken.join(named, [*of_content, "__content"]).select(*self._keys, "__name").dropDuplicates(self._keys)
        return told.join(renamed, self._keys, "left").withColumn("checksum", F.coalesce("__name", "checksum")).drop("__name")


def _chunks(path: str, link: bool, start: int, length: int, chunk: int = 1 << 20):
    if link:
        yield os.readlink(path).encode()[start : start + length]
        return
    with open(path, "rb") as f:
        f.seek(start)
        while length > 0 and (block := f.read(min(chunk, length))):
            length -= len(block)
            yield block


def _read(files: DataFrame, algorithm: str | None, most: int | None) -> DataFrame:
    """``dev, inode, start, eff_size, found``: the digest (blake2b without an algorithm) of the range, of its first ``most`` bytes if that is given; null if it can't be read.

    With columns ``__at`` and ``__link`` a chained digest goes on behind the first ``__at`` bytes.
    """

    def rows(batches):
        for b in batches:
            out = []
            for path, link, start, end, at, before in zip(*(b.column(c).to_pylist() for c in ("path", "is_symlink", "start", "eff_size", "__at", "__link"))):
                state = new_state(algorithm, at, before) if algorithm else hashlib.blake2b(digest_size=16)
                try:
                    for block in _chunks(path, link, start + at, (end - start if most is None else min(most, end - start)) - at):
                        state.update(block)
                    out.append(state.hexdigest())
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _FILE), pa.array(out, pa.string())], names=[*_FILE, "found"])

    if "__link" not in files.columns:
        files = files.withColumn("__at", F.lit(0).cast("long")).withColumn("__link", F.lit(""))
    heads = files.groupBy(*_FILE).agg(*(F.min(c).alias(c) for c in ("path", "is_symlink", "__at", "__link")))
    return heads.mapInArrow(rows, "dev long, inode long, start long, eff_size long, found string")


_FILE = ["dev", "inode", "start", "eff_size"]


class InFile:
    """Contents of files that all executors see, for records that have ``start`` and ``eff_size``."""

    reads_files = True

    def __init__(self, records: DataFrame, prefix_bytes: int, algorithm: str = ""):
        self._records, self._prefix_bytes = records, prefix_bytes
        self._chain = algorithm if algorithm and canonical_name(algorithm).endswith(CHAIN) else None

    def rows(self) -> DataFrame:
        return self._records

    def known(self, rows: DataFrame) -> DataFrame | None:
        return None

    def staged(self, members: DataFrame, alive: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
        """Members that have a partner after prefixes of growing length, as long as there are longer files.

        The prefixes of a chained digest end where its links do, whatever the first one's length; ``prefix_bytes=0`` means one stage for it, too.
        """
        if self._chain:
            members = members.withColumn("__at", F.lit(0).cast("long")).withColumn("__link", F.lit(""))
        for step in self._steps():
            members = once(members, "survivors")
            longer = (F.col("eff_size") - F.col("start") > step) & F.col("cached_checksum").isNull()
            if not members.filter(longer).limit(1).count():
                break
            found = _read(members.filter(longer), self._chain, step)
            told = members.join(found, _FILE, "left").filter(~longer | F.col("found").isNotNull())
            if self._chain:
                told = told.withColumn("__at", F.when(longer, F.lit(step).cast("long")).otherwise(F.col("__at"))).withColumn("__link", F.coalesce("found", "__link"))
            members = alive(told, F.coalesce("found", F.lit(""))).drop("found")
        return members

    def _steps(self) -> list[int]:
        if not self._prefix_bytes:
            return []
        if self._chain:
            return list(LINKS)
        steps = [self._prefix_bytes]
        while steps[-1] * STAGE_GROWTH <= LONGEST_PREFIX:
            steps.append(steps[-1] * STAGE_GROWTH)
        return [s for s in steps if s <= LONGEST_PREFIX]

    def digests(self, members: DataFrame, wanted: Column, algorithm: str) -> DataFrame:
        """Members with ``checksum`` where ``wanted``."""
        members = once(members, "survivors")
        found = _read(members.filter(wanted), algorithm, None).withColumnRenamed("found", "checksum")
        return members.join(found, _FILE, "left").drop("__at", "__link")

    def compared(self, members: DataFrame, group: list[str]) -> DataFrame:
        """Members that have the same bytes as the first of their digest; both files are read side by side, where the task runs."""
        told = once(self.digests(members, F.lit(True), "sha256").filter("checksum IS NOT NULL"), "digests")
        heads = told.groupBy(*group, "checksum").agg(F.min("path").alias("__head"))
        files = told.join(heads, [*group, "checksum"]).select(*_FILE, "path", "is_symlink", "__head").dropDuplicates([*_FILE, "__head"])

        def rows(batches):
            for b in batches:
                same = []
                for path, link, start, end, head in zip(*(b.column(c).to_pylist() for c in ("path", "is_symlink", "start", "eff_size", "__head"))):
                    try:
                        same.append(path == head or all(x == y for x, y in zip_longest(_chunks(path, link, start, end - start), _chunks(head, link, start, end - start))))
                    except OSError:
                        same.append(False)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _FILE), pa.array(same, pa.bool_())], names=[*_FILE, "same"])

        good = files.mapInArrow(rows, "dev long, inode long, start long, eff_size long, same boolean").filter("same").select(*_FILE).distinct()
        return told.join(good, _FILE, "left_semi")
