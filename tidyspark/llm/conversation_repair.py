"""Repair of conversation structure by error-correcting Earley parsing.

A sound conversation is empty, or an optional system turn and pairs of a user's and an assistant's turn.  Left recursion keeps every chart item's origin
at the first turn, so a column of the chart has a dozen items.  Error productions delete a turn, give it another role or insert an empty one; an item keeps the least
(cost, audit), audit being the initials of the edits so far.  Items that cost too much to come back into any cheapest parse go, and what all
others have in common is settled: its turns are told at once, so a conversation of any length passes through a task turn by turn.

Turns that repeat earlier ones are found by Spark with a grouping on role and text; a task remembers none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Left and right sides; a dialogue D grows by pairs.  The empty conversation has a production of its own.
PRODUCTIONS = (("C", ""), ("D", "sua"), ("D", "ua"), ("D", "Dua"))
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
_GROW = (3, 1)  # D -> D . u a
#: From any item two insertions and the deletion of a system turn lead to where any other item gets; what is dearer than that by more goes.
_SLACK = 2 * INSERT + DELETE
_SETTLE = 64

Item = tuple[int, int]
Weight = tuple[int, str]


def _symbol(item: Item) -> str:
    side = PRODUCTIONS[item[0]][1]
    return side[item[1]] if item[1] < len(side) else ""


def _closed(column: dict[Item, Weight]) -> dict[Item, Weight]:
    """Adds what insertions and completed dialogues lead to."""
    todo = list(column)
    while todo:
        item = todo.pop()
        cost, audit = column[item]
        symbol = _symbol(item)
        if symbol in ("u", "a"):
            new, weight = (item[0], item[1] + 1), (cost + INSERT, audit + "I")
        elif not symbol and item[0]:
            new, weight = _GROW, (cost, audit)
        else:
            continue
        if new not in column or weight < column[new]:
            column[new] = weight
            todo.append(new)
    return column


def _scanned(column: dict[Item, Weight], initial: str, must_go: bool, truncated: bool) -> dict[Item, Weight]:
    """The next column, by a turn whose role has this initial."""
    found: dict[Item, Weight] = {}

    def put(item: Item, weight: Weight) -> None:
        if item not in found or weight < found[item]:
            found[item] = weight

    for item, (cost, audit) in column.items():
        put(item, (cost + DELETE, audit + "D"))
        symbol = _symbol(item)
        if symbol and not must_go:
            if symbol == initial:
                put((item[0], item[1] + 1), (cost + TRUNCATED * truncated, audit + "K"))
            elif symbol != "s":
                put((item[0], item[1] + 1), (cost + REROLE + TRUNCATED * truncated, audit + "R"))
    found = _closed(found)
    most = min(found.values())[0] + _SLACK
    return {item: weight for item, weight in found.items() if weight[0] <= most}


class Repair:
    """One conversation, turn by turn; ``tell(edit, role, text)`` hears of each settled edit."""

    def __init__(self, tell=None):
        self.tell, self.column, self.waiting, self.audit, self.expected = tell, _closed({(0, 0): (0, ""), (1, 0): (0, ""), (2, 0): (0, "")}), [], [], "su"
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last = None
        self.before, self.initial = None, None

    def turn(self, turn: int | None, role: str, text: str, repeats: bool) -> None:
        """The next turn in order; ``repeats``: an earlier turn number has the same role and text."""
        body = text.rstrip(BLANK)
        same = (turn, role, text)
        blank, duplicate = not body, bool(body) and (repeats or same == self.before)
        truncated = bool(body) and not duplicate and body[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if turn is not None:
            self.turns += turn != self.last
            self.least, self.last = turn if self.least is None else self.least, turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial, self.before = initial, same
        self.column = _scanned(self.column, initial, blank or duplicate, truncated)
        self.waiting.append((role, text))
        if len(self.waiting) % _SETTLE == 0:
            known = commonprefix([audit for _, audit in self.column.values()])
            self._settle(known)
            self.column = {item: (cost, audit[len(known) :]) for item, (cost, audit) in self.column.items()}

    def _settle(self, edits: str) -> None:
        self.audit.append(edits)
        if not self.tell:
            return
        at = 0
        for edit in edits:
            role, text = (None, "") if edit == "I" else self.waiting[at]
            at += edit != "I"
            if edit != "D":
                initial = role[:1] if edit == "K" else self.expected[-1]
                role = role if edit == "K" else ROLES[initial]
                self.expected = "a" if initial == "u" else "u"
            self.tell(edit, role, text)
        del self.waiting[:at]

    def end(self) -> tuple[int, int, int, int, int, int, str]:
        """gaps, blank, duplicate, truncated, illegal, cost, audit"""
        cost, audit = min(w for item, w in self.column.items() if not _symbol(item))
        self._settle(audit)
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, gone``: the rows with faults, by the CRC of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays as ``gone``, so that its conversation is known), 1 empties its text, 2 takes its ends of sentences away, 3 repeats it and 4 makes it the user's.  Nulls are one space, but null ids and turns stay null in the result.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col))
    role = F.when(fault == 4, "user").otherwise(space(role_col))
    times = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), times.alias("__copy"))
    return rows.drop("__copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """Conversation by conversation, its rows by turn, role and text, with ``repeats``."""
    group = ["conv_id", "role", "__sha"]
    rows = rows.select("conv_id", "turn", "role", "text", "gone", F.when(F.col("gone"), F.lit(None)).otherwise(F.sha2("text", 256)).alias("__sha"))
    first = rows.filter("NOT gone").groupBy(*group).agg(F.min(F.struct("turn")).alias("__first")).select(*(F.col(c).alias(f"__{c}") for c in group), "__first")
    same: Column = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("role") == F.col("__role")) & (F.col("__sha") == F.col("____sha"))
    marked = rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "gone", (~F.col("turn").eqNullSafe(F.col("__first.turn"))).alias("repeats"))
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, place long, role string, text string, edit string"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int | None, tuple | None]]:
    """(starts a conversation, its id, a turn or None for one that is gone)"""
    first, last = True, None
    for batch in batches:
        for conv, turn, role, text, gone, repeats in zip(*(c.to_pylist() for c in batch.columns)):
            starts = first or conv != last
            first, last = False, conv
            yield starts, conv, None if gone else (turn, role, text, repeats)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in schema.split(", ")))
    kinds = [pa.int64() if t == "long" else pa.string() for t in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(names))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text, gone``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Turns are taken by number (nulls first), then role, then text.  A turn's first fault counts: blank, duplicate (role and text seen earlier) or truncated (the last
    character that isn't blank is none of ``.!?``); ``gaps`` are missing numbers, ``illegal`` neighbours whose roles don't follow.  The cheapest edits keep a turn (0), give it the role of user or assistant (2), delete it
    (3, a must for blank and duplicate turns) or insert an empty one (2); a truncated turn that stays adds 1.  Of equally cheap ones the least ``audit`` is taken.  ``repaired_sha256`` is of the repaired turns as ``role:text``, joined by newlines.

    Rows that are ``gone`` only tell of their conversation; one without other rows has zeros and an empty audit.  A null ``conv_id`` is a conversation; a null turn has no number; role and text must not be null (``damaged`` and ``as_rows`` see to that).
    Repeated rows are duplicates.  An empty table has no rows.  A conversation is a single text for its digest, so one task reads it, turn by turn, and holds the few turns that are not settled and the letters of its audit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, digest, conv = [], None, None, None

        def hearing(sha, some: list[bool]):
            def tell(edit: str, role: str, text: str) -> None:
                if edit != "D":
                    sha.update((("\n" if some else "") + f"{role}:{text}").encode())
                    some[:] = [True]

            return tell

        for starts, this, turn in _conversations(batches):
            if starts:
                if now:
                    done.append((conv, *now.end(), digest.hexdigest()))
                if len(done) >= 1000:
                    yield _table(done, _REPORT)
                    done = []
                conv, digest = this, hashlib.sha256()
                now = Repair(hearing(digest, []))
            if turn:
                now.turn(*turn)
        if now:
            done.append((conv, *now.end(), digest.hexdigest()))
            yield _table(done, _REPORT)

    return _in_order(rows).mapInArrow(run, _REPORT)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place`` (from 0)``, role, text, edit`` (K, R or I), one row per turn; a conversation that loses all turns has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now = None

        def hearing(conv: int | None):
            place = iter(range(1 << 62))
            return lambda edit, role, text: edit == "D" or out.append((conv, next(place), role, text, edit))

        for starts, conv, turn in _conversations(batches):
            if starts:
                if now:
                    now.end()
                now = Repair(hearing(conv))
            if turn:
                now.turn(*turn)
            if len(out) >= 1000:
                yield _table(out, _TURNS)
                out.clear()
        if now:
            now.end()
        if out:
            yield _table(out, _TURNS)

    return _in_order(rows).mapInArrow(run, _TURNS)


def as_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as they are, for ``repair`` and ``repaired``; null roles and texts are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), F.lit(False).alias("gone"))
