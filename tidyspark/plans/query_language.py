"""The filter language: ``size:1K-3M count:2,4-10 mtime:2020-01-01-... words``.

Attributes have comma-separated alternatives, each a value or an inclusive range; what is left is a text that any path component
has to contain, whatever its case.  Zero is a value like any other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stage import once

_STEPS = {unit: 1024**k for k, unit in enumerate("BKMGTP")}
_DAY = r"\d{4}-\d{2}-\d{2}(?:T[0-9:]+Z?)?"


def _size(text: str) -> int:
    unit = text[-1:].upper()
    return int(text[:-1]) * _STEPS[unit] if unit in _STEPS else int(text)


def _time(text: str) -> int:
    if re.fullmatch(_DAY, text):
        stamp = datetime.fromisoformat(text)
        return int((stamp if stamp.tzinfo else stamp.replace(tzinfo=timezone.utc)).timestamp())
    return int(text)


_READ = {"size": _size, "count": int, "mtime": _time}


@dataclass(frozen=True)
class Query:
    text: str = ""
    size: tuple[tuple[int, ...], ...] = ()
    count: tuple[tuple[int, ...], ...] = ()
    mtime: tuple[tuple[int, ...], ...] = ()

    def narrows(self, other: Query | None) -> bool:
        """Whether this can only leave rows of the other's result."""
        return bool(other and other.text) and not (self.size or self.count or self.mtime or other.size or other.count or other.mtime) and self.text.startswith(other.text)

    def condition(self, path: str = "path", size: str = "size", count: str = "twins", mtime: str = "mtime") -> Column:
        out = F.lit(True)
        for name, spans in ((size, self.size), (count, self.count), (mtime, self.mtime)):
            if spans:
                hit = F.lit(False)
                for span in spans:
                    hit = hit | (F.col(name) == span[0] if len(span) == 1 else F.col(name).between(*span))
                out = out & hit
        if len(self.text) >= 2:
            out = out & F.exists(F.split(F.lower(F.col(path)), "/"), lambda part: F.contains(part, F.lit(self.text.lower())))
        return out


def _spans(name: str, text: str) -> tuple[tuple[int, ...], ...]:
    out = []
    for item in filter(None, text.split(",")):
        parts = re.fullmatch(rf"({_DAY}|[^-]+)-({_DAY}|[^-]+)", item) if name != "mtime" or not re.fullmatch(_DAY, item) else None
        try:
            out.append(tuple(_READ[name](p) for p in (parts.groups() if parts else (item,))))
        except ValueError:
            continue  # an unfinished value does not filter
    return tuple(out)


def parse(text: str) -> Query:
    found, words = {}, []
    for word in text.split():
        name, colon, rest = word.partition(":")
        if colon and name in _READ:
            found[name] = found.get(name, ()) + _spans(name, rest)
        else:
            words.append(word)
    return Query(" ".join(words), **found)


def query(rows: DataFrame, text: str, **columns: str) -> DataFrame:
    return rows.filter(parse(text).condition(**columns))


class Refined:
    """Queries on one table, each a refinement of an earlier one where it can be: it reads that one's written result instead of the table."""

    def __init__(self, rows: DataFrame, most: int = 16, **columns: str):
        self._rows, self._most, self._columns = rows, most, columns
        self._known: list[tuple[Query, DataFrame]] = []

    def query(self, text: str) -> DataFrame:
        asked = parse(text)
        for known, found in self._known:
            if known == asked:
                return found
        wider = [(known, found) for known, found in self._known if asked.narrows(known)]
        base = max(wider, key=lambda x: len(x[0].text))[1] if wider else self._rows
        found = once(base.filter(asked.condition(**self._columns)), "query")
        self._known.append((asked, found))
        if len(self._known) > self._most:
            self._known.pop(0)  # its files stay until the application ends, as its reader may have it still
        return found
