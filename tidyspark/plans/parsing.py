"""Small grammars: sizes, ranges, clamps, time stamps, rank and sort criteria, lint types, output specifications."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal, InvalidOperation

LONG_MAX = 2**63 - 1
_LIMIT = 2**64 - 1
#: A letter alone counts in thousands, with a b behind it in 1024s.
_UNITS = {"": 1, "c": 1, "w": 2, "b": 512} | {x: 1000**k for k, x in enumerate("kmgtpe", 1)} | {f"{x}b": 1024**k for k, x in enumerate("kmgtpe", 1)}


class ParseError(ValueError):
    pass


def size(text: str) -> int:
    """A number of bytes with an optional unit: c, w (2), b (512), k m g t p e (powers of 1000) and kb mb gb tb pb eb (of 1024)."""
    found = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([A-Za-z]*)\s*", text)
    if not found or found[2].lower() not in _UNITS:
        raise ParseError(f"no size: {text!r}")
    try:
        value = int(Decimal(found[1]) * _UNITS[found[2].lower()])
    except InvalidOperation as e:
        raise ParseError(f"no size: {text!r}") from e
    if value > _LIMIT:
        raise ParseError(f"size too large: {text!r}")
    return value


def size_range(text: str) -> tuple[int, int]:
    """``a-b`` (both ends count), ``a`` (at least) or ``-b`` (at most); limits beyond a long are clamped to it."""
    low, dash, high = text.partition("-")
    if dash and not low and not high or high.startswith("-"):
        raise ParseError(f"no size range: {text!r}")
    a = size(low) if low else 0
    b = size(high) if dash and high else _LIMIT
    if a > b:
        raise ParseError(f"range ends before it begins: {text!r}")
    return min(a, LONG_MAX), min(b, LONG_MAX)


@dataclass(frozen=True)
class Clamp:
    """A place in a content: a share of its size or an absolute offset."""

    share: float | None = None
    offset: int | None = None


def clamp(text: str) -> Clamp:
    """``.25`` and ``25%`` are shares, as all numbers with a dot; others are sizes."""
    text = text.strip()
    if text.endswith("%"):
        share = float(text[:-1]) / 100
    elif "." in text:
        share = float(text)
    else:
        return Clamp(offset=min(size(text), LONG_MAX))
    if not 0 <= share <= 1:
        raise ParseError(f"share beyond the content: {text!r}")
    return Clamp(share=share)


def stamp(text: str) -> float:
    """Seconds since the epoch, or ISO 8601 if the text has a T."""
    text = text.strip()
    try:
        return datetime.fromisoformat(text).timestamp() if "T" in text else float(text)
    except ValueError as e:
        raise ParseError(f"no time stamp: {text!r}") from e


RANK_LETTERS = "dlamprxho"
DEFAULT_RANK = "pOma"
MOST_PATTERNS = 8


@dataclass(frozen=True)
class Criterion:
    letter: str  # lower case
    reverse: bool
    pattern: str | None = None


def rank(text: str = DEFAULT_RANK) -> list[Criterion]:
    """Criteria in order; upper case reverses; ``r`` and ``x`` take a pattern in angle brackets."""
    out, at, patterns = [], 0, 0
    while at < len(text):
        letter = text[at]
        at += 1
        if letter.lower() not in RANK_LETTERS:
            raise ParseError(f"no rank criterion: {letter!r}")
        pattern = None
        if letter.lower() in "rx":
            if at >= len(text) or text[at] != "<":
                raise ParseError(f"{letter!r} needs a pattern")
            depth, end = 1, at + 1
            while end < len(text) and depth:
                depth += {"<": 1, ">": -1}.get(text[end], 0)
                end += 1
            pattern = text[at + 1 : end - 1]
            if depth or not pattern:
                raise ParseError("pattern is empty or has no end")
            try:
                re.compile(pattern)
            except re.error as e:
                raise ParseError(f"no pattern: {pattern!r}") from e
            patterns += 1
            at = end
        out.append(Criterion(letter.lower(), letter.isupper(), pattern))
    if patterns > MOST_PATTERNS:
        raise ParseError(f"more than {MOST_PATTERNS} patterns")
    if not out:
        raise ParseError("no rank criterion")
    return out


SORT_LETTERS = "moansp"


def group_sort(text: str) -> list[tuple[str, bool]]:
    """(letter, reversed) for ordering groups."""
    if not text or any(c.lower() not in SORT_LETTERS for c in text):
        raise ParseError(f"no group order: {text!r}")
    return [(c.lower(), c.isupper()) for c in text]


#: In order of emission.
LINT_TYPES = ("badlink", "emptydir", "emptyfile", "nonstripped", "baduid", "badgid", "badugid", "duplicate_file", "duplicate_dir", "unique_file", "part_of_directory")
_IDS = ("baduid", "badgid", "badugid")
_NAMED = {
    "badids": _IDS, "bi": _IDS, "badlinks": ("badlink",), "bl": ("badlink",), "emptydirs": ("emptydir",), "ed": ("emptydir",), "emptyfiles": ("emptyfile",), "ef": ("emptyfile",), "nonstripped": ("nonstripped",), "ns": ("nonstripped",),
    "duplicates": ("duplicate_file",), "df": ("duplicate_file",), "dupes": ("duplicate_file",), "duplicatedirs": ("duplicate_dir",), "dd": ("duplicate_dir",), "dupedirs": ("duplicate_dir",),
}
_DEFAULTS = (*_IDS, "badlink", "emptydir", "emptyfile", "duplicate_file")
_GROUPS = {"all": (*_DEFAULTS, "nonstripped", "duplicate_dir"), "defaults": _DEFAULTS, "minimal": (*_IDS, "badlink", "duplicate_file"), "minimaldirs": (*_IDS, "badlink", "duplicate_dir"), "none": ()}


def lint_types(text: str) -> frozenset[str]:
    """A group and names with + or -, separated by any one character that is no letter or sign."""
    words = re.findall(r"[+-]?[A-Za-z]+", text)
    if not words:
        raise ParseError("no lint types")
    signed = words[0][0] in "+-"
    found = set(_DEFAULTS) if signed else set()
    for k, word in enumerate(words):
        sign, name = (word[0], word[1:].lower()) if word[0] in "+-" else ("+", word.lower())
        if name in _GROUPS:
            if k:
                raise ParseError("a group has to come first")
            found = set(_GROUPS[name])
        elif name in _NAMED:
            found = found | set(_NAMED[name]) if sign == "+" else found - set(_NAMED[name])
        else:
            raise ParseError(f"no lint type: {name!r}")
    return frozenset(found)


FORMATS = {
    "json": ("no_header", "no_footer", "no_body", "oneline", "unique"), "csv": ("no_header", "unique"), "sh": ("handler", "cmd", "clone", "link", "hardlink", "symlink", "reflink"), "py": (), "uniques": ("print0",),
    "fdupes": ("omitfirst", "sameline"), "pretty": (), "summary": (), "stats": (), "stamp": ("iso8601",), "progressbar": ("update_interval", "ascii", "fancy"), "null": (), "_equal": (),
}


def output(text: str) -> tuple[str, str]:
    """(format, path) of ``format:path``, ``format`` (stdout) or ``file.format``."""
    name, colon, path = text.partition(":")
    if colon and name in FORMATS:
        return name, path
    if not colon and text in FORMATS:
        return text, "stdout"
    ending = text.rpartition(".")[2]
    if ending in FORMATS:
        return ending, text
    raise ParseError(f"no output: {text!r}")


def output_setting(text: str) -> tuple[str, str, str]:
    """(format, key, value) of ``format:key[=value]``; the value is "1" if none is given."""
    name, _, rest = text.partition(":")
    key, equals, value = rest.partition("=")
    if name not in FORMATS or key not in FORMATS[name]:
        raise ParseError(f"no output setting: {text!r}")
    return name, key, value if equals else "1"


def roots(arguments: list[str], default: str = ".") -> list[tuple[str, int, bool]]:
    """(path, ordinal, tagged); ``//`` switches between untagged and tagged."""
    out, tagged = [], False
    for argument in arguments:
        if argument == "//":
            tagged = not tagged
        else:
            out.append((argument, len(out), tagged))
    return out or [(default, 0, False)]
