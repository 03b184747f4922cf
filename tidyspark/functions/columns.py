"""Scalar column functions on paths, sizes and times.  All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the basename; null without a dot.  ``.x`` has extension ``x``."""
    name = basename(path)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1))


def stem(path: Column) -> Column:
    """The basename up to and with its last dot; the whole name without a dot."""
    name = basename(path)
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"[^.]*$", "")).otherwise(name)


def dirname(path: Column) -> Column:
    """The path without its last component; ``/`` for a path right below the root, null without a slash."""
    cut = F.length(path) - F.length(basename(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).when(cut == 0, F.lit("/"))


def path_depth(path: Column) -> Column:
    """Number of slashes, a trailing one not counted."""
    return _slashes(F.rtrim(path, F.lit("/")))


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def is_hidden(path: Column) -> Column:
    """Whether any component begins with a dot."""
    return F.startswith(path, F.lit(".")) | F.contains(path, F.lit("/."))


def ancestors(path: Column) -> Column:
    """All proper ancestor directories, outermost first; the file system's root is none."""
    n = _slashes(path)
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(steps, lambda i: F.call_function("substring_index", path, F.lit("/"), i)), lambda a: a != "")


def fold_case(text: Column) -> Column:
    """ASCII lower case; other letters stay."""
    return F.translate(text, _UPPER, _LOWER)


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def replace_text(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def shell_quote(text: Column) -> Column:
    """The text in single quotes, for a POSIX shell."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


def json_string(text: Column) -> Column:
    """The text as a JSON string literal."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def human_size(size: Column) -> Column:
    """``12 B``, ``1.50 KB`` to GB; a unit begins at 512 of the one below."""
    out = F.format_string("%d B", size)
    for step, unit in enumerate(("KB", "MB", "GB"), start=1):
        scale = 1024.0**step
        out = F.when(size >= scale / 2, F.format_string(f"%.2f {unit}", F.bround(size / scale, 2))).otherwise(out)
    return out


def human_size_steps(size: Column) -> Column:
    """One decimal, units of 1024 up to Z."""
    out = F.format_string("%.1f ZB", F.bround(size / 1024.0**7, 1))
    for step, unit in reversed(list(enumerate(("", "K", "M", "G", "T", "P", "E")))):
        out = F.when(F.abs(size) < 1024.0 ** (step + 1), F.format_string(f"%.1f {unit}B", F.bround(size / 1024.0**step, 1))).otherwise(out)
    return out


def elapsed(seconds: float) -> str:
    """``1d 2h 3m 4.5s`` without leading zero parts."""
    whole, out = int(seconds), []
    for name, unit in (("d", 86400), ("h", 3600), ("m", 60)):
        if whole >= unit:
            out.append(f"{whole // unit}{name}")
            whole %= unit
            seconds %= unit
    return " ".join([*out, f"{seconds:.3f}s"])


def from_iso(text: Column) -> Column:
    """ISO 8601 with an offset, as a timestamp; null if it is none."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXX"))


def to_iso(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ssXX")


def compare_close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """-1, 0 or 1; values within the tolerance are equal."""
    return F.when(F.abs(a - b) <= tolerance, 0).when(a < b, -1).otherwise(1)


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def record_id(*columns: Column) -> Column:
    """A stable 32-bit number; not unique."""
    return F.hash(*columns)


def progress_percent(done: Column, total: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.when(total > 0, F.floor(100 * done / total)).otherwise(100)))


def descending(text: Column) -> Column:
    """A key whose ascending order is the descending byte order of the text."""
    return F.concat(F.translate(F.hex(F.encode(text, "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


def moving_mean(value: Column, window, samples: int) -> Column:
    """Mean of the last samples, this one with them; the window gives partition and order."""
    return F.avg(value).over(window.rowsBetween(-(samples - 1), 0))
