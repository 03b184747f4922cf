"""Scripts for people to read and run: a shell script of planned actions, and a consumer of a JSON result.

Nothing here touches a file of the data; the scripts do nothing either until they are told to with ``-x``.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import document

_HEAD = r"""#!/bin/sh
# Planned actions, one a line.  Without -x they are only shown.
usage() {
    echo "usage: $0 [-x] [-n] [-i] [-c] [-k] [-q]"
    echo "  -x  do it          -n  only show it, whatever else is given"
    echo "  -i  ask before each removal; yes begins with y"
    echo "  -c  remove folders, too, that a removal leaves empty"
    echo "  -k  folders keep their times when something in them goes"
    echo "  -q  show nothing but failures"
}
run= only_show= ask= clean= times= quiet=
while getopts xnickqh option; do
    case "$option" in
        x) run=1 ;;
        n) only_show=1 ;;
        i) ask=1 ;;
        c) clean=1 ;;
        k) times=1 ;;
        q) quiet=1 ;;
        h) usage; exit 0 ;;
        *) usage >&2; exit 2 ;;
    esac
done
shift $((OPTIND - 1))
[ $# -eq 0 ] || { usage >&2; exit 2; }
[ -z "$only_show" ] || run=
if [ -n "$run" ] && [ -n "$times" ]; then
    stamp=$(mktemp) || exit 2
    trap 'rm -f -- "$stamp"' EXIT
fi
failed=0
show() { [ -n "$quiet" ] || printf '%s\n' "$*"; }
act() {
    show "$@"
    [ -z "$run" ] || "$@" || failed=$((failed + 1))
}
above() {
    folder=.
    case "$1" in */*) folder=${1%/*}; [ -n "$folder" ] || folder=/ ;; esac
}
# Runs a command that changes what a folder lists; with -k the folder has its time back after that.
inside() {
    place=$1
    shift
    [ -z "$times" ] || touch -r "$place" -- "$stamp"
    "$@"
    code=$?
    [ -z "$times" ] || touch -r "$stamp" -- "$place"
    return $code
}
# A removal: the path, then the command.
take() {
    if [ -n "$run" ] && [ -n "$ask" ]; then
        printf 'remove %s? ' "$1" >&2
        answer=
        read -r answer
        case "$answer" in [yY]*) ;; *) return ;; esac
    fi
    above "$1"
    shift
    show "$@"
    [ -n "$run" ] || return
    if ! inside "$folder" "$@"; then
        failed=$((failed + 1))
        return
    fi
    while [ -n "$clean" ] && [ "$folder" != / ] && [ "$folder" != . ]; do
        empty=$folder
        above "$empty"
        inside "$folder" rmdir -- "$empty" 2>/dev/null || break
    done
}
# What a directory holds, whatever the names: digests of its files and targets of its links.
contents() {
    find "$1" -type f -size +0c -exec sh -c 'for f; do sha256sum <"$f" || echo "$f"; done' sh {} + | sort
    find "$1" -type l -exec sh -c 'for f; do readlink -n -- "$f" | sha256sum; done' sh {} + | sort
    find "$1" ! -type f ! -type l ! -type d
}
equal() {
    if [ -d "$1" ] && [ ! -L "$1" ]; then
        [ -d "$2" ] || return 1
        case "$2/" in "$1"/*) return 1 ;; esac
        case "$1/" in "$2"/*) return 1 ;; esac
        [ "$(contents "$1")" = "$(contents "$2")" ]
    else
        cmp -s -- "$1" "$2"
    fi
}
# A duplicate goes only while its original is there and still has the same content.
still_same() {
    [ -e "$2" ] && [ ! "$1" -ef "$2" ] && equal "$1" "$2" && return
    [ -z "$run" ] && return
    printf 'kept, as its original has changed: %s\n' "$1" >&2
    failed=$((failed + 1))
    return 1
}
keep() { :; }
skip() { :; }
remove() {
    if [ -z "$2" ]; then
        take "$1" rm -f -- "$1"
    elif still_same "$1" "$2"; then
        if [ -d "$1" ] && [ ! -L "$1" ]; then take "$1" rm -rf -- "$1"; else take "$1" rm -f -- "$1"; fi
    fi
}
remove_dir() { take "$1" rmdir -- "$1"; }
replaced() { act mv -f -- "$2.tidy" "$2"; }
clone() { if still_same "$1" "$2"; then act cp --reflink=always -p -- "$2" "$1.tidy" && replaced "$2" "$1"; fi; }
reflink() { clone "$@"; }
hardlink() { if still_same "$1" "$2"; then act ln -f -- "$2" "$1"; fi; }
symlink() { if still_same "$1" "$2"; then act ln -sf -- "$2" "$1"; fi; }
strip_symbols() { act strip -s -- "$1"; }
set_user() { act chown "$(id -un)" -- "$1"; }
set_group() { act chgrp "$(id -gn)" -- "$1"; }
set_user_and_group() { act chown "$(id -un):$(id -gn)" -- "$1"; }
"""
_TAIL = """[ "$failed" -eq 0 ]
"""
_CONSUMER = '''#!/usr/bin/env python3
"""Reads a result and shows what would go; with -x duplicates are removed while their original is there and equal."""

import filecmp
import json
import os
import sys

RESULT = {result!r}


def removable(rows):
    original = None
    for row in rows:
        if row.get("is_original"):
            original = row
        elif row.get("type") == "duplicate_file" and original and row.get("checksum") == original.get("checksum"):
            yield row["path"], original["path"]


def main():
    with open(RESULT) as f:
        rows = [row for row in json.load(f) if "path" in row]
    run, failed = "-x" in sys.argv[1:], 0
    for path, original in removable(rows):
        print(path, "=", original)
        if run:
            if os.path.isfile(original) and not os.path.samefile(path, original) and filecmp.cmp(path, original, shallow=False):
                os.remove(path)
            else:
                failed += 1
                print("kept, as its original has changed:", path, file=sys.stderr)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
'''


def script_lines(planned: DataFrame, command: str | None = None) -> DataFrame:
    """One call a row: action, path and original in quotes; ``cmd`` calls the given command instead."""
    path, original = C.shell_quote(F.col("path")), C.shell_quote(F.coalesce("original_path", F.lit("")))
    action = F.when(F.col("action") == "strip", "strip_symbols").otherwise(F.col("action"))
    call = F.concat_ws(" ", action, path, original)
    return planned.select(F.when(F.col("action") == "cmd", F.concat_ws(" ", F.lit(f"act {command or ':'}"), path, original)).otherwise(call).alias("value"))


def _executable(path: str) -> None:
    os.chmod(path, os.stat(path).st_mode | stat.S_IXUSR)


def write_script(planned: DataFrame, path: str, command: str | None = None) -> None:
    """A shell script of all planned actions, written in segments by the tasks."""
    document.write(script_lines(planned, command).select(F.concat("value", F.lit("\n")).alias("value")), path, _HEAD, "", _TAIL)
    _executable(path)


def write_consumer(path: str, result: str) -> None:
    """A Python script that reads a JSON result in which each group begins with its original."""
    with open(path, "w") as out:
        out.write(_CONSUMER.replace("{result!r}", repr(os.path.abspath(result))))
    _executable(path)
