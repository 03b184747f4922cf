"""Removal of repeated passages by fixed-block anchors.

Every document is cut into aligned, non-overlapping reference blocks of
``(width + 1) // 2`` words.  A passage of ``width`` words holds at least one whole
block of each document in which it occurs, so two documents that share such a
passage share the hash of a reference block of the one with a rolling window of
the other.  Three steps follow from that, each of which deals its rows by hash:

1. *Anchors.*  Every chunk of documents sends its block hashes and its rolling
   window hashes to the partition of the hash, as sorted, difference-coded
   arrays.  Hashes that are a reference block somewhere and occur in two documents
   go back to the chunks in which they occur.
2. *Extension.*  Around every anchor each chunk takes the windows of ``width`` words
   that contain it and sends their 96-bit hashes with the smallest document id;
   the chunks learn which of their windows start in a smaller document.
3. *Cover.*  Neighbouring repeated windows merge to maximal exact repeats, whose words
   are removed.

No step forms pairs of documents, so a passage that a million documents share costs
a million entries.  A chunk is a bounded number of bytes of text.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordarrays import members, pack_sorted, unpack_sorted, utf8, window_hashes, window_starts, words

_NONE = np.iinfo(np.int64).max  # stands for a null document id: larger than all others
_TWO = np.uint64(2)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(_NONE).to_numpy().astype(np.int64)


def _deal(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes for the parts that get any: part = high 32 bits * parts / 2**32."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    at = _runs(part)
    return list(zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)]))


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def _anchor_rows(block: int, parts: int):
    def rows(docs: pa.Table) -> pa.Table:
        w = words(*utf8(docs["__text"]))
        starts = window_starts(w.first, block)
        key = window_hashes(w.hashes(), block)[starts] >> _TWO if len(starts) else np.zeros(0, np.uint64)
        row = w.row[starts] if len(starts) else np.zeros(0, np.int64)
        aligned = (starts - w.first[row]) % block == 0
        order = np.argsort(key, kind="stable")
        key, row, aligned = key[order], row[order], aligned[order]
        out = {"part": [], "chunk": [], "keys": []}
        if len(key):
            at = _runs(key)
            shared = np.maximum.reduceat(row, at) != np.minimum.reduceat(row, at)
            flags = np.logical_or.reduceat(aligned, at) * np.uint64(1) + shared * _TWO
            coded = (key[at] << _TWO) | flags
            chunk = docs["chunk"][0].as_py()
            for p, lo, hi in _deal(coded, parts):
                out["part"].append(p), out["chunk"].append(chunk), out["keys"].append(pack_sorted(coded[lo:hi]))
        return pa.table(out, schema=pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary())]))

    return rows


def _anchor_match(blobs: pa.Table) -> pa.Table:
    coded = [unpack_sorted(b) for b in blobs["keys"].to_pylist()]
    owner = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
    coded = np.concatenate(coded)
    order = np.argsort(coded, kind="stable")
    coded, owner = coded[order], owner[order]
    key = coded >> _TWO
    at = _runs(key)
    size = np.diff(np.append(at, len(key)))
    hot = ((size > 1) | (np.bitwise_or.reduceat(coded, at) & _TWO != 0)) & (np.bitwise_or.reduceat(coded, at) & np.uint64(1) != 0)
    keep = np.repeat(hot, size)
    key, owner = key[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    key, owner, chunks = key[order], owner[order], blobs["chunk"].to_numpy()
    at = _runs(owner) if len(owner) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(owner))
    return pa.table({"chunk": [int(chunks[owner[a]]) for a in at], "anchors": [pack_sorted(key[a:b]) for a, b in zip(at, ends)]}, schema=pa.schema([("chunk", pa.int64()), ("anchors", pa.binary())]))


def _window_keys(w, starts: np.ndarray, width: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return window_hashes(hashes, width)[starts], (window_hashes(hashes, width, 1)[starts] >> np.uint64(32)).astype(np.uint32)


def _extension_rows(block: int, width: int, parts: int):
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("least", pa.binary())])

    def rows(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = {k: [] for k in schema.names}
        w = words(*utf8(docs["__text"])) if docs.num_rows and replies.num_rows else None
        if w is None or not len(w):
            return pa.table(out, schema=schema)
        pool = np.sort(np.concatenate([unpack_sorted(x) for x in replies["anchors"].to_pylist()]))
        hashes = w.hashes()
        spots = window_starts(w.first, block)
        spots = spots[members(window_hashes(hashes, block)[spots] >> _TWO, pool)]
        # an anchor at s lies in the windows that start at s - (width - block) ... s
        mark = np.zeros(len(w) + 1, np.int32)
        np.add.at(mark, np.maximum(spots - (width - block), 0), 1)
        np.add.at(mark, spots + 1, -1)
        starts = window_starts(w.first, width)
        starts = starts[np.cumsum(mark)[starts] > 0]
        if not len(starts):
            return pa.table(out, schema=schema)
        a, b = _window_keys(w, starts, width, hashes)
        ids = _ids(docs["doc_id"])[w.row[starts]]
        order = np.lexsort((b, a))
        a, b, ids = a[order], b[order], ids[order]
        at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        a, b, least = a[at], b[at], np.minimum.reduceat(ids, at)
        chunk = docs["chunk"][0].as_py()
        for p, lo, hi in _deal(a, parts):
            for k, v in zip(schema.names, (p, chunk, pack_sorted(a[lo:hi]), b[lo:hi].tobytes(), least[lo:hi].tobytes())):
                out[k].append(v)
        return pa.table(out, schema=schema)

    return rows


def _extension_match(blobs: pa.Table) -> pa.Table:
    """For each chunk the windows that also start in a document that is smaller than all of the chunk's that have them."""
    a = [unpack_sorted(x) for x in blobs["a"].to_pylist()]
    owner = np.repeat(np.arange(len(a)), [len(x) for x in a])
    a = np.concatenate(a)
    b = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs["b"].to_pylist()])
    least = np.concatenate([np.frombuffer(x, np.int64) for x in blobs["least"].to_pylist()])
    order = np.lexsort((b, a))
    a, b, owner, least = a[order], b[order], owner[order], least[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    lowest = np.repeat(np.minimum.reduceat(least, at), np.diff(np.append(at, len(a))))
    late = least > lowest
    a, b, owner, chunks = a[late], b[late], owner[late], blobs["chunk"].to_numpy()
    order = np.argsort(owner, kind="stable")
    a, b, owner = a[order], b[order], owner[order]
    at = _runs(owner) if len(owner) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(owner))
    return pa.table(
        {"chunk": [int(chunks[owner[i]]) for i in at], "a": [pack_sorted(a[i:j]) for i, j in zip(at, ends)], "b": [b[i:j].tobytes() for i, j in zip(at, ends)]},
        schema=pa.schema([("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]),
    )


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()), ("repeats", pa.list_(pa.list_(pa.int64())))])


def _cover_rows(width: int, with_text: bool):
    def rows(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = {k: [] for k in _RESULT.names}
        if not docs.num_rows:
            return pa.table(out, schema=_RESULT)
        w = words(*utf8(docs["__text"]))
        ids, given = _ids(docs["doc_id"]), docs["doc_id"].to_pylist()
        gone = np.zeros(len(w) + 1, np.int32)
        starts = window_starts(w.first, width)
        if len(starts):
            a, b = _window_keys(w, starts, width, w.hashes())
            row = w.row[starts]
            order = np.lexsort((b, a))
            sa, sb, sid = a[order], b[order], ids[row[order]]
            at = np.flatnonzero(np.concatenate(([True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1]))))
            size = np.diff(np.append(at, len(sa)))
            late = sid > np.repeat(np.minimum.reduceat(sid, at), size)  # a smaller document of this chunk
            if replies.num_rows:
                ra = np.concatenate([unpack_sorted(x) for x in replies["a"].to_pylist()])
                rb = np.concatenate([np.frombuffer(x, np.uint32) for x in replies["b"].to_pylist()])
                # both halves of the hash have to agree: join on the first, then compare pairs
                ua, ub = sa[at], sb[at]
                pool = np.lexsort((rb, ra))
                ra, rb = ra[pool], rb[pool]
                lo, hi = np.searchsorted(ra, ua), np.searchsorted(ra, ua, side="right")
                hit = np.zeros(len(ua), dtype=bool)
                for step in range(int((hi - lo).max(initial=0))):
                    there = lo + step < hi
                    hit[there] |= rb[lo[there] + step] == ub[there]
                late |= np.repeat(hit, size)
            begin = starts[order[late]]
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + width, -1)
        kept = np.cumsum(gone[:-1]) == 0
        left = np.add.reduceat(np.append(kept, False).astype(np.int64), np.minimum(w.first[:-1], len(kept))) if len(w) else np.zeros(docs.num_rows, np.int64)
        raw = w.data.tobytes()
        for d in range(docs.num_rows):
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            n_kept = int(left[d]) if hi > lo else 0
            rest = b" ".join([raw[s:e] for s, e in zip(w.start[lo:hi][kept[lo:hi]].tolist(), w.end[lo:hi][kept[lo:hi]].tolist())])
            edge = np.flatnonzero(np.diff(np.concatenate(([1], kept[lo:hi], [1])))).reshape(-1, 2).tolist() if n_kept < hi - lo else []
            for k, v in zip(_RESULT.names, (given[d], hi - lo, hi - lo - n_kept, rest.decode() if with_text else None, hashlib.sha256(rest).hexdigest(), edge)):
                out[k].append(v)
        return pa.table(out, schema=_RESULT)

    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, chunk_bytes: int = 6 << 20, with_text: bool = True) -> DataFrame:
    """Remove from each document the words of every ``width``-word passage that also starts in a document with a smaller id.

    Returns one row per input row: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space, null
    unless ``with_text``), ``kept_sha256`` and ``repeats``, the maximal repeated word ranges ``[from, to)``.

    Null, empty and short texts keep all words; a text of any length is read whole.  Rows with the same id do not remove each other's words, whether their texts are equal or
    not.  A null id is larger than every other but 2**63 - 1, with which it counts as one.  An empty table has no rows.  Other columns of the input play no part, whatever their names.
    """
    block = (width + 1) // 2
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    total = docs.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    parts = max(1, chunks // 2)
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "__text"), F.lit(chunks)))  # rows that share an id spread, too
    by_chunk = docs.groupBy("chunk")
    anchors = by_chunk.applyInArrow(_anchor_rows(block, parts), "part int, chunk long, keys binary").groupBy("part").applyInArrow(_anchor_match, "chunk long, anchors binary")
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(_extension_rows(block, width, parts), "part int, chunk long, a binary, b binary, least binary")
    late = windows.groupBy("part").applyInArrow(_extension_match, "chunk long, a binary, b binary")
    return by_chunk.cogroup(late.groupBy("chunk")).applyInArrow(
        _cover_rows(width, with_text), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, repeats array<array<bigint>>"
    )
