"""Removal of repeated lines by two Bloom filters.

1. *Filters.*  Each task hashes the lines of its documents to two bits of a filter, and tells which bits one of its documents has set and which
   more than one.  Merged over all tasks, the first filter has what was seen once, the second what was seen twice: a bit goes to the second
   if it comes again.  The filters are cut into slices that merge in tasks of their own, a row after the other.
2. *Suspects.*  A line all of whose bits are in the second filter may stand in two documents; no other line can.  Only suspects are
   shuffled, as 128-bit digests with their document's id, to be counted exactly and to find the document that keeps the line.
3. *Removal.*  Documents without a suspect never leave their task; the others meet the list of what they lose.

The second filter is broadcast: ``bits`` bits, whatever the input.  Two bits a line in 2^28 let about 1 % of single lines pass at 15 million
lines and a third at 120 million; what passes costs a shuffled digest, never a wrong result, and beyond that size ``bits`` should grow with the memory there is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

_BLANK = b" \t\n\x0b\x0c\r"
_FLUSH = 1 << 20  # bit positions that a task holds
_SALTS = 32


def line_key(line: bytes, least: int = 20) -> bytes | None:
    """The digest of a line's key, if that has at least ``least`` code points."""
    key = line.strip(_BLANK).lower()  # of bytes, so A to Z only
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def positions(digests: list[bytes], bits: int) -> np.ndarray:
    """Two bit numbers a digest, as rows; they may be the same."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2) & np.uint64(bits - 1)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _spread(least: int, bits: int, slice_bits: int):
    """Rows of ``slice, once, twice``: 32-bit places in the slice that one or more than one of the task's documents has set."""

    def told(found: list[np.ndarray]) -> pa.RecordBatch:
        bit, n = np.unique(np.concatenate(found), return_counts=True)
        part = bit // np.uint64(slice_bits)
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        place = (bit % np.uint64(slice_bits)).astype("<u4")
        rows = [(int(part[a]), place[a:b][n[a:b] == 1].tobytes(), place[a:b][n[a:b] > 1].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(bit)])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["slice", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for text in _texts(batch.column(0)):
                keys = {k for line in text.split(b"\n") if (k := line_key(line, least))}
                if keys:
                    own = np.unique(positions(list(keys), bits))
                    found.append(own)
                    size += len(own)
                if size >= _FLUSH:
                    yield told(found)
                    found, size = [], 0
        if found:
            yield told(found)

    return run


def _merged(slice_bits: int):
    """``slice, twice`` (compressed bits) from rows that come slice by slice."""

    def told(which: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([which], pa.int64()), pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)])], names=["slice", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, once, twice = None, None, None
        for batch in batches:
            for which, single, more in zip(*(c.to_pylist() for c in batch.columns)):
                if which != last:
                    if last is not None:
                        yield told(last, twice)
                    last, once, twice = which, np.zeros(slice_bits, bool), np.zeros(slice_bits, bool)
                single, more = np.frombuffer(single, "<u4"), np.frombuffer(more, "<u4")
                twice[single[once[single]]] = True
                twice[more] = True
                once[single] = True
                once[more] = True
        if last is not None:
            yield told(last, twice)

    return run


def seen_twice(texts: DataFrame, least: int = 20, bits: int = 1 << 28) -> np.ndarray:
    """The second filter of the lines of a column of texts, ``bits`` bits."""
    slice_bits = min(bits, 1 << 20)
    slices = texts.mapInArrow(_spread(least, bits, slice_bits), "slice long, once binary, twice binary")
    merged = slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merged(slice_bits), "slice long, twice binary")
    twice = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        twice[row.slice * slice_bits // 8 : (row.slice + 1) * slice_bits // 8] = np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint8)
    return twice


def suspects(digests: list[bytes], twice: np.ndarray) -> list[bytes]:
    """Those that the filter knows."""
    if not digests:
        return []
    at = positions(digests, len(twice) * 8)
    known = ((twice[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
    return [digests[i] for i in np.flatnonzero(known)]


def _text_digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = 20, least_docs: int = 3, bits: int = 1 << 28, with_text: bool = True
) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, kept_sha256, kept``.

    A line's key is the line without blanks (space, tab to carriage return) at its ends, with A-Z in lower case.  Keys of at least ``least_points`` code points in
    ``least_docs`` documents (two or more) lose their lines in all but the largest id that has them; the other lines stay, joined by newlines.
    ``kept`` is null without ``with_text``.

    A null or empty text is one empty line.  Rows with the same id are one document when documents are counted, and each keeps or loses lines on its own; a null id is a document
    with the smallest id.  Texts of any length are read whole.  An empty table has no rows.  Other columns play no part, whatever their names.
    """
    if least_docs < 2:
        raise ValueError("a repeated line stands in two documents at least")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    twice = spark.sparkContext.broadcast(seen_twice(texts.select("__text"), least_points, bits))

    def suspected(text: bytes) -> list[bytes]:
        return suspects(list({k for line in text.split(b"\n") if (k := line_key(line, least_points))}), twice.value)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(doc, _text_digest(text), k) for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))) for k in suspected(text)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["doc_id", "__row", "__key"])

    found = scratch.table(texts.mapInArrow(pairs, "doc_id long, __row binary, __key binary"), "suspects")
    holders = found.groupBy("__key", "doc_id").agg(F.count("*").alias("__n"))  # first by document, so no key is hot
    repeated = holders.groupBy("__key").agg(F.count("*").alias("__docs"), F.max("doc_id").alias("__keeper")).filter(F.col("__docs") >= least_docs)
    salt = F.pmod(F.xxhash64("__row"), F.lit(_SALTS)).cast("int")  # a line of a third of all documents is joined by many tasks
    repeated = repeated.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    lost = found.withColumn("__salt", salt).join(repeated, ["__key", "__salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("__keeper")))
    lost = lost.groupBy("doc_id", "__row").agg(F.collect_set("__key").alias("__lost"))  # at most the lines of one text
    lost = scratch.table(lost, "lost")

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = _texts(batch.column(1))
            some = [bool(suspected(t)) for t in read]
            columns = [batch.column(0), [_text_digest(t) if s else None for t, s in zip(read, some)], [t if s or with_text else None for t, s in zip(read, some)], [t.count(b"\n") + 1 for t in read], [None if s else hashlib.sha256(t).hexdigest() for t, s in zip(read, some)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string()))], names=["doc_id", "__row", "__text", "n_lines", "__sha256"])

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, n, sha, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__text", "n_lines", "__sha256", "__lost"))):
                kept = text
                if gone:
                    gone = set(gone)
                    lines = [line for line in text.split(b"\n") if line_key(line, least_points) not in gone]
                    kept, dropped_lines = b"\n".join(lines), n - len(lines)
                else:
                    dropped_lines = 0
                sha = sha or hashlib.sha256(kept).hexdigest()
                out.append((doc, n, dropped_lines, sha, kept.decode("utf-8", "replace") if with_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    left = texts.mapInArrow(bare, "doc_id long, __row binary, __text binary, n_lines long, __sha256 string")
    left = left.withColumnRenamed("doc_id", "__id").withColumnRenamed("__row", "__of")
    joined = left.join(lost, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__of") == F.col("__row")), "left").select(F.col("__id").alias("doc_id"), "__text", "n_lines", "__sha256", "__lost")
    return joined.mapInArrow(dropped, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nr FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) >= 3),
j AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
