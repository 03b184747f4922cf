"""Token sequences packed best fit first, in decreasing order of length.

Each task tokenises its documents, splits those longer than a sequence into whole sequences and a tail, and
packs the tails of a bounded group of tokens: longest first, each into the open sequence with the least room that still
holds it.  A segment tree over the possible rooms finds that one in ``log2(width)`` steps.  No row is shuffled: groups
lie within input partitions, so a hot key cannot meet in one task, and a lost task packs the same documents again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordEncoder
from .wordarrays import row_groups, utf8


class RoomTree:
    """How many open sequences have each room; finds the least room of at least a given size."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, size: int) -> int | None:
        at, count = size + self.leaves, self.count
        if count[at]:
            return size
        while at > 1:  # climb until a right neighbour has open sequences, then go down to its leftmost
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Indices of the sizes in each sequence, in order of placement.  Ties keep input order."""
    tree, open_at, bins = RoomTree(width), {}, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.least(sizes[i])
        if room is None:
            room = width
            bins.append([])
            which = len(bins) - 1
        else:
            which = open_at[room].pop()
            tree.add(room, -1)
        bins[which].append(i)
        if room > sizes[i]:
            open_at.setdefault(room - sizes[i], []).append(which)
            tree.add(room - sizes[i], 1)
    return bins


SCHEMA = "sequence_id long, n_tokens int, n_segments int, input_ids binary, ids_crc32 long, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"
_FIELDS = pa.schema(
    [("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("input_ids", pa.binary()), ("ids_crc32", pa.int64())]
    + [("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]
)


def pack_sequences(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, end_id: int = 1, pad_id: int = 0, group_tokens: int = 8 << 20, batch_bytes: int = 1 << 20
) -> DataFrame:
    """One row per sequence of a packed id matrix.

    ``input_ids`` is the matrix row: ``width`` little-endian unsigned 16-bit ids (32-bit if the vocabulary needs them), padded
    with ``pad_id`` behind ``n_tokens``.  ``cu_seqlens`` are the cumulative segment lengths from 0 to ``n_tokens``; position ids
    restart at ``position_resets``; ``doc_ids`` and ``starts`` tell which ids of which document each segment holds, so that
    the cut is lossless.  ``ids_crc32`` covers the unpadded ids as unsigned 32-bit.

    A null or empty text has the end id alone.  Rows with the same id are documents of their own.  Other columns play no part.  An empty table has no rows.  Each partition of the input is packed on its own, so which documents
    share a sequence hangs on the input's partitions; that each id lies in one place does not.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer_path)
        kind = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        made = TaskContext.get().partitionId() << 36

        def matrix(segments: list[list[tuple[np.ndarray, int | None, int]]]) -> pa.RecordBatch:
            nonlocal made
            out = []
            for parts in segments:
                ids = np.concatenate([p[0] for p in parts])
                row = np.full(width, pad_id, kind)
                row[: len(ids)] = ids
                ends = np.cumsum([0, *(len(p[0]) for p in parts)]).tolist()
                out.append((made, len(ids), len(parts), row.tobytes(), zlib.crc32(ids.astype("<u4").tobytes()), ends, ends[:-1], [p[1] for p in parts], [p[2] for p in parts]))
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FIELDS.types)], schema=_FIELDS)

        tails: list[tuple[np.ndarray, int | None, int]] = []
        held = 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for lo, hi in row_groups(offsets, batch_bytes):
                ids, bounds = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end_id)
                ids, full = ids.astype(kind), []
                for doc, a, b in zip(doc_ids[lo:hi], bounds[:-1].tolist(), bounds[1:].tolist()):
                    whole = a + (b - a) // width * width
                    full += [[(ids[s : s + width], doc, s - a)] for s in range(a, whole, width)]
                    if whole < b:
                        tails.append((ids[whole:b], doc, whole - a))
                        held += b - whole
                if full:
                    yield matrix(full)
            if held >= group_tokens:
                yield matrix([[tails[i] for i in own] for own in best_fit_decreasing([len(t[0]) for t in tails], width)])
                tails, held = [], 0
        if tails:
            yield matrix([[tails[i] for i in own] for own in best_fit_decreasing([len(t[0]) for t in tails], width)])

    return docs.mapInArrow(rows, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the sequences as Parquet, one matrix row each."""
    packed.write.mode("errorifexists").parquet(path)
