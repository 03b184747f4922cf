"""Packing by cutting-stock column generation.

Documents are tokenised once and cut at multiples of the sequence length, which leaves one tail each.  Only the
histogram of tail lengths reaches the driver, in at most ``bins`` bins, each as long as its longest.  There a linear program
chooses how often to use each pattern (a multiset of bins that fits one sequence), by the revised simplex method from one pattern a bin.  An
unbounded knapsack, solved by dynamic programming, prices new patterns: the best one with each bin; those that improve the program enter it.
The prices also give a lower bound of the program, and it ends once no pattern improves it or the bound proves it within ``gap``.
Patterns are rounded down and what is left over is packed best fit first.  Tails are ranked within their bin on the cluster, and the
rank tells pattern, copy and place; offsets are sums of true lengths.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .tokens import WordEncoder
from .wordarrays import row_groups, utf8

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces(docs: DataFrame, tokenizer_path: str, width: int, end_id: int, batch_bytes: int = 1 << 20, control_ids: bool = False) -> DataFrame:
    """Cut each document's ids, with ``end_id`` behind them, at multiples of ``width``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer_path, control_ids)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for lo, hi in row_groups(offsets, batch_bytes):
                ids, bounds = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end_id)
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                out = [
                    (doc, s - a, min(s + width, b) - s, zlib.crc32(raw[4 * s : 4 * min(s + width, b)]), b - a)
                    for doc, a, b in zip(doc_ids[lo:hi], bounds[:-1].tolist(), bounds[1:].tolist())
                    for s in range(a, b, width)
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECES.types)], schema=_PIECES)

    return docs.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Knapsack:
    """The most valuable multisets of sizes for every capacity up to ``width``."""

    def __init__(self, value: np.ndarray, sizes: np.ndarray, width: int):
        worth, self.best, self._pick = np.zeros(width + 1), np.zeros(width + 1), np.full(width + 1, -1)
        self._index, self._m = np.full(width + 1, -1), len(sizes)
        worth[sizes], self._index[sizes] = value, np.arange(len(sizes))
        smallest = int(sizes[0])
        for c in range(1, width + 1):
            self.best[c] = self.best[c - 1]
            if c >= smallest:
                gain = self.best[: c - smallest + 1][::-1] + worth[smallest : c + 1]
                k = int(gain.argmax())
                if gain[k] > self.best[c] + 1e-12:
                    self.best[c], self._pick[c] = gain[k], smallest + k

    def amounts(self, capacity: int) -> np.ndarray:
        """How often the best multiset for the capacity has each size."""
        out, c = np.zeros(self._m), capacity
        while c > 0:
            if self._pick[c] < 0:
                c -= 1
            else:
                out[self._index[self._pick[c]]] += 1
                c -= int(self._pick[c])
        return out


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination, without the threads of a linear algebra library: those have been seen to wait for ever in a driver's process."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        if pivot != k:
            work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k]
    return work[:, n:]


@dataclass
class Solution:
    patterns: list[tuple[np.ndarray, float]]  # how often each size is in it, and how often it is used
    value: float  # of the linear program
    bound: float  # proven: no fractional packing needs fewer sequences
    entered: int  # patterns that pricing has brought in


def solve(sizes: np.ndarray, demand: np.ndarray, width: int, gap: float = 1e-3, columns: int = 20, refresh: int = 200) -> Solution:
    """Fewest sequences, in fractions, whose patterns hold each size as often as demanded, or more often.

    Up to ``columns`` patterns are taken from one knapsack; the inverse of the basis is worked out afresh after every ``refresh`` of them.
    """
    m = len(sizes)
    times = lambda a, b: np.einsum("ij,j->i", a, b)
    fits = np.floor(width / sizes)
    basis, inverse, use, cost = np.diag(fits), np.diag(1 / fits), demand / fits, np.ones(m)
    bound, entered = float(sizes @ demand) / width, 0
    while True:
        dual = times(inverse.T, cost)
        worst = int(dual.argmin())
        if dual[worst] < -1e-9:  # more of that size than demanded would save sequences
            new = [(-np.eye(m)[worst], 0.0)]
        else:
            price = np.maximum(dual, 0)
            sack = Knapsack(price, sizes, width)
            bound = max(bound, float(price @ demand) / max(float(sack.best[width]), 1.0))
            if sack.best[width] <= 1 + 1e-9 or cost @ use <= (1 + gap) * bound:
                break
            value = price + sack.best[width - sizes]
            new = []
            for i in np.argsort(-value, kind="stable")[:columns]:
                if value[i] > 1 + 1e-9:
                    new.append((sack.amounts(width - int(sizes[i])) + np.eye(m)[i], 1.0))
        before = entered
        for column, price in new:
            if float(times(inverse.T, cost) @ column) <= price + 1e-9:
                continue  # one that has entered before makes it useless
            step = times(inverse, column)
            ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
            leave = int(ratio.argmin())
            if not np.isfinite(ratio[leave]):
                continue
            amount = ratio[leave]
            use = np.maximum(use - amount * step, 0)
            use[leave], cost[leave], basis[:, leave] = amount, price, column
            row = inverse[leave] / step[leave]
            inverse -= np.outer(step, row)
            inverse[leave] = row
            entered += 1
            if entered % refresh == 0:
                inverse = _inverse(basis)
                use = np.maximum(times(inverse, demand), 0)
        if entered == before:  # nothing improves it within rounding
            break
    return Solution([(basis[:, k].astype(np.int64), float(use[k])) for k in range(m) if use[k] > 1e-9 and cost[k]], float(cost @ use), bound, entered)


def plan(histogram: dict[int, int], width: int, **how) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(pattern, copies); a pattern is ((size, times), ...).  Copies times times adds up to the histogram exactly."""
    found: list[tuple[tuple[tuple[int, int], ...], int]] = []
    left = Counter({int(s): int(n) for s, n in histogram.items() if n})
    if n := left.pop(width, 0):
        found.append((((width, 1),), n))
    if left:
        sizes = np.array(sorted(left))
        demand = np.array([left[s] for s in sizes.tolist()])
        for column, use in sorted(solve(sizes, demand.astype(float), width, **how).patterns, key=lambda x: (-(x[0] @ sizes), -x[1])):
            used = np.flatnonzero(column)
            times = min(int(use + 1e-9), *(left[int(sizes[i])] // int(column[i]) for i in used))
            if times > 0:
                found.append((tuple((int(sizes[i]), int(column[i])) for i in used), times))
                for i in used:
                    left[int(sizes[i])] -= times * int(column[i])
        rooms: list[list[list[int]]] = [[] for _ in range(width + 1)]
        open_rooms = np.zeros(width + 1, dtype=bool)
        for s in sorted((s for s in left if left[s]), reverse=True):
            for _ in range(left[s]):
                fit = np.flatnonzero(open_rooms[s:])
                room = int(fit[0]) + s if len(fit) else width
                content = rooms[room].pop() if len(fit) else []
                open_rooms[room] = bool(rooms[room]) if len(fit) else False
                rooms[room - s].append([*content, s])
                open_rooms[room - s] = room > s
        alike = Counter(tuple(sorted(Counter(x).items())) for room in rooms for x in room)
        found += sorted(alike.items())
    return found


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, end_id: int = 1, bins: int = 256, bucket_rows: int = 4096, control_ids: bool = False, **how) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    With ``control_ids`` a special token that a text spells out becomes its id, as the tokenizer called with its defaults has it; without, it is ordinary text, so that control ids never come from a text.

    A null or empty text has the end id alone; a text of any length is cut into pieces.  Rows with the same id are documents of their own.  Other columns of the input
    play no part, whatever their names.  An empty table has no rows.  Sequence ids run from 0 without gaps.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    grain = max(1, width // bins)
    cut = scratch.table(pieces(docs, tokenizer_path, width, end_id, control_ids=control_ids), "pieces")
    room = width // grain
    cut = cut.withColumn("__bin", F.least(F.ceil(F.col("length") / grain), F.lit(room)).cast("int"))  # the last bin fills a sequence
    histogram = {r["__bin"]: r["count"] for r in cut.groupBy("__bin").count().collect()}  # at most width / grain rows
    # The rank within a bin: buckets keep a bin that many documents share from meeting in one task; the row's place in its file parts repeated rows.
    buckets = F.array(*(F.lit(-(-histogram.get(b, 1) // bucket_rows)) for b in range(room + 1)))
    cut = cut.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_metadata.row_index"), buckets[F.col("__bin")]))
    before = Window.partitionBy("__bin").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = cut.groupBy("__bin", "__bucket").agg(F.count("*").alias("__n")).select("__bin", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__bin", "__bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("__rank", F.row_number().over(inside) - 1).join(start, ["__bin", "__bucket"])
    # For each bin: first rank, sequence, first place in the sequence, and times of each pattern that holds it.  Patterns are at most a few per bin.
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for pattern, copies in plan(histogram, room, **how):
        place = 0
        for size, times in pattern:
            places.setdefault(size, []).append((taken[size], sequence, place, times))
            taken[size] += copies * times
            place += times
        sequence += copies
    tables = {size: np.array(rows, dtype=np.int64).T for size, rows in places.items()}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("__bin").to_numpy(), batch.column("__at").to_numpy()
            ids, spots = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for one in np.unique(size):
                mine = np.flatnonzero(size == one)
                first, seq, spot, times = tables[int(one)]
                k = np.searchsorted(first, rank[mine], side="right") - 1
                inner = rank[mine] - first[k]
                ids[mine], spots[mine] = seq[k] + inner // times[k], spot[k] + inner % times[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PIECES.names), pa.array(ids), pa.array(spots)], names=[*_PIECES.names, "sequence_id", "place"])

    placed = ranked.select(*_PIECES.names, "__bin", (F.col("__rank") + F.col("__before")).cast("long").alias("__at"))
    placed = placed.mapInArrow(put, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # a sequence has ``width`` pieces at most
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).drop("place")
