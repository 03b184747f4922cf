"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance ``2 - 2t``.  A random rotation spreads that distance over all
dimensions; split into blocks, some block's part is within the block's share of it.  So each block is range-joined with
its own radius: vectors go to the grid cell of their first block coordinates (home) and to every further cell within the radius
(guest).  A cell's task parts its homes into small boxes by halving, compares each box with the vectors that lie within the radius of it,
and verifies the candidates exactly, in double precision.  A pair counts in the first block that brings it together, once for
each of its two vectors, so link counts need no pair to leave the task, nor to be kept in it: what leaves is which vectors the links connect.
Rotated coordinates are whole numbers, so that every task comes to the same block distances whatever the order of summation.

Equal vectors are one class from the start.  Homes of a large cell are split into tiles, and all its vectors into slices; each pair of a tile and a
slice is a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .graph import components, local_roots

_TINY = 1e-9


def unpack(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as doubles; each is stored in single precision if that loses nothing."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if pa.types.is_binary(column.type) else None
    if ends is not None and (np.diff(ends) == 4 * dim).all():
        return np.frombuffer(column.buffers()[2], "<f4", count=len(column) * dim, offset=int(ends[0])).reshape(-1, dim).astype(float)
    raw = column.to_pylist()
    return np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8").astype(float) for r in raw])


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, cid, dim, vec``: class (digest of the components) and components; null for vectors that take no part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vec = np.array([], float) if values is None or any(v is None for v in values) else np.array(values, float)
                largest = float(np.abs(vec).max()) if len(vec) and np.isfinite(vec).all() else 0.0
                if largest and not 1e-100 < largest < 1e100:  # its square may be no double; a power of two changes no angle
                    vec = np.ldexp(vec, -math.frexp(largest)[1])
                if largest:
                    raw = (vec + 0.0).astype("<f8").tobytes()  # + 0.0 makes -0.0 equal to 0.0
                    short = np.abs(vec).max() < 3e38 and (vec.astype("<f4") == vec).all()
                    out.append((vec_id, hashlib.blake2b(raw, digest_size=16).digest(), len(vec), vec.astype("<f4").tobytes() if short else raw))
                else:
                    out.append((vec_id, None, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int32(), pa.binary()))], names=["vec_id", "cid", "dim", "vec"])

    return df.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(rows, "vec_id long, cid binary, dim int, vec binary")


class Grid:
    """Blocks, radii and cells for vectors of one dimension.  Cells are at most ``blocks * (2 / step + 2) ** axes``, as unit vectors lie in [-1, 1]."""

    _kept: dict[tuple, Grid] = {}
    _UNIT = 1 << 20  # rotated coordinates are whole multiples of its inverse

    def __init__(self, dim: int, threshold: float, blocks: int, axes: int, seed: int = 7):
        blocks = max(1, min(blocks, dim))
        self._exact = 1 << min(20, (50 - dim.bit_length()) // 2)  # products and their sums stay below 2 ** 53
        self._rotation = np.round(np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))[0] * self._exact)
        self.edges = [round(dim * k / blocks) for k in range(blocks + 1)]
        away = (dim + math.sqrt(dim)) / self._exact + math.sqrt(dim) / self._UNIT  # what rounding may move a vector, at most
        apart = (math.sqrt(2 - 2 * threshold + _TINY) + 2 * away) ** 2
        self.budget = [apart * (b - a) / dim for a, b in zip(self.edges, self.edges[1:])]
        self.whole = [math.ceil(x * self._UNIT**2) for x in self.budget]  # budgets of whole numbers
        self.axes, self.threshold = axes, threshold

    @classmethod
    def of(cls, *args) -> Grid:
        if args not in cls._kept:
            cls._kept[args] = cls(*args)
        return cls._kept[args]

    def turn(self, raw: np.ndarray) -> np.ndarray:
        """Rotated unit vectors in whole multiples of 1 / ``_UNIT``: sums of whole numbers, the same in any order."""
        unit = raw / np.sqrt((raw * raw).sum(axis=1))[:, None]
        return np.round((np.round(unit * self._exact) @ self._rotation) * (self._UNIT / self._exact**2))

    def cells(self, turned: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block and shift: block, rows, their cell number, whether it is their home."""
        for k, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            radius = math.sqrt(self.budget[k]) + _TINY
            step = max(2.5 * radius, 1e-3)
            axes = min(self.axes, b - a)
            at = turned[:, a : a + axes] / self._UNIT
            home, low, high = (np.floor(x / step).astype(np.int64) for x in (at, at - radius, at + radius))
            rows, cell = np.arange(len(at)), np.zeros(len(at), np.int64)
            own = np.ones(len(at), dtype=bool)
            base = 2 * math.ceil(1 / step) + 4
            for x in range(axes):
                span = high[rows, x] - low[rows, x] + 1
                pick = np.repeat(np.arange(len(rows)), span)
                value = low[rows[pick], x] + np.arange(len(pick)) - np.repeat(np.cumsum(span) - span, span)
                rows = rows[pick]
                cell = cell[pick] * base + value + base // 2
                own = own[pick] & (value == home[rows, x])
            yield k, rows, cell, own


def _boxes(part: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows in small boxes: halved along the longest side until a box has at most ``most``."""
    todo = [rows] if len(rows) else []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            yield own
            continue
        own = own[np.argpartition(part[own, int(np.ptp(part[own], axis=0).argmax())], len(own) // 2)]
        todo += [own[: len(own) // 2], own[len(own) // 2 :]]


def _meetings(part: np.ndarray, homes: np.ndarray, others: np.ndarray, whole: int, box: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Boxes of homes, each with the others whose squared distance from the box is at most ``whole``; found by way of boxes 16 times as large."""

    def close(own: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = part[own].min(axis=0)[:, None], part[own].max(axis=0)[:, None]
        beside = np.maximum(low - at, at - high)
        np.maximum(beside, 0, out=beside)
        beside *= beside
        return beside.sum(axis=0) <= whole

    sides = np.ascontiguousarray(part[others].T)
    for large in _boxes(part, homes, 16 * box):
        some = close(large, sides)
        rows, at = others[some], np.ascontiguousarray(sides[:, some])
        for own in _boxes(part, large, box):
            yield own, rows[close(own, at)]


def _compare(threshold: float, blocks: int, axes: int, box: int = 64, pairs: int = 1 << 16):
    schema = pa.schema([("cid", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def rows(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        grid = Grid.of(dim, threshold, blocks, axes)
        raw = unpack(table["vec"], dim)
        copies, home = table["copies"].to_numpy(), np.flatnonzero(table["home"].to_numpy())
        length = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        turned = grid.turn(raw)
        part = turned[:, grid.edges[block] : grid.edges[block + 1]]
        limit = np.float32(grid.budget[block] + 1e-5)
        others = np.flatnonzero(table["other"].to_numpy())
        scaled = part / grid._UNIT
        square = np.einsum("ij,ij->i", scaled, scaled)
        one = np.ones(len(part))
        mine = np.column_stack([-2 * scaled, square, one]).astype(np.float32)  # their product with the others is the squared distance
        theirs = np.column_stack([scaled, one, square]).astype(np.float32)
        links, root = np.zeros(len(raw), np.int64), np.arange(len(raw))
        for own, near in _meetings(part, home, others, grid.whole[block], box):
            step = max(1, pairs // len(own))
            for at in range(0, len(near), step):
                some = near[at : at + step]
                i, j = np.divmod(np.flatnonzero(mine[own] @ theirs[some].T <= limit), len(some))
                i, j = own[i], some[j]
                apart = i != j
                i, j = i[apart], j[apart]
                close = np.einsum("ij,ij->i", raw[i], raw[j]) / (length[i] * length[j]) >= threshold
                i, j = i[close], j[close]
                gap = (turned[i] - turned[j]) ** 2
                first = gap[:, grid.edges[block] : grid.edges[block + 1]].sum(axis=1) <= grid.whole[block]
                for k in range(block):  # whether an earlier block has the pair
                    first &= gap[:, grid.edges[k] : grid.edges[k + 1]].sum(axis=1) > grid.whole[k]
                i, j = i[first], j[first]
                np.add.at(links, i, copies[j])
                if (root[i] != root[j]).any():
                    label, place = np.unique(np.concatenate([root[i], root[j]]), return_inverse=True)
                    new = np.arange(len(raw))
                    new[label] = label[local_roots(len(label), place[: len(i)], place[len(i) :])]
                    root = new[root]
        told = np.flatnonzero(links)
        # A vector may be joined by another one's link alone: it is told for its root, too.
        told = np.union1d(told, np.flatnonzero(root != np.arange(len(raw))))
        told = np.union1d(told, root[told])
        cid = table["cid"].to_pylist()
        return pa.table([[cid[k] for k in told], links[told], [cid[root[k]] for k in told]], schema=schema)

    return rows


def link(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, blocks: int = 8, cell_rows: int = 32768, task_homes: int = 16384, task_rows: int = 65536) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept, class_id``.

    ``n_links`` counts the other rows with cosine >= threshold, equal vectors among them.  A null, empty or zero vector and one with
    a null or non-finite component links with nothing.  Vectors of different length do not link.  A null id is a row of its own and
    links, but is never the smallest id of a component unless it has no other.  Other columns play no part, whatever their names.
    """
    base = scratch.table(vectors(df, id_col, vector_col), "vectors")
    classes = base.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = scratch.table(classes, "classes")
    n = classes.count()
    axes = max(1, round(math.log(max(n / cell_rows, 1), 3)))  # a block's dimensions at most

    def spread(batches: Iterator[pa.RecordBatch], tiles: dict | None):
        """Rows of the range join; without tiles, only how many homes and rows each cell has."""
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                raw = unpack(batch.column(2).take(pa.array(mine)), int(dim))
                grid = Grid.of(int(dim), threshold, blocks, axes)
                for block, rows, cell, own in grid.cells(grid.turn(raw)):
                    if tiles is None:
                        found, where, count = np.unique(cell, return_inverse=True, return_counts=True)
                        homes = np.bincount(where, own, len(found)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x), pa.int32()) for x in (dim, block)] + [pa.array(found), pa.array(homes), pa.array(count)], names=["dim", "block", "cell", "homes", "rows"])
                        continue
                    parts, slices = np.array([tiles.get((int(dim), block, c), (1, 1)) for c in cell.tolist()], np.int64).reshape(-1, 2).T
                    times = parts + (slices - 1) * own  # its slice meets each tile; a home's tile meets the other slices as well
                    again = np.repeat(np.arange(len(rows)), times)
                    nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                    at, parts, slices = rows[again], parts[again], slices[again]
                    my_tile, my_slice = at % parts, at // parts % slices
                    other = nth < parts
                    mine_home = own[again] & (~other | (nth == my_tile))
                    further = nth - parts
                    tile = np.where(other, nth * slices + my_slice, my_tile * slices + further + (further >= my_slice))
                    taken = batch.take(pa.array(mine[at]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), x), pa.int32()) for x in (dim, block)] + [pa.array(cell[again]), pa.array(tile), pa.array(mine_home), pa.array(other), taken.column(0), taken.column(3), taken.column(2)],
                        names=["dim", "block", "cell", "tile", "home", "other", "cid", "copies", "vec"],
                    )

    ready = classes.select("cid", "dim", "vec", "copies")
    counts = ready.mapInArrow(lambda b: spread(b, None), "dim int, block int, cell long, homes long, rows long").groupBy("dim", "block", "cell").agg(F.sum("homes").alias("homes"), F.sum("rows").alias("rows"))
    tiles = {(r["dim"], r["block"], r["cell"]): (max(1, -(-r["homes"] // task_homes)), -(-r["rows"] // task_rows)) for r in counts.filter((F.col("homes") > task_homes) | (F.col("rows") > task_rows)).collect()}  # bounded by the number of cells
    joined = ready.mapInArrow(lambda b: spread(b, tiles), "dim int, block int, cell long, tile long, home boolean, other boolean, cid binary, copies long, vec binary")
    found = scratch.table(joined.groupBy("dim", "block", "cell", "tile").applyInArrow(_compare(threshold, blocks, axes), "cid binary, links long, root binary"), "links")
    return assemble(base.select("vec_id", "cid"), classes, found, "vec_id")


def assemble(rows: DataFrame, classes: DataFrame, found: DataFrame, id_name: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """From classes and what tasks found (``cid, links, root``) to one row per input row; ``extra`` may name ``cid`` and ``component``, a class that stands for all that links reach."""
    links = found.groupBy("cid").agg(F.sum("links").alias("__links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    least = joined.join(classes.select(F.col("cid").alias("id"), "class_id"), "id").groupBy("component").agg(F.min("class_id").alias("__least"))
    roots = joined.join(least, "component").select(F.col("id").alias("cid"), "__least", "component")
    told = classes.select("cid", "class_id", "copies").join(links, "cid", "left").join(roots, "cid", "left")
    told = told.select("cid", "class_id", (F.coalesce("__links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("__least", "class_id").alias("component_id"), F.coalesce("component", "cid").alias("component"))
    out = rows.join(told, "cid", "left")
    component = F.coalesce("component_id", id_name)
    return out.select(id_name, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_name) == component, F.lit(True)).alias("kept"), F.coalesce("class_id", id_name).alias("class_id"), *extra)
