"""Exact rolling medians and MADs by offline parallel bisection.

The clicks of a series (a kind) are cut into cells of four windows' length; a cell also gets the rows of the last window's length
before it, so it holds every window of its own clicks.  A task takes many cells at once, in order of time, so that a window is a
stretch of positions.  The values are swept once in sorted order, sixteen ways at a time, into prefix counts: how many of the first i rows
have a smaller digit.  With those, one step tells for all windows together how many of their values lie below a bound of each window's own.
All medians are bisected together on the ranks of the values, then all MADs on the radius around the own median.

A slot (a stretch of one window's length) with more than ``dense`` rows of a series fits no task's memory for sure.  Windows that
reach into such a slot are bisected by Spark instead: every row lies in one node of each level of a tree over time, a window is a few dozen nodes,
and a round sorts the values of all nodes and the bounds of all windows into one order, in ranges across tasks, where prefix sums count.
So no task, driver or broadcast gets what grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import in_ranges
from . import scratch

_MOST_CENTS = 1 << 58  # four times as much still fits a long
_SLOTS = 4
_BATCH = 1 << 17
_RESULT = "click_id long, kind string, n long, median2 long, mad4 long, far boolean"


def micros(at: Column, kind: str) -> Column:
    """Microseconds since 1970 by the clock shown, without a zone; ``kind`` is the column's type."""
    if kind == "timestamp":
        return F.unix_micros(at)
    day, rest = F.unix_date(at.cast("date")).cast("long"), F.hour(at).cast("long") * 60 + F.minute(at)
    return day * 86_400_000_000 + rest * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def cents(value: Column) -> Column:
    """Hundredths, rounded half up; none for null, NaN, infinities and values whose sums fit no long."""
    scaled = F.floor(value.cast("double") * 100 + 0.5)
    return F.when(F.abs(value.cast("double") * 100) < _MOST_CENTS, scaled).cast("long")


class PrefixCounts:
    """How many rows of a stretch have a rank below a bound, for many stretches and bounds at once."""

    def __init__(self, ranks: np.ndarray, size: int):
        self.levels = []
        order = ranks.astype(np.int32)
        for shift in reversed(range(0, 4 * max(1, -(-size.bit_length() // 4)), 4)):
            digit = (order >> shift) & 15
            counts = np.zeros((len(order) + 1, 17), np.int32)
            np.cumsum(digit[:, None] < np.arange(17), axis=0, out=counts[1:])
            self.levels.append((shift, counts.ravel(), counts[-1].astype(np.int64)))
            order = order[np.argsort(digit, kind="stable")]

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        found = np.zeros(len(low), np.int64)
        for shift, counts, start in self.levels:
            digit = (bound >> shift) & 15
            a, b = low * 17 + digit, high * 17 + digit
            under_a, under_b = counts[a], counts[b]
            found += under_b - under_a
            low, high = start[digit] + counts[a + 1] - under_a, start[digit] + counts[b + 1] - under_b
        return found


def _bisected(least: np.ndarray, most: np.ndarray, enough) -> np.ndarray:
    """For each row the smallest whole number from ``least`` to ``most`` that is ``enough(rows, numbers)``; ``most`` is."""
    low, high = least.copy(), most.copy()
    while len(open_rows := np.flatnonzero(low < high)):
        middle = low[open_rows] + (high[open_rows] - low[open_rows]) // 2
        yes = enough(open_rows, middle)
        high[open_rows[yes]] = middle[yes]
        low[open_rows[~yes]] = middle[~yes] + 1
    return low


def medians(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubled medians and doubled medians of the doubled distances from them, of the stretches ``low`` to ``high`` (none empty) of ``values``."""
    known, ranks = np.unique(values, return_inverse=True)
    prefix = PrefixCounts(ranks, len(known))
    n = high - low
    even = np.flatnonzero(n % 2 == 0)

    def both(most: np.ndarray, count) -> tuple[np.ndarray, np.ndarray]:
        """The lower and the upper middle one."""
        first = _bisected(np.zeros(len(n), np.int64), most, lambda rows, x: count(rows, x) > (n[rows] - 1) // 2)
        second = first.copy()
        second[even] = _bisected(first[even], most[even], lambda rows, x: count(even[rows], x) > n[even[rows]] // 2)
        return first, second

    below = lambda rows, bound: prefix.below(low[rows], high[rows], bound)
    first, second = both(np.full(len(n), len(known) - 1, np.int64), lambda rows, x: below(rows, x + 1))
    median2 = known[first] + known[second]

    def within(rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        m = median2[rows]
        return below(rows, np.searchsorted(known, (m + radius) >> 1, "right")) - below(rows, np.searchsorted(known, -((radius - m) >> 1), "left"))

    # no radius has to reach beyond the farthest value of the task; most windows need far less, so the bound doubles up to it
    farthest = np.maximum(median2 - 2 * known[0], 2 * known[-1] - median2)
    reach, need = np.minimum(np.abs(median2) + 1, farthest), n // 2
    short = np.arange(len(n))
    while len(short := short[(reach[short] < farthest[short])]) and len(short := short[within(short, reach[short]) <= need[short]]):
        reach[short] = np.minimum(reach[short] * 4, farthest[short])
    first, second = both(reach, within)
    return median2, first + second


def _cells(table: pa.Table, width: int) -> pa.Table:
    """Results of the own rows of whole cells, which come in the order of series, cell and time."""
    ids, kind, cell, at = table["click_id"], table["kind"], table["__cell"].to_numpy(), table["__at"].to_numpy()
    value, own = table["__cents"], table["__own"].to_numpy(zero_copy_only=False)
    code = kind.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    unit = np.cumsum(np.concatenate(([False], (code[1:] != code[:-1]) | (cell[1:] != cell[:-1]))))
    key = unit * (2 * _SLOTS * width) + (at - cell * _SLOTS * width + 2 * width)
    has = value.is_valid().to_numpy(zero_copy_only=False)
    counted, mine = np.flatnonzero(has), np.flatnonzero(own)
    c = value.fill_null(0).to_numpy()
    low, high = (np.searchsorted(key[counted], key[mine] - back, "right") for back in (width, 0))
    n = (high - low).astype(np.int64)
    some = np.flatnonzero(n)
    median2, mad4 = np.zeros((2, len(mine)), np.int64)
    if len(some):
        median2[some], mad4[some] = medians(c[counted], low[some], high[some])
    far = 2 * np.abs(2 * c[mine] - median2) > 2 * mad4
    none = n < 1
    columns = [ids.take(mine), kind.take(mine), n, pa.array(median2, mask=none), pa.array(mad4, mask=none), pa.array(far, mask=none | ~has[mine])]
    return pa.table(columns, names=["click_id", "kind", "n", "median2", "mad4", "far"])


def _in_tasks(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < _BATCH:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cell = table["__cell"].to_numpy()
            kind = table["kind"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1]))
            if len(starts):
                cut = int(starts[-1]) + 1
                yield from _cells(table.slice(0, cut), width).to_batches()
                table = table.slice(cut)
            held, size = table.to_batches(), table.num_rows
        if size:
            yield from _cells(pa.Table.from_batches(held).combine_chunks(), width).to_batches()

    return rows.mapInArrow(run, _RESULT)


# Dense slots: the same bisection with Spark's sort as the sweep.

_WINDOW = ["__series", "__slot", "__offset"]
_NODE = ["__series", "__slot", "__level", "__node"]


def _counts(points: DataFrame, asks: DataFrame, levels: int, key: list[str]) -> DataFrame:
    """``key, found``: how many values of its window are at most ``__bound``, per row of ``asks`` (window, ``__bound``).

    A window at offset o of slot s is what s has up to o and what the slot before has beyond o, by a tree of four branches over offsets.
    """
    branch = F.explode(F.array(*(F.struct(F.lit(j).alias("__level"), F.shiftright("__offset", 2 * j).alias("__node")) for j in range(levels + 1))))
    held = points.select("__series", "__slot", branch.alias("x"), F.col("__cents").alias("__v")).select("__series", "__slot", "x.*", "__v", F.lit(0).alias("__ask"))
    upto = F.col("__offset") + 1
    nodes = [
        F.when(F.shiftright(upto, 2 * j).bitwiseAND(3) > i, F.struct(F.lit(j).alias("__level"), (F.shiftleft(F.shiftright(upto, 2 * j + 2), 2) + i).alias("__node")))
        for j in range(levels)
        for i in range(3)
    ]
    prefix = F.filter(F.array(*nodes), lambda x: x.isNotNull())
    signed = lambda back, sign: F.transform(prefix, lambda x: F.struct((F.col("__slot") - back).alias("__in"), x["__level"].alias("__level"), x["__node"].alias("__node"), F.lit(sign).alias("__sign")))
    whole = F.array(F.struct((F.col("__slot") - 1).alias("__in"), F.lit(levels).alias("__level"), F.lit(0).cast("long").alias("__node"), F.lit(1).alias("__sign")))
    asked = asks.select(*key, "__bound", F.explode(F.concat(signed(0, 1), signed(1, -1), whole)).alias("x"))
    asked = asked.select("__series", F.col("x.__in").alias("__to"), "x.__level", "x.__node", F.col("__bound").alias("__v"), F.lit(1).alias("__ask"), F.struct(*key).alias("__key"), "x.__sign")
    asked = asked.withColumnRenamed("__to", "__slot")
    rows = held.unionByName(asked, allowMissingColumns=True)
    placed = in_ranges(rows, [*map(F.col, _NODE), F.col("__v"), F.col("__ask")])
    point = (1 - F.col("__ask")).cast("long")
    inside = Window.partitionBy(*_NODE, "__part").orderBy("__at")
    ends = placed.groupBy(*_NODE, "__part").agg(F.sum(point).alias("__n"))
    earlier = Window.partitionBy(*_NODE).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    ends = ends.select(*_NODE, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    running = placed.withColumn("__run", F.sum(point).over(inside)).filter("__ask = 1").join(ends, [*_NODE, "__part"])
    found = running.groupBy("__key").agg(F.sum((F.col("__run") + F.col("__before")) * F.col("__sign")).alias("found"))
    told = scratch.table(found.select("__key.*", "found"), "found")
    scratch.drop(placed)
    return told


def _selected(points: DataFrame, asks: DataFrame, levels: int, bounds) -> DataFrame:
    """The smallest whole number from ``__low`` to ``__high`` of each row of ``asks`` with more than ``__k`` values within its ``bounds``."""
    key = [*_WINDOW, "__k"]
    settled, asks = None, scratch.table(asks, "asks")
    while True:
        done = asks.filter("__low >= __high")
        settled = done if settled is None else settled.unionByName(done)
        if asks.filter("__low < __high").isEmpty():
            return settled
        half = asks.filter("__low < __high").withColumn("__middle", F.col("__low") + F.floor((F.col("__high") - F.col("__low")) / 2))
        ends = half.select(*key, F.explode(bounds(F.col("__middle"), F.col("__m"))).alias("x")).select(*key, "x.*")
        found = _counts(points, ends, levels, [*key, "__side"])
        found = found.groupBy(*key).agg(F.sum(F.col("found") * F.col("__side")).alias("__found"))
        yes = F.col("__found") > F.col("__k")
        step = half.join(found, key).withColumn("__high", F.when(yes, F.col("__middle")).otherwise(F.col("__high"))).withColumn("__low", F.when(yes, F.col("__low")).otherwise(F.col("__middle") + 1))
        asks = scratch.table(step.select(*asks.columns), "asks")


def _by_spark(rows: DataFrame, width: int) -> DataFrame:
    """Results of rows marked ``__own``; all rows that their windows reach are there."""
    levels = -(-width.bit_length() // 2)
    rows = rows.withColumn("__offset", F.col("__at") - F.col("__slot") * width)
    points = rows.filter("__cents IS NOT NULL").select("__series", "__slot", "__offset", "__cents")
    windows = scratch.table(rows.filter("__own").select(*_WINDOW).distinct(), "windows")
    least, most = points.agg(F.min("__cents"), F.max("__cents")).first()
    if least is None:
        return rows.filter("__own").select("click_id", "kind", F.lit(0).cast("long").alias("n"), *(F.lit(None).cast(t).alias(c) for c, t in (("median2", "long"), ("mad4", "long"), ("far", "boolean"))))
    sizes = _counts(points, windows.withColumn("__bound", F.lit(most)), levels, _WINDOW).withColumnRenamed("found", "n")
    middles = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))))
    some = sizes.filter("n > 0").withColumn("__k", middles)
    pick = lambda by: F.min(by) + F.max(by)  # noqa: E731  one row for an odd number of values, two for an even one

    side = lambda bound, sign: F.struct(bound.cast("long").alias("__bound"), F.lit(sign).alias("__side"))
    asks = some.select(*_WINDOW, "__k", F.lit(least).alias("__low"), F.lit(most).alias("__high"), F.lit(0).cast("long").alias("__m"))
    median = _selected(points, asks, levels, lambda x, m: F.array(side(x, 1))).groupBy(*_WINDOW).agg(pick("__low").alias("median2"))
    median = scratch.table(median, "medians")
    reach = F.greatest(F.col("median2") - 2 * least, 2 * most - F.col("median2"))
    asks = some.join(median, _WINDOW).select(*_WINDOW, "__k", F.lit(0).cast("long").alias("__low"), reach.alias("__high"), F.col("median2").alias("__m"))
    around = lambda x, m: F.array(side(F.shiftright(m + x, 1), 1), side(-F.shiftright(x - m, 1) - 1, -1))
    mad = _selected(points, asks, levels, around).groupBy(*_WINDOW).agg(pick("__low").alias("mad4"))
    told = sizes.join(median, _WINDOW, "left").join(mad, _WINDOW, "left")
    far = 2 * F.abs(2 * F.col("__cents") - F.col("median2")) > 2 * F.col("mad4")
    return rows.filter("__own").join(told, _WINDOW).select("click_id", "kind", "n", "median2", "mad4", far.alias("far"))


def rolling(
    clicks: DataFrame, id_col: str = "click_id", at_col: str = "ts", series_col: str = "kind", value_col: str = "value", minutes: int = 15, dense: int = 1 << 17
) -> DataFrame:
    """One row per click with a time: ``click_id, kind, n, median2, mad4, far``.

    The window of a click holds the values (in cents) of its series with a time more than its own minus ``minutes`` and at most its own; ties in
    time are all in, equal values all count.  ``n`` is their number, ``median2`` their doubled median, ``mad4`` the doubled median of |2 * cents - median2|, and ``far``
    tells whether the click's own distance is more than that doubled.  A click without a value (null, NaN, infinite, or 2^58 cents and more) has a window, but no ``far``; an empty window has no median.

    Null is a series like any other.  Rows of one id are one click: of rows that differ the one with the smallest time, then series, then value (nulls first); null is an id like any other.  Rows without a time go.
    An empty table gives none.  Other columns play no part, whatever their names.  ``dense``: the most rows of a series and one window's length that a task takes five times over.
    """
    width = minutes * 60_000_000
    at, kind = F.col(at_col), clicks.schema[at_col].dataType.typeName()
    rows = clicks.filter(at.isNotNull()).select(F.col(id_col).cast("long").alias("click_id"), F.struct(micros(at, kind).alias("__at"), F.col(series_col).cast("string").alias("kind"), cents(F.col(value_col)).alias("__cents")).alias("x"))
    events = rows.groupBy("click_id").agg(F.min("x").alias("x")).select("click_id", "x.*").withColumn("__slot", F.floor(F.col("__at") / F.lit(width)))
    events = scratch.table(events, "clicks")
    series = F.coalesce(F.concat(F.lit("="), F.col("kind")), F.lit(""))
    crowded = events.groupBy(series.alias("__series"), "__slot").agg(F.count("*").alias("__n")).filter(F.col("__n") > dense).select("__series", "__slot")
    crowded = scratch.table(crowded, "crowded")
    far_off = None
    if not crowded.isEmpty():
        touched = crowded.select("__series", F.explode(F.array(F.col("__slot") - 1, F.col("__slot"), F.col("__slot") + 1)).alias("__slot"), F.col("__slot").alias("__hot"))
        offs = F.col("__slot") - F.col("__hot")
        touched = touched.groupBy("__series", "__slot").agg(F.max(offs == 0).alias("__full"), F.max(offs >= 0).alias("__reached"))
        events = events.withColumn("__series", series).join(touched, ["__series", "__slot"], "left")
        marked = scratch.table(events.withColumn("__own", F.coalesce("__reached", F.lit(False))), "marked")
        far_off = _by_spark(marked.filter("__full IS NOT NULL").drop("__full", "__reached"), width)
        events = marked.filter("NOT coalesce(__full, false)").withColumn("__own", ~F.col("__own"))
    else:
        events = events.withColumn("__own", F.lit(True))
    cell = F.floor(F.col("__slot") / F.lit(_SLOTS))
    last = (F.col("__slot") == cell * _SLOTS + _SLOTS - 1) & F.col("__cents").isNotNull()
    cells = F.when(last, F.array(F.struct(cell.alias("c"), F.col("__own").alias("o")), F.struct((cell + 1).alias("c"), F.lit(False).alias("o"))))
    cells = cells.otherwise(F.array(F.struct(cell.alias("c"), F.col("__own").alias("o"))))
    spread = events.select("click_id", "kind", "__at", "__cents", F.explode(cells).alias("x")).select("click_id", "kind", F.col("x.c").alias("__cell"), "__at", "__cents", F.col("x.o").alias("__own"))
    near = _in_tasks(spread.repartition("kind", "__cell").sortWithinPartitions("kind", "__cell", "__at"), width)
    return near if far_off is None else near.unionByName(far_off)


ORACLE = r"""
WITH c AS (SELECT click_id, min({'ts': ts, 'kind': coalesce('=' || kind, ''), 'value': value}) AS x FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
e AS (SELECT click_id, x.ts AS ts, CASE WHEN x.kind = '' THEN NULL ELSE substr(x.kind, 2) END AS kind,
             CASE WHEN abs(x.value * 100) < 288230376151711744 THEN CAST(floor(x.value * 100 + 0.5) AS BIGINT) END AS cents FROM c),
w AS (SELECT *, list_sort(coalesce(list(cents) FILTER (cents IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 899999999 MICROSECONDS PRECEDING AND CURRENT ROW), [])) AS l FROM e),
m AS (SELECT click_id, kind, cents, len(l) AS n, l, l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] AS median2 FROM w),
d AS (SELECT *, list_sort(list_transform(l, lambda v: abs(2 * v - median2))) AS r FROM m)
SELECT click_id, kind, CAST(n AS BIGINT) AS n, median2, r[(n + 1) // 2] + r[n // 2 + 1] AS mad4, 2 * abs(2 * cents - median2) > 2 * (r[(n + 1) // 2] + r[n // 2 + 1]) AS far FROM d
"""
