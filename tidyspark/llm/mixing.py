"""Mixing of sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Slot ``i`` of the mix stands at the golden-ratio point ``frac((i + 1) * phi)``; the cumulative target shares map the point to a
source, so every stretch of the schedule has each source in its share.  The slots of a source are ranked, and slot ``r``
takes the ``r``-th block of ``block_words`` words of that source's endless stream: its documents in the order of a hash,
again and again.  A source's last slot is cut where its target is reached.

Ranks and stream offsets are prefix sums in two levels (inside hash buckets or slot ranges, then over those), so that a
source with a third of all rows is spread over many tasks.

Places, schedule and what is taken of each document are written before they are joined: they have some numbers a row, and in one plan
their stages are planned and sent out side by side, which the driver's memory has to hold.  What has rows by bucket, slot or document is
joined by sorting, never sent through the driver to all tasks, however small it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
PHI = 0.6180339887498949
_CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = 3) -> DataFrame:
    """``__source, source, source_size, target``: one row per source, numbered by code point with null last.

    Weights repeat along the sources.  A target above ``most_passes`` times the source's size stops there and the excess
    is shared by weight among the others, until none is above.  In order of size by weight, the sources that stop come
    first: the first source whose level (what is left by what weight is left) is no larger than its own limit fixes
    the level of all that follow.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())  # as many rows as there are sources
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__source") % len(weights) + 1).cast("int"))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = by_source.withColumn("__source", (F.row_number().over(everything) - 1).cast("long")).withColumn("__weight", weight.cast("long"))
    by_limit = Window.orderBy(F.col("source_size") * most_passes / F.col("__weight"), "__source")
    stopped = F.coalesce(F.sum(F.col("source_size") * most_passes).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("__weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.orderBy("__source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - stopped).cast("double") / left
    leveled = by_source.withColumn("__level", level).withColumn("__limit", (F.col("source_size") * most_passes).cast("double"))
    free = F.col("__level") * F.col("__weight") <= F.col("__limit")
    leveled = leveled.withColumn("__final", F.max(F.when(free, F.struct(-F.col("__limit") / F.col("__weight"), -F.col("__source"), "__level"))).over(whole)["__level"])
    return leveled.select("__source", "source", "source_size", F.least(F.col("__limit"), F.col("__final") * F.col("__weight")).alias("target"))


def _buckets(n: int, rows: int = 50_000) -> int:
    return max(1, -(-n // rows))


def schedule(shares: DataFrame, slots: int, chunk: int = 50_000, step: float = PHI) -> DataFrame:
    """``__source, slot, rank``: the source of each slot and which of that source's slots it is.

    ``shares`` has ``__source`` and ``__quota``, how many slots the source gets.  Slots beyond the quota are left out; the few
    that the points leave a source short of its quota follow at the end of the schedule.  ``step`` is the way from one point to the next.
    """
    spark = shares.sparkSession
    whole = Window.orderBy("__source")
    low = F.coalesce(F.sum("target").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("target").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    spans = shares.filter("target > 0").withColumn("__low", low / total)
    spans = spans.withColumn("__high", F.coalesce(F.lead("__low").over(whole), F.lit(1.0)))
    cells = spans.select("__source", "__quota", "__low", "__high", F.explode(F.sequence(F.floor(F.col("__low") * _CELLS), F.least(F.floor(F.col("__high") * _CELLS), F.lit(_CELLS - 1)))).alias("__cell"))
    high, low_bits = F.floor((F.col("id") + 1) / (1 << 20)), (F.col("id") + 1) % (1 << 20)
    point = F.expr("__x - floor(__x)")
    points = spark.range(slots).withColumn("__x", high * ((step * (1 << 20)) % 1) + low_bits * step).select(F.col("id").alias("slot"), point.alias("__point"))
    points = points.withColumn("__cell", F.floor(F.col("__point") * _CELLS))
    dealt = points.join(cells, "__cell").filter("__point >= __low AND __point < __high").select("__source", "__quota", "slot", F.floor(F.col("slot") / chunk).alias("__chunk"))
    counts = dealt.groupBy("__source", "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = Window.partitionBy("__source", "__chunk").orderBy("slot")
    ranked = dealt.withColumn("__nth", F.row_number().over(inside)).join(counts.hint("merge"), ["__source", "__chunk"])
    ranked = ranked.withColumn("rank", F.col("__before") + F.col("__nth") - 1).filter("rank < __quota").select("__source", "slot", "rank")
    had = counts.groupBy("__source").agg(F.sum("__n").alias("__had"))
    short = spans.join(had, "__source", "left").withColumn("__had", F.coalesce("__had", F.lit(0))).filter("__had < __quota")
    extra = short.select("__source", F.explode(F.sequence(F.col("__had"), F.col("__quota") - 1)).alias("rank")).select("__source", (F.lit(slots) + F.col("rank")).alias("slot"), "rank")
    return ranked.unionByName(extra)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_passes: int = 3, block_words: int = 1024, step: float = PHI
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, first_slot, slots`` and ``__text_hash``.

    ``slots`` has the place in the schedule of the block in which each pass over the document begins, ``first_slot`` the first of them (null for a document that isn't taken): in the order of slots
    every stretch of the mix has each source near its share.  A null or empty text has size 0 and is never taken.  An empty table has no rows.  Null is a source like any other, the last one.  Repeated rows are
    documents of their own.  The order of documents hangs on their ids alone, so reruns agree.  Other columns play no part.
    """
    text = F.col(text_col)
    key = F.md5(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")))
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), key.alias("__key"), F.xxhash64(text).alias("__text_hash"))
    sizes = scratch.table(sizes, "sizes")
    n = sizes.count()
    share = scratch.table(targets(sizes, weights, most_passes).withColumn("__words", F.round("target").cast("long")).withColumn("__quota", F.ceil(F.col("__words") / block_words)), "shares")
    slots = share.agg(F.sum("__quota")).first()[0] or 0

    bucket = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * _buckets(n) / (1 << 32))
    placed = sizes.join(share, sizes["source"].eqNullSafe(share["source"])).select(sizes["*"], *(share[c] for c in ("__source", "source_size", "target", "__words"))).withColumn("__bucket", bucket)
    sums = placed.groupBy("__source", "__bucket").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__source", "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__key", "doc_id", "size", "__text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("__to", F.sum("size").over(inside)).join(sums.hint("merge"), ["__source", "__bucket"])
    placed = scratch.table(placed.withColumn("__from", F.col("__base") + F.col("__to") - F.col("size")).drop("__bucket", "__base", "__to", "__key", "source"), "placed")

    # The document's words in each pass of the endless stream that the target reaches, and the blocks they lie in.
    passes = F.filter(F.sequence(F.lit(0), F.lit(most_passes - 1)), lambda j: F.col("__from") + j * F.col("source_size") < F.col("__words"))
    parts = placed.filter("size > 0").select("doc_id", "__text_hash", "__source", "size", "source_size", "target", "__words", "__from", F.explode(passes).alias("__pass"))
    parts = parts.withColumn("__a", F.col("__from") + F.col("__pass") * F.col("source_size")).withColumn("__b", F.least(F.col("__a") + F.col("size"), "__words"))
    parts = parts.withColumn("rank", F.explode(F.sequence(F.floor(F.col("__a") / block_words), F.floor((F.col("__b") - 1) / block_words))))
    words = F.least(F.col("__b"), (F.col("rank") + 1) * block_words) - F.greatest(F.col("__a"), F.col("rank") * block_words)
    begins = [F.min(F.when((F.col("__pass") == j) & (F.col("rank") == F.floor(F.col("__a") / block_words)), F.col("slot"))).alias(f"__slot{j}") for j in range(most_passes)]
    dealt = scratch.table(schedule(share, slots, step=step), "schedule")
    taken = parts.join(dealt.hint("merge"), ["__source", "rank"]).groupBy("__source", "__from", "size").agg(F.sum(words).alias("taken"), *begins)
    taken = taken.withColumn("slots", F.filter(F.array(*(F.col(f"__slot{j}") for j in range(most_passes))), lambda x: x.isNotNull()))
    # (source, place in its stream) names a row; rows of size 0 share a place but are never taken
    found = placed.join(taken.hint("merge"), ["__source", "__from", "size"], "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("slots")[0].alias("first_slot"), "slots", "__text_hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document taken k times and a part is k whole rows and one row with
    the first words of its text; documents that are not taken go, as do null, empty and blank texts, which have no words.

    The rows are in the order of the schedule, by the slot in which they begin, in ranges: a partition holds a stretch of slots, so written as it is the mix can be read from its front, with each
    source near its share at any point.  Null ids, sources and character counts stay null.  Repeated rows are taken each on its own.  An empty table stays empty.  Columns may have any names but ``__id``,
    ``__text_hash``, ``__nth``, ``__size``, ``__taken``, ``__slots``, ``__pass``, ``__slot`` and ``__part``.
    """
    keys = ["__id", "__text_hash"]
    counted = mix(docs, id_col, text_col, **how).filter("taken > 0").select(F.col("doc_id").alias("__id"), "__text_hash", F.col("size").alias("__size"), F.col("taken").alias("__taken"), F.col("slots").alias("__slots"))
    nth = lambda by: F.row_number().over(Window.partitionBy(*keys).orderBy(by))  # noqa: E731  repeated rows are alike, so any order of them will do
    counted = scratch.table(counted.withColumn("__nth", nth(F.col("__taken").desc())), "taken")
    rows = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__text_hash", F.xxhash64(text_col)).withColumn("__nth", nth(F.lit(1)))
    same = rows["__id"].eqNullSafe(counted["__id"]) & (rows["__text_hash"] == counted["__text_hash"]) & (rows["__nth"] == counted["__nth"])
    rows = rows.join(counted.hint("merge"), same).select(*(rows[c] for c in docs.columns), counted["__size"], counted["__taken"], counted["__slots"], counted["__text_hash"])
    first_words = F.rtrim(F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("__part")), ""))
    rows = rows.select("*", F.posexplode("__slots").alias("__pass", "__slot"))
    left = F.col("__taken") - F.col("__pass") * F.col("__size")
    rows = rows.withColumn("__part", F.when(left < F.col("__size"), left).otherwise(0).cast("int"))
    rows = rows.withColumn(text_col, F.when(F.col("__part") > 0, first_words).otherwise(F.col(text_col)))
    if chars_col in docs.columns:
        rows = rows.withColumn(chars_col, F.when(F.col("__part") > 0, F.char_length(text_col)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    placed = rows.repartitionByRange("__slot", "__text_hash").sortWithinPartitions("__slot", "__text_hash", "__pass")
    return placed.select(*docs.columns)


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w,
             row_number() OVER (ORDER BY source ASC NULLS LAST) AS nr FROM d GROUP BY source),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(w) OVER (ORDER BY source_size * 3 / w, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s),
f AS (SELECT level FROM l WHERE level * w <= source_size * 3 ORDER BY source_size * 3 / w, nr LIMIT 1),
t AS (SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), (SELECT level FROM f) * w) AS target FROM l),
u AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nr, CAST(round(target) AS BIGINT) AS words, (CAST(round(target) AS BIGINT) + 1023) // 1024 AS quota FROM t),
z AS (SELECT CAST(sum(quota) AS BIGINT) AS slots FROM u),
v AS (SELECT *, coalesce(sum(target) OVER (ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(target) OVER () AS low FROM u WHERE target > 0),
y AS (SELECT *, coalesce(lead(low) OVER (ORDER BY nr), 1) AS high FROM v),
x AS (SELECT slot, (slot + 1) // 1048576 * CAST('{(PHI * (1 << 20)) % 1!r}' AS DOUBLE) + (slot + 1) % 1048576 * CAST('{PHI!r}' AS DOUBLE) AS x FROM (SELECT unnest(range(slots)) AS slot FROM z)),
g AS (SELECT y.nr, slot, quota, row_number() OVER (PARTITION BY y.nr ORDER BY slot) - 1 AS rank FROM x JOIN y ON x - floor(x) >= low AND x - floor(x) < high),
h AS (SELECT nr, count(*) AS had FROM g GROUP BY nr),
e AS (SELECT nr, slot, rank FROM g WHERE rank < quota UNION ALL
      SELECT nr, (SELECT slots FROM z) + rank, rank FROM (SELECT y.nr, unnest(range(coalesce(had, 0), quota)) AS rank FROM y LEFT JOIN h USING (nr))),
p AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.words, u.nr,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST(words // source_size * size + greatest(0, least(b, words % source_size) - (b - size)) AS BIGINT) END AS taken, e.slot AS first_slot
FROM p LEFT JOIN e ON e.nr = p.nr AND e.rank = (b - size) // 1024 AND size > 0 AND b - size < words
"""
