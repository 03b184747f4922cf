"""Near-duplicate documents: word n-gram Jaccard join with Bayesian pruning.

1. Every document gets a class (digest of its words) and MinHash values of its word n-grams, from which 36 bands of five
   values are hashed.  A pair with Jaccard 0.8 shares no band with probability ``(1 - 0.8 ** 5) ** 36``, below 1e-6.
2. Classes that share a band are linked to the smallest class of the band, its head, never to each other, and heads to the smallest of
   a class's heads; connected components of these stars hold every candidate pair.
3. A component's texts meet once, in one task.  A component too large for that is not gathered: there classes meet by head, as two
   classes with a band in common have its head in common, and a pair counts at the smallest head that both have.  Only what has a head in
   common is compared, however long the chains are.  A head with too much text is cut into tiles and each pair of tiles is a task.
4. Pairs compare MinHash values a few at a time; with a uniform prior the posterior
   probability that the similarity reaches the threshold after m of n matches is ``P(Binomial(n + 1, t) <= m)``, and a pair below the
   tolerance is dropped.  All that remain are verified on their whole n-gram sets.

A task compares one class with the others at a time and keeps no pairs: what it holds, and what leaves it, is the number of
links of each class and which classes they connect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .embedding_dedup import assemble
from .graph import components
from .wordarrays import mix64, row_groups, utf8, window_hashes, window_starts, words

BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
_random = np.random.default_rng(1009)
_MULTIPLY = _random.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _random.integers(0, 2**32, HASHES, dtype=np.uint32)
_FOLD = _random.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes of all rows one after the other, where each row's begin, and two hashes of each row's words.

    A row with fewer words than ``width`` has one n-gram of all its words; a row without words has none.
    """
    w = words(data, offsets)
    hashes, count = w.hashes(), np.diff(w.first)
    starts = window_starts(w.first, width)
    grams = window_hashes(hashes, width)[starts] if len(starts) else np.zeros(0, np.uint64)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out, bounds = np.empty(int(n.sum()), np.uint64), np.concatenate(([0], np.cumsum(n)))
    long = np.repeat(count >= width, n)
    out[long] = grams
    for k in range(1, width):
        few = np.flatnonzero(count == k)
        if len(few):
            out[bounds[few]] = window_hashes(hashes, k)[w.first[few]]
    digest = []
    for family in (0, 1):
        total = np.zeros(len(count), np.uint64)
        some = np.flatnonzero(count)
        place = np.arange(len(hashes)) - np.repeat(w.first[:-1], count)
        weighted = mix64(hashes + mix64(place.astype(np.uint64) + np.uint64(1 + family)))
        if len(some):
            total[some] = np.add.reduceat(weighted, w.first[some])
        digest.append(mix64(total + count.astype(np.uint64)))
    return out, bounds, digest[0], digest[1]


def signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, HASHES) smallest hash values; rows without n-grams have the largest value everywhere."""
    out = np.full((len(bounds) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        x, begin = (grams >> np.uint64(32)).astype(np.uint32), bounds[some]
        y = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, _MULTIPLY[k], out=y)
            y += _ADD[k]
            out[some, k] = np.minimum.reduceat(y, begin)
    return out


def _keys(values: np.ndarray) -> np.ndarray:
    folded = (values.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _FOLD
    return mix64(folded.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _cids(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    raw = np.stack([a, b], axis=1).astype(">u8").tobytes()
    return [raw[16 * k : 16 * k + 16] if n[k] else None for k in range(len(a))]


def fingerprints(docs: DataFrame, width: int, batch_bytes: int = 1 << 19) -> DataFrame:
    """``doc_id, cid, bands``; cid is null for a text without words and for a null id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in row_groups(offsets, batch_bytes):
                grams, bounds, a, b = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                n = np.diff(bounds)
                keys = _keys(signatures(grams, bounds)).view(np.int64)
                n = n * batch.column(0).slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (len(n) + 1), BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(_cids(a, b, n), pa.binary()), bands], names=["doc_id", "cid", "bands"])

    return docs.mapInArrow(rows, "doc_id long, cid binary, bands array<long>")


def least_matches(threshold: float, tolerance: float, step: int) -> list[tuple[int, int, int]]:
    """(n, m, e): after n values a pair with fewer than m matches is dropped; one with e is so likely near that it is verified at once."""
    out = []
    for n in range(step, HASHES + 1, step):
        below, m, e = 0.0, -1, n + 1
        for k in range(n + 1):
            below += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)  # the posterior after k matches
            if m < 0 and below >= tolerance:
                m = k
            if below >= 0.99:
                e = k
                break
        out.append((n, m, e))
    return out


class _Grams:
    """The distinct n-grams of some rows, and which rows have each of those that several have."""

    def __init__(self, grams: np.ndarray, bounds: np.ndarray, rows: list[int]):
        sets = [np.unique(grams[bounds[k] : bounds[k + 1]]) for k in rows]
        self.size = np.array([len(x) for x in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), self.size)
        _, code, often = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        shared = often[code] > 1
        row, code = row[shared], (np.cumsum(often > 1) - 1)[code[shared]]
        self._codes, self._first = code, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sets)))))
        self._rows = row[np.argsort(code, kind="stable")]
        self._begin = np.concatenate(([0], np.cumsum(np.bincount(code))))

    def shared_with(self, k: int) -> np.ndarray:
        """How many n-grams each row has in common with row ``k``."""
        code = self._codes[self._first[k] : self._first[k + 1]]
        many = self._begin[code + 1] - self._begin[code]
        at = np.repeat(self._begin[code] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum())) if len(code) else np.zeros(0, np.int64)
        return np.bincount(self._rows[at], minlength=len(self.size))


def _compare(width: int, threshold: float, tolerance: float, step: int = 20):
    schema = pa.schema([("cid", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
    tests = least_matches(threshold, tolerance, step)

    def rows(table: pa.Table) -> pa.Table:
        data, offsets = utf8(table["__text"])
        grams, bounds, a, b = shingles(data, offsets, width)
        cid = table["cid"].to_pylist()
        own = _cids(a, b, np.diff(bounds))
        seen: set = set()
        rows = [k for k in range(len(cid)) if own[k] == cid[k] and cid[k] not in seen and not seen.add(cid[k])]  # a row with the id of a class but another text, or a copy, goes
        cid = [cid[k] for k in rows]
        n, tile, copies = len(rows), table["tile"].to_numpy()[rows], table["copies"].to_numpy()[rows]
        first, second, unit = (table[c][0].as_py() for c in ("first", "second", "unit"))
        values = np.ascontiguousarray(signatures(grams, bounds)[rows].T)
        sets = _Grams(grams, bounds, rows)
        # Smaller heads: a pair that has one in common counts there.
        heads = table["heads"].take(pa.array(rows)).to_pylist()
        smaller = [[h for h in x or () if h < unit] for x in heads]
        members: dict[bytes, list[int]] = {}
        for k, x in enumerate(smaller):
            for h in x:
                members.setdefault(h, []).append(k)
        size, links, root = sets.size, np.zeros(n, np.int64), np.arange(n)
        in_second = np.flatnonzero(tile == second)
        elsewhere = np.zeros(n, dtype=bool)
        for k in np.flatnonzero(tile == first).tolist():
            others = in_second[in_second > k] if first == second else in_second
            others = others[np.minimum(size[others], size[k]) >= threshold * np.maximum(size[others], size[k])]
            if smaller[k]:
                counted = [members[h] for h in smaller[k]]
                for x in counted:
                    elsewhere[x] = True
                others = others[~elsewhere[others]]
                for x in counted:
                    elsewhere[x] = False
            match, sure = np.zeros(len(others), np.int32), []
            for m, least, enough in tests:
                if not len(others):
                    break
                some = values[m - step : m]
                if 4 * len(others) > n:  # most of them: read in a stretch
                    match += (some == some[:, k, None]).sum(axis=0, dtype=np.int32)[others]
                else:
                    match += (some[:, others] == some[:, k, None]).sum(axis=0, dtype=np.int32)
                sure.append(others[match >= enough])
                stay = (match >= least) & (match < enough)
                others, match = others[stay], match[stay]
            others = np.concatenate([others, *sure])
            if not len(others):
                continue
            both = sets.shared_with(k)[others]
            others = others[both >= threshold * (size[k] + size[others] - both) - 1e-9]
            links[k] += copies[others].sum()
            links[others] += copies[k]
            labels = root[others]
            if (labels != root[k]).any():
                labels = np.unique(np.append(labels, root[k]))
                root[np.isin(root, labels)] = labels[0]
        told = np.flatnonzero(links)
        return pa.table([[cid[k] for k in told], links[told], [cid[root[k]] for k in told]], schema=schema)

    return rows


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, task_bytes: int = 3 << 20) -> DataFrame:
    """One row per input row: ``doc_id, n_links, component_id, kept, class_id``.

    ``n_links`` counts the other rows whose set of ``width``-word n-grams has Jaccard >= threshold, copies among them.  Texts with the same
    words are one class, ``class_id`` its smallest id; ``component_id`` is the smallest id that links reach and ``kept`` marks its row.
    A text with fewer words has one n-gram of all its words; a null, empty or blank text links with nothing.  Rows may repeat:
    each row counts.  A row with a null id links with nothing.  Texts of any length are read whole; a task holds two tiles of ``task_bytes`` of text, or a longer text.
    An empty table has no rows.  Other columns play no part, whatever their names.
    """
    return _linked(docs, id_col, text_col, width, threshold, tolerance, task_bytes)


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, task_bytes: int = 3 << 20, extra: tuple[str, ...] = ()) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    base = scratch.table(fingerprints(docs, width), "fingerprints")
    classes = base.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = scratch.table(classes, "classes")
    keyed = classes.select("cid", F.explode("bands").alias("key")).repartition("key")
    bucket = keyed.groupBy("key").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).filter("least <> most").drop("most")
    # A class points at the smallest of all its bands' smallest classes, and so do those: one edge a class, and few between the smallest.
    heads = keyed.join(bucket, "key").groupBy("cid").agg(F.collect_set("least").alias("heads")).withColumn("b", F.array_min("heads"))  # at most a head a band
    heads = scratch.table(heads, "heads")
    stars = heads.select(F.explode(F.array_union("heads", F.array("cid"))).alias("a"), "b").filter("a <> b").distinct()
    members = components(stars).select(F.col("id").alias("cid"), "component").join(classes.drop("bands"), "cid").join(heads.drop("b"), "cid")
    members = scratch.table(members, "members")
    # Both sides grow with the corpus: neither is ever broadcast.
    texts = docs.join(members.hint("merge"), docs["doc_id"] == members["class_id"]).select("cid", "component", "copies", "heads", "__text")
    texts = scratch.table(texts, "texts")
    # What meets in a task: the whole component, or of one that is too large the classes with a common head.
    large = texts.groupBy("component").agg((F.sum(F.octet_length("__text")) > task_bytes).alias("__large"))
    texts = texts.join(large, "component")
    whole = texts.filter("NOT __large").select("cid", "copies", F.lit(None).cast("array<binary>").alias("heads"), "__text", F.col("component").alias("unit"), F.lit(1).alias("tiles"))
    by_head = texts.filter("__large").withColumn("unit", F.explode("heads")).select("cid", "copies", "heads", "__text", "unit")
    weight = texts.filter("__large").select(F.explode("heads").alias("unit"), F.octet_length("__text").alias("__bytes")).groupBy("unit").agg(F.ceil(F.sum("__bytes") / task_bytes).cast("int").alias("tiles"), F.count("*").alias("__n"))
    by_head = by_head.join(weight.filter("__n >= 2").drop("__n"), "unit")
    # The text of a unit decides into how many tiles it is cut; a row goes to each pair of tiles that has its own.
    tiled = whole.unionByName(by_head).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    pairs = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("first", F.least("tile", "other")).withColumn("second", F.greatest("tile", "other")).drop("other", "tiles")
    found = pairs.groupBy("unit", "first", "second").applyInArrow(_compare(width, threshold, tolerance), "cid binary, links long, root binary")
    return assemble(base.select("doc_id", "cid"), classes.select("cid", "class_id", "copies"), scratch.table(found, "links"), "doc_id", extra)


def _classed(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int = 1 << 19) -> DataFrame:
    """``docs`` with ``__id`` and ``__cid``, as fingerprints() has them."""
    docs = docs.withColumn("__id", F.col(id_col).cast("long"))
    text_at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            cids: list[bytes | None] = []
            for lo, hi in row_groups(offsets, batch_bytes):
                _, bounds, a, b = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], 1)
                cids += _cids(a, b, np.diff(bounds) * batch.column(batch.num_columns - 1).slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cids, pa.binary())], names=[*batch.schema.names, "__cid"])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField("__cid", T.BinaryType())]))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked documents the one with the smallest id stays, once.

    Rows are told apart by id and words, as rows may share an id but not a text; of linked texts with one id the one with the smallest class stays.
    Rows with a null id, and null, empty or blank texts, stay as they are; repeated rows of such a text stay, too.  An empty table stays empty.  Columns may have any names but
    ``__id``, ``__cid``, ``__kept_id``, ``__kept_cid`` and ``__linked``.
    """
    found = _linked(docs, id_col, text_col, extra=("cid", "component"), **how).filter("kept")
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("cid").alias("__cid")).agg(F.max(F.col("n_links") > 0).alias("__linked"), F.first("component").alias("component"))
    found = scratch.table(found, "kept")  # read four times below; its plan is long
    one = found.filter("__linked").groupBy("__id", "component").agg(F.min("__cid").alias("__cid")).select("__id", "__cid", F.lit(True).alias("__linked"))
    stays = found.filter("NOT __linked").select("__id", "__cid", "__linked").unionByName(one).select(F.col("__id").alias("__kept_id"), F.col("__cid").alias("__kept_cid"), "__linked")
    classed = _classed(docs, id_col, text_col)
    out = classed.join(stays, F.col("__id").eqNullSafe(F.col("__kept_id")) & F.col("__cid").eqNullSafe(F.col("__kept_cid")))
    single = out.filter("NOT __linked").select(*docs.columns)
    return single.unionByName(out.filter("__linked").dropDuplicates(["__id", "__cid"]).select(*docs.columns))
