"""Language identification by character models with interpolated Kneser-Ney smoothing.

Texts become lower-case letters with one blank for each run of other characters.  One model per language predicts each
character from the three before it.  What up to ``TOGETHER`` languages say about an n-gram is worked out once, when the model is built:
sorted arrays of n-gram keys hold a row of log-probabilities, one column per language, so that scoring is one search per character, and
shorter n-grams and context weights are looked up only where none of them has seen the longer one.  The language with the lowest
cross-entropy per character wins.

Rejection is calibrated on held-back texts: each training text is scored by models of the other four fifths.  How far its cross-entropy lies above
the mean of its language is divided by the spread that texts of its length have; the tail of these distances beyond their 95th percentile is taken as exponential,
and a text is rejected beyond the distance that a share of ``false_rejections`` of such texts would exceed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .wordarrays import row_groups

ORDER = 4
TOGETHER = 8
_BITS = np.uint64(16)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit character codes of all texts, with ORDER - 1 blanks before each, and where each text's codes begin."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))))
    letter = _letter_table()[codes]
    keep = letter.copy()  # and the first of each run of others, unless it begins the text
    keep[1:] |= letter[:-1]
    begins = bounds[:-1][np.diff(bounds) > 0]
    keep[begins] = letter[begins]
    folded = np.where(letter, (codes ^ (codes >> np.uint32(16))) & np.uint32(0xFFFF), np.uint32(0)).astype(np.uint16)
    bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
    pad = ORDER - 1
    rows = len(texts)
    out = np.zeros(int(bounds[-1]) + pad * rows, np.uint16)
    out[np.arange(int(bounds[-1])) + pad * (1 + np.repeat(np.arange(rows), np.diff(bounds)))] = folded[keep]
    return out, bounds + pad * np.arange(rows + 1)


def _keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Key of the n characters that end at each position from ORDER - 1 on."""
    key = np.zeros(max(len(codes) - ORDER + 1, 0), np.uint64)
    for k in range(n):
        key = (key << _BITS) | codes[ORDER - n + k : len(codes) - n + k + 1].astype(np.uint64)
    return key


@dataclass
class _Part:
    """The models of a few languages."""

    languages: list[str]
    grams: list[np.ndarray]  # by order, from 1: sorted keys
    logs: list[np.ndarray]  # (languages, keys)
    contexts: list[np.ndarray]  # by length of the context, from 1: sorted keys
    weights: list[np.ndarray]  # log of the weight that goes to the shorter model
    floor: np.ndarray  # log-probability of an unknown character

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character (texts, languages), and how many characters that are."""
        codes, bounds = characters(texts)
        size = np.diff(bounds) - (ORDER - 1)
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(size > 0)
        if not len(some):
            return out, size
        key = _keys(codes, ORDER)
        real = np.ones(len(codes), dtype=bool)  # not padding
        real[(bounds[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
        key = key[real[ORDER - 1 :]]
        begin = np.concatenate(([0], np.cumsum(size)))[:-1][some]
        at, hit = _find(self.grams[ORDER - 1], key)
        miss = np.flatnonzero(~hit)
        rest = self._shorter(key[miss], ORDER - 1) if len(miss) else None
        for k in range(len(self.languages)):
            log = self.logs[ORDER - 1][k][at]
            if rest is not None:
                log[miss] = rest[k]
            out[some, k] = -np.add.reduceat(log, begin, dtype=np.float64) / size[some]
        return out, size

    def _shorter(self, key: np.ndarray, n: int) -> np.ndarray:
        """Log-probabilities of keys of n + 1 characters that no language has seen."""
        context, short = key >> _BITS, key & np.uint64((1 << (16 * n)) - 1)
        at, hit = _find(self.contexts[n - 1], context)
        out = np.where(hit, self.weights[n - 1][:, at], 0)
        at, hit = _find(self.grams[n - 1], short)
        below = self.logs[n - 1][:, at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            below[:, miss] = self._shorter(short[miss], n - 1) if n > 1 else self.floor[:, None]
        return out + below


@dataclass
class Limits:
    """Which cross-entropies are a language's own."""

    centres: np.ndarray  # mean cross-entropy of each language
    between: float  # spread of long texts
    within: float  # spread that a text adds, by the root of its length
    most: np.ndarray  # how many spreads a text may lie above its centre, by language

    def accepts(self, language: int, entropy: float, size: int) -> bool:
        return entropy <= self.centres[language] + self.most[language] * math.sqrt(self.between**2 + self.within**2 / size)


@dataclass
class Model:
    parts: list[_Part]
    sharpness: float = 1.0
    limits: Limits | None = None  # none: nothing is rejected

    @property
    def languages(self) -> list[str]:
        return [name for part in self.parts for name in part.languages]

    def accepts(self, language: int, entropy: float, size: int) -> bool:
        """Whether a cross-entropy is within the limits of the language for that length."""
        return self.limits is None or self.limits.accepts(language, entropy, size)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character (texts, languages), and how many characters that are."""
        told = [part.entropies(texts) for part in self.parts]
        return np.concatenate([t[0] for t in told], axis=1), told[0][1]


def _find(pool: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(pool, key), len(pool) - 1)
    return at, pool[at] == key


def train(texts: list[str | None], languages: list[str], false_rejections: float = 1e-3, folds: int = 5) -> Model | None:
    """Fit on all texts; sharpness and limits come from texts scored by models that have not seen them.

    Texts of a language are dealt to the folds in turn.  A language's only text is not held back; if none can be, nothing is rejected.  Texts that are taken for
    another language are no measure for the limits.
    """
    names = sorted(set(languages))
    if not names:
        return None
    of: dict[str, list[int]] = {}
    for i, (text, name) in enumerate(zip(texts, languages)):
        if any(map(str.isalpha, text or "")):
            of.setdefault(name, []).append(i)
    fold = np.full(len(texts), -1)
    for own in of.values():
        if len(own) > 1:
            fold[own] = np.arange(len(own)) % folds
    final = _fit(texts, languages, names)
    told = []
    for k in range(folds):
        back, kept = np.flatnonzero(fold == k).tolist(), np.flatnonzero(fold != k).tolist()
        if back:
            entropy, size = _fit([texts[i] for i in kept], [languages[i] for i in kept], names).entropies([texts[i] for i in back])
            told.append((entropy, size, np.array([names.index(languages[i]) for i in back])))
    if told:
        entropy, size, own = (np.concatenate(x) for x in zip(*told))
        mine = entropy[np.arange(len(own)), own]
        final.sharpness = min((float(s) for s in np.geomspace(0.5, 64, 15)), key=lambda s: float(np.mean(np.log(np.exp(-s * (entropy - mine[:, None])).sum(axis=1)))))
        right = entropy.argmin(axis=1) == own
        if right.any():
            final.limits = _limits(mine[right], size[right], own[right], len(names), false_rejections)
    return final


def _limits(entropy: np.ndarray, size: np.ndarray, own: np.ndarray, languages: int, false_rejections: float, tail: float = 0.05, few: int = 20) -> Limits:
    """Limits from held-back texts.

    The centre of a language with few of them is uncertain: its limit is wider, as if the common spread had been found in ``few`` texts.  A language without any is
    measured from the strangest text of all.
    """
    many = np.bincount(own, minlength=languages)
    centres = np.bincount(own, entropy * size, languages) / np.maximum(np.bincount(own, size, languages), 1)
    away = entropy - centres[own]
    short = size <= np.quantile(size, 0.3)
    within = math.sqrt(float(np.mean(away[short] ** 2 * size[short])))
    between = math.sqrt(float(np.mean(away[~short] ** 2))) if not short.all() else within / math.sqrt(float(size.mean()))
    within, between = max(within, 1e-3), max(between, 1e-3)
    far = away / np.sqrt(between**2 + within**2 / size)
    begin = float(np.quantile(far, 1 - tail))
    beyond = far[far > begin]
    excess = float(np.mean(beyond - begin)) if len(beyond) else 1.0
    centres[many == 0] = entropy.max()
    return Limits(centres, between, within, (begin + excess * math.log(tail / false_rejections)) * np.sqrt(1 + few / np.maximum(many, 1)))


def _fit(texts: list[str | None], languages: list[str], names: list[str]) -> Model:
    alphabet = len(np.unique(np.concatenate([_keys(characters([t])[0], 1) for t in texts] + [np.zeros(1, np.uint64)])))
    of: dict[str, list[str | None]] = {name: [] for name in names}
    for text, name in zip(texts, languages):
        of[name].append(text)
    return Model([_fit_part(of, names[lo : lo + TOGETHER], alphabet) for lo in range(0, len(names), TOGETHER)])


def _fit_part(of: dict[str, list[str | None]], names: list[str], alphabet: int) -> _Part:
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by language and order: n-grams with how often (or after how many different characters) they occur
    for name in names:
        codes, bounds = characters(of[name])
        real = np.ones(len(codes), dtype=bool)
        real[(bounds[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
        top = np.unique(_keys(codes, ORDER)[real[ORDER - 1 :]], return_counts=True)
        by = [top]
        for n in range(ORDER - 1, 0, -1):
            by.append(np.unique(by[-1][0] & np.uint64((1 << (16 * n)) - 1), return_counts=True))
        counts.append(by[::-1])
    grams = [np.unique(np.concatenate([c[n][0] for c in counts] + [np.zeros(1, np.uint64)])) for n in range(ORDER)]
    contexts = [np.unique(np.concatenate([c[n][0] >> _BITS for c in counts] + [np.zeros(1, np.uint64)])) for n in range(1, ORDER)]
    logs = [np.zeros((len(names), len(g)), np.float32) for g in grams]
    weights = [np.zeros((len(names), len(c)), np.float32) for c in contexts]
    floor = np.zeros(len(names))
    for k, by in enumerate(counts):
        below = np.full(1, 1 / (alphabet + 1))  # of each gram of the order before; of any character at first
        for n, (key, count) in enumerate(by):
            once, twice = int((count == 1).sum()), int((count == 2).sum())
            discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
            context, where, kinds = np.unique(key >> _BITS, return_inverse=True, return_counts=True) if n else (np.zeros(1, np.uint64), np.zeros(len(key), np.int64), np.array([len(key)]))
            total = np.bincount(where, count, len(context)).astype(float)
            share = np.divide(discount * kinds, total, out=np.ones(len(total)), where=total > 0)
            if n:
                given = np.ones(len(contexts[n - 1]))
                if len(context):
                    at, hit = _find(context, contexts[n - 1])
                    given[hit] = share[at[hit]]
                weights[n - 1][k] = np.log(given)
                spot = np.searchsorted(contexts[n - 1], grams[n] >> _BITS)
                under = below[np.searchsorted(grams[n - 1], grams[n] & np.uint64((1 << (16 * n)) - 1))]
                prob = given[spot] * under
            else:
                floor[k] = np.log(share[0] * below[0])
                prob = np.full(len(grams[0]), share[0] * below[0])
            prob[np.searchsorted(grams[n], key)] += np.maximum(count - discount, 0) / total[where]
            logs[n][k], below = np.log(prob), prob
    return _Part(names, grams, logs, contexts, weights, floor)


def drawn_rows(docs: DataFrame, most_per_language: int, most_languages: int = 1000) -> DataFrame:
    """About twice as many labelled rows of each language as are wanted, those with the smallest hash; all of a rarer language."""
    labelled = docs.filter("__lang IS NOT NULL AND __text IS NOT NULL AND NOT held_out").withColumn("__draw", (F.xxhash64(F.col("doc_id"), F.lit(17)) / F.lit(2.0**64)) + 0.5)
    shares = labelled.groupBy("__lang").agg((F.lit(2.0 * most_per_language) / F.count("*")).alias("__share"))
    known = shares.limit(most_languages + 1).collect()
    drawn = "__draw <= __share OR __share >= 1"
    if len(known) <= most_languages:  # few enough to travel to the texts
        return labelled.join(F.broadcast(docs.sparkSession.createDataFrame(known, shares.schema)), "__lang").filter(drawn).drop("__share")
    picked = labelled.select("doc_id", "__lang", "__draw").join(shares, "__lang").filter(drawn).select("doc_id", "__lang").distinct()  # the draw without texts
    return labelled.join(picked, ["doc_id", "__lang"], "left_semi")


def training_rows(docs: DataFrame, most_per_language: int, most_chars: int) -> DataFrame:
    """At most so many rows of each language, those with the smallest hash, and not beyond so many characters together but for the first."""
    few = drawn_rows(docs, most_per_language)
    by_draw = Window.partitionBy("__lang").orderBy("__draw", "doc_id", "__text")
    few = few.withColumn("__nth", F.row_number().over(by_draw)).filter(F.col("__nth") <= most_per_language)
    few = few.withColumn("__chars", F.sum(F.length("__text")).over(by_draw.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return few.filter((F.col("__chars") <= most_chars) | (F.col("__nth") == 1)).select("__text", "__lang", "__nth")


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_per_language: int = 300, most_chars: int = 4_000_000, **how) -> Model | None:
    """A model of the labelled rows that are not held out.

    A bounded sample reaches the driver: at most ``most_per_language`` whole texts of each language, drawn by a hash of their id, and at most ``most_chars`` characters of each
    language, but for one text that is longer.
    """
    rows = training_rows(_prepared(docs, id_col, text_col, lang_col), most_per_language, most_chars).collect()
    rows.sort(key=lambda r: (r["__nth"], r["__lang"]))
    return train([r["__text"] for r in rows], [r["__lang"] for r in rows], **how)


def _prepared(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"), held.alias("held_out"))


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", batch_chars: int = 1 << 18, **how) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score, cross_entropy, rejected``.

    A null text, a text without a letter, and any text if there is nothing to learn from is ``und`` with score 0, and rejected.
    Otherwise the score is the winner's share of the probability, sharpened as the held-back texts ask for; ``rejected`` tells
    that even the best model finds the text stranger than its language's held-back texts are but for a share of ``false_rejections``, so a text that is
    not rejected may still be of an unknown language.  Ties go to the first language by code point.
    A text of any length is read whole; repeated rows are told alike, and a null id counts as held out.  Other columns play no part, whatever their names.
    An empty table has no rows.  The model has a few megabytes for a few languages (bounded by the sample) and goes to each worker once.
    """
    if model is None:
        model = fit(docs, id_col, text_col, lang_col, **how)
    model = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = [(doc, h, *told) for doc, h, told in zip(ids, held, _predictions(model.value, batch.column(1), batch_chars))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RESULT.types)], schema=_RESULT)

    return _prepared(docs, id_col, text_col, lang_col).select("doc_id", "__text", "held_out").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def _predictions(model: Model | None, texts: list[str | None] | pa.Array, batch_chars: int) -> Iterator[tuple[str, float, float | None, bool]]:
    """(language, score, cross-entropy, rejected) of each text; of a column only some texts are in memory as strings at a time."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    offsets = np.concatenate(([0], np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    for lo, hi in row_groups(offsets, batch_chars):
        some = column.slice(lo, hi - lo).to_pylist()
        entropy, size = model.entropies(some) if model else (None, np.zeros(hi - lo))
        for i in range(hi - lo):
            if size[i] <= 0:
                yield "und", 0.0, None, True
                continue
            k = int(entropy[i].argmin())
            score = 1 / float(np.exp(-model.sharpness * (entropy[i] - entropy[i, k])).sum())
            yield model.languages[k], score, float(entropy[i, k]), not model.accepts(k, float(entropy[i, k]), int(size[i]))


def accepted_documents(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", batch_chars: int = 1 << 18, **how) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with ``lang_col`` set to the prediction; the columns stay, whatever else they are named.

    Rows whose text is null, empty or without a letter go, as do those that ``identify`` rejects; with nothing to learn from, all go.  Repeated rows stay or go together.
    """
    if model is None:
        model = fit(docs, id_col, text_col, lang_col, **how)
    model = docs.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = list(_predictions(model.value, batch.column(text_at), batch_chars))
            arrays = list(batch.columns)
            arrays[lang_at] = pa.array([t[0] for t in told], batch.schema.field(lang_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array([not t[3] for t in told], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
