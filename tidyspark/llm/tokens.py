"""Token ids of whole Arrow columns for tokenizers that never join two white-space separated words.

Every different word is tokenised once and kept in a bounded cache of sorted hash arrays; texts are then assembled
from the cache by vectorised gathers.  Only tokenizers that drop white space qualify (``word_bpe_49k``): for them the
ids of a text are the ids of its words, one after the other.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .wordarrays import words

_LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")  # letters of Latin-1, whose NFC and lower case are themselves in Latin-1


def _byte_characters() -> list[str]:
    """The character that byte-level tokenizers use for each byte: itself if printable in Latin-1, else one from 256 on."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    return [chr(b) if ok else chr(256 + sum(not x for x in shown[:b])) for b, ok in enumerate(shown)]


class WordEncoder:
    """Not thread-safe; one per Python worker."""

    _kept: dict[tuple[str, bool], WordEncoder] = {}

    @classmethod
    def of(cls, path: str, control_ids: bool = False) -> WordEncoder:
        key = (path, control_ids)
        if key not in cls._kept:
            cls._kept[key] = cls(path, control_ids=control_ids)
        return cls._kept[key]

    def __init__(self, path: str, most_words: int = 400_000, control_ids: bool = False):
        """``control_ids``: a special token that a text spells out becomes its id, as the tokenizer does by default; otherwise it is ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_words = Tokenizer.from_file(path), most_words
        self.tokenizer.encode_special_tokens = not control_ids
        self.model = self.tokenizer.model
        self.as_bytes = str.maketrans(dict(enumerate(_byte_characters())))
        self.marks = {m: self.slow(m) for m in (".", ",")}
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.count, self.flat, self.filled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0
        self.hits = np.zeros(0, np.int64)
        self.stems: dict[str, list[int]] = {}

    def shrink(self) -> None:
        """Keep the words that more batches had than the median word."""
        kept = np.flatnonzero(self.hits > np.median(self.hits))
        number = np.full(len(self.hits), -1)
        number[kept] = np.arange(len(kept))
        alive = number[self.slot] >= 0
        begin, count = self.begin[kept], self.count[kept]
        ends = np.cumsum(count)
        self.filled = int(ends[-1]) if len(ends) else 0
        self.flat = np.append(self.flat[np.arange(self.filled) + np.repeat(begin - (ends - count), count)], np.uint32(0))
        self.keys, self.slot = self.keys[alive], number[self.slot[alive]]
        self.begin, self.count, self.hits = ends - count, count, np.zeros(len(kept), np.int64)

    def slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, raw: bytes) -> list[int]:
        text = raw.decode()
        if not (simple := _LATIN.fullmatch(text)):
            return self.slow(text)
        stem = simple[1].lower()
        ids = self.stems.get(stem)
        if ids is None:
            if len(self.stems) > 100_000:
                self.stems.clear()
            mapped = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.as_bytes)
            ids = self.stems[stem] = [t.id for t in self.model.tokenize(mapped)]
        return ids + self.marks[simple[2]] if simple[2] else ids

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        found = [self.word(x) for x in raw]
        count = np.fromiter(map(len, found), np.int64, len(found))
        need = self.filled + int(count.sum())
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        self.flat[self.filled : need] = [i for ids in found for i in ids]
        self.begin = np.concatenate([self.begin, self.filled + np.cumsum(count) - count])
        self.count, self.filled = np.concatenate([self.count, count]), need
        self.hits = np.concatenate([self.hits, np.zeros(len(count), np.int64)])
        keys, slot = np.concatenate([self.keys, keys]), np.concatenate([self.slot, np.arange(len(self.count) - len(count), len(self.count))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], slot[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, each followed by ``end_id``; and where each row's ids begin."""
        w = words(data, offsets)
        rows = len(offsets) - 1
        keys, first, where = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most_words and len(self.keys):
            self.shrink()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), dtype=bool)
        if new.any():
            text = data.tobytes()
            self._learn(keys[new], [text[s:e] for s, e in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist())])
            at = np.searchsorted(self.keys, keys)
        self.hits[self.slot[at]] += 1
        slot = self.slot[at][where] if len(keys) else np.zeros(0, np.int64)
        count = self.count[slot]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.begin[slot] - (ends - count), count)]
        bounds = np.concatenate(([0], ends))[w.first]
        if end_id is None:
            return ids, bounds
        out, inner = np.full(total + rows, end_id, np.uint32), np.ones(total + rows, dtype=bool)
        inner[bounds[1:] + np.arange(rows)] = False
        out[inner] = ids
        return out, bounds + np.arange(rows + 1)
