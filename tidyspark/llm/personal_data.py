"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and identifier cues.  Around each anchor a
deterministic parser looks for the bounds of an address, number or account and validates it.  The parsers of the base kinds
(email, ip, card, phone) find what leftmost, non-overlapping matches of their patterns would:

* an email is found from its at-sign: its local part is the run of local characters before it, back to the last match;
* dotted and grouped digit runs are parsed from the first digit of a run;
* a phone number is parsed from its plus sign.

Added kinds: ``iban`` (checked modulo 97), ``ssn``, ``account`` (a number behind a cue), ``secret`` (a value behind a cue, or a
key of a known form), ``url`` (with user and password), ``masked_email`` (``name [at] host [dot] org``), and ``card_inside`` and
``phone_inside``: numbers that stand whole inside a longer run of digit groups, which the base patterns drop.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "account", "secret", "url", "masked_email", "card_inside", "phone_inside")
_NTH = {k: i for i, k in enumerate(KINDS)}
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CARD_INSIDE = re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])")
_PHONE_INSIDE = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?|id))?\x20?[#:=]?\x20?([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)
_SECRET = re.compile(r"\x20{0,2}[:=]\x20{0,2}(?:([\"'])([^\"'\s]{8,}+)\1|([A-Za-z0-9_\-/+=.]{12,}+))")
_CLOUD_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Z0-9])")
_USER_INFO = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
_MASKED = re.compile(r"\x20?([A-Za-z0-9-]+(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]+)+)", re.IGNORECASE)

#: Anchors by what parses them.
_ANCHORS = {
    "email": ("@",), "plus": ("+",), "digit": tuple("0123456789"), "url": ("://",), "masked": ("[at]", "(at)"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key"), "cloud": ("akia",), "account": ("account", "acct", "konto", "cuenta", "compte"),
}
_automaton: list = []


def _anchors():
    if not _automaton:
        import ahocorasick

        found = ahocorasick.Automaton()
        for kind, cues in _ANCHORS.items():
            for cue in cues:
                found.add_word(cue, (kind, len(cue)))
        found.make_automaton()
        _automaton.append(found)
    return _automaton[0]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find(text: str | None) -> list[Span]:
    """All spans (start, end, kind) in code points, by start and then kind."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few capitals have longer lower-case forms; places have to stay
        low = "".join(c.lower() if c.isascii() else c for c in text)
    out: list[Span] = []
    done = dict.fromkeys((*KINDS, "digit"), 0)

    def put(kind: str, start: int, end: int) -> None:
        done[kind] = end
        out.append((start, end, kind))

    for at, (kind, width) in _anchors().iter(low):
        start = at - width + 1
        if kind == "digit":
            if start and text[start - 1] in "0123456789" and start - 1 >= 0:
                continue  # not the first of its run
            if start >= done["ip"] and (m := _IP.match(text, start)):
                done["ip"] = m.end()
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    out.append((start, m.end(), "ip"))
            if start >= done["card"] and (m := _CARD.match(text, start)):
                done["card"] = m.end()
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((start, m.end(), "card"))
                elif len(digits) > 14:
                    out += [(start + i.start(), start + i.end(), "card_inside") for i in _CARD_INSIDE.finditer(m[0]) if luhn(_NOT_DIGIT.sub("", i[0]))]
            if start >= done["ssn"] and not (start and text[start - 1] in "-.") and (m := _SSN.match(text, start)) and m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000":
                put("ssn", start, m.end())
            if start - 2 >= done["iban"] and text[start - 2 : start].isupper() and not text[start - 3 : start - 2].isalnum() and (m := _IBAN.match(text, start - 2)):
                packed = m[0].replace(" ", "")
                if _iban_valid(packed):
                    put("iban", start - 2, m.end())
        elif kind == "email":
            left = start
            while left > done["email"] and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (m := _DOMAIN.match(text, start + 1)):
                put("email", left, m.end())
        elif kind == "plus":
            if m := _PHONE.match(text, start):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    put("phone", start, m.end())
                elif (m := _PHONE_INSIDE.match(text, start)) and 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    put("phone_inside", start, m.end())
        elif kind == "url":
            left = start
            while left and text[left - 1].isascii() and text[left - 1].isalnum():
                left -= 1
            if left < start and left >= done["url"] and (m := _USER_INFO.match(text, start + 3)):
                put("url", left, m.end())
        elif kind == "masked":
            stop = start - 1 if start and text[start - 1] == " " else start
            left = stop
            while left > done["masked_email"] and text[left - 1] in _LOCAL:
                left -= 1
            if left < stop and (m := _MASKED.match(text, at + 1)):
                put("masked_email", left, m.end())
        elif kind == "secret":
            if start >= done["secret"] and (m := _SECRET.match(text, at + 1)):
                put("secret", *m.span(2 if m[2] else 3))
        elif kind == "cloud":
            if start >= done["secret"] and text[start : at + 1] == "AKIA" and (m := _CLOUD_KEY.match(text, at + 1)):
                put("secret", start, m.end())
        elif kind == "account" and start >= done["account"] and (m := _ACCOUNT.match(text, at + 1)):
            put("account", *m.span(1))
    out.sort(key=lambda s: (s[0], _NTH[s[2]], s[1]))
    return out


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    if not spans:
        return text
    out, last, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[last:start], f"[{kind.removesuffix('_inside').upper()}]"]
        last, i = end, i + 1
    return "".join(out) + text[last:]


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


_RESULT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("redacted", pa.string())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, redacted``.

    ``n_added`` counts the spans of other kinds than the four.  A null or empty text has no spans; a null text stays null when redacted.  A text of any length is read whole;
    rows with the same or a null id are documents of their own.  An empty table has no rows.  Other columns play no part, whatever their names.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = find(text)
                base = [s for s in spans if s[2] in BASE]
                counts = [sum(s[2] == k for s in base) for k in BASE]
                out.append((doc, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(spans), len(spans) - len(base), redact(text, spans) if with_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RESULT.types)], schema=_RESULT)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string")


def redacted_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with personal data replaced in the text; the columns and the rows stay, ``n_chars`` follows the text.

    Null texts stay null and empty ones empty; texts of any length are read whole; repeated rows stay, each redacted alike; an empty table stays empty.  Other columns may have any names.
    """
    columns = docs.columns
    place = columns.index(text_col)
    count = columns.index(chars_col) if chars_col in columns else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            spans = [find(t) for t in texts]
            arrays = list(batch.columns)
            if any(spans):
                new = [redact(t, s) for t, s in zip(texts, spans)]
                arrays[place] = pa.array(new, batch.schema.field(place).type)
                if count is not None:
                    old = arrays[count].to_pylist()
                    arrays[count] = pa.array([len(n) if s else o for n, s, o in zip(new, spans, old)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(rows, docs.schema)
