"""Content digests as lower-case hex.

md5, sha1, sha2 and xxhash64 run in the JVM; the other algorithms of hashlib through an Arrow UDF.  A cryptographic digest with ``-chain`` after its
name can be taken up where an earlier reader stopped: the stages of the sieve read each byte of a file once with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NATIVE = {
    "md5": lambda c: F.md5(c), "sha1": lambda c: F.sha1(c), "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512),
    "xxhash": lambda c: F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0")),
}
_HASHLIB = {"sha3-256": "sha3_256", "sha3-384": "sha3_384", "sha3-512": "sha3_512", "blake2b": "blake2b", "blake2s": "blake2s"}
_SYNONYMS = {"sha3": "sha3-256", "sha-1": "sha1", "sha-256": "sha256", "sha-512": "sha512"}
#: Known names without an implementation in this environment.
UNSUPPORTED = ("murmur", "metro", "metro256", "metrocrc", "metrocrc256", "highway", "highway64", "highway128", "highway256")
#: Parallel forms: hash, lanes, bytes of a block, bytes of the digest.  Fixed values.
_PARALLEL = {"blake2bp": (hashlib.blake2b, 4, 128, 64), "blake2sp": (hashlib.blake2s, 8, 64, 32)}
ALGORITHMS = (*_NATIVE, *_HASHLIB, *_PARALLEL, "paranoid", "cumulative", "ext")
#: Ending of a chained digest's name, the digests that can be chained, and the bytes at which their links end.
CHAIN, CHAINABLE = "-chain", (*(name for name in _NATIVE if name != "xxhash"), *_HASHLIB)
LINKS = (1 << 14, 1 << 20, 1 << 26)
#: From -PPP to -ppp: the digest for each level of caution.
LANES = 8  # words of eight bytes in the cumulative digest
LEVELS = {-3: "xxhash", -2: "xxhash", -1: "sha256", 0: "blake2b", 1: "paranoid", 2: "paranoid"}


def canonical_name(name: str) -> str:
    low = name.lower()
    chained, low = low.endswith(CHAIN), low.removesuffix(CHAIN)
    low = _SYNONYMS.get(low, low)
    if chained and low in CHAINABLE:
        return low + CHAIN
    if low in ALGORITHMS and not chained:
        return low
    raise ValueError(f"{name} has no implementation here" if low in UNSUPPORTED else f"unknown digest {name}")


def level(steps: int) -> str:
    """The digest after so many steps up (positive) or down (negative) in caution."""
    return LEVELS[max(min(LEVELS), min(max(LEVELS), steps))]


def digest(content: Column, algorithm: str = "sha256") -> Column:
    """Digest of a string (its UTF-8 bytes) or binary column; null stays null.  ``paranoid`` is the content itself."""
    name = canonical_name(algorithm)
    raw = content.cast("binary")
    if name in _NATIVE:
        return F.when(content.isNotNull(), _NATIVE[name](raw))
    if name == "paranoid":
        return raw
    if name == "cumulative":
        return cumulative(raw)
    if name == "ext":
        return F.lower(content.cast("string"))
    if name.removesuffix(CHAIN) in _NATIVE:
        return F.when(content.isNotNull(), chained(raw, name.removesuffix(CHAIN)))

    def whole(value: memoryview) -> str:
        state = new_state(name)
        state.update(value)
        return state.hexdigest()

    return _each(raw, whole)


def chained(raw: Column, name: str) -> Column:
    """The chained form of a digest of the JVM: a link for each range that the content reaches."""
    link, length = _NATIVE[name](F.substring(raw, 1, LINKS[0])), F.octet_length(raw)
    for low, high in zip(LINKS, (*LINKS[1:], (1 << 31) - 1)):
        link = F.when(length > low, _NATIVE[name](F.concat(link.cast("binary"), F.substring(raw, low + 1, high - low)))).otherwise(link)
    return link


def xor_words(raw: bytes) -> str:
    state = _Words()
    state.update(raw)
    return state.hexdigest()


def cumulative(raw: Column) -> Column:
    """Exclusive or of the content's 64-byte stretches, the last one filled with zeros: independent of the order of stretches."""
    return _each(raw, lambda value: xor_words(bytes(value)))


def _each(raw: Column, told: Callable[[memoryview], str]) -> Column:
    """A text for each binary value.  The values are read where they lie in their batch, one at a time, so that a task holds one batch and no copy of it."""

    @F.arrow_udf(StringType())
    def found(values: pa.Array) -> pa.Array:
        return pa.array((told(memoryview(v.as_buffer())) if v.is_valid else None for v in values), pa.string())

    return found(raw)


class _Words:
    """The cumulative digest of a content that comes in chunks."""

    def __init__(self):
        self.lanes, self.rest = np.zeros(LANES, np.uint64), b""

    def update(self, chunk: bytes) -> None:
        raw = self.rest + chunk
        whole = len(raw) - len(raw) % (8 * LANES)
        if whole:
            self.lanes ^= np.bitwise_xor.reduce(np.frombuffer(raw[:whole], ">u8").reshape(-1, LANES), axis=0).astype(np.uint64)
        self.rest = raw[whole:]

    def hexdigest(self) -> str:
        last = np.frombuffer(self.rest + b"\0" * (8 * LANES - len(self.rest)), ">u8").astype(np.uint64)
        return "".join(f"{x:016x}" for x in (self.lanes ^ last).tolist())


class _Lanes:
    """A tree of two levels: blocks go to the leaves in turn, and the root hashes the leaves' digests."""

    def __init__(self, make, lanes: int, block: int, size: int):
        self._block, self._rest, self._size = block, b"", size
        self._node = lambda **place: make(digest_size=size, fanout=lanes, depth=2, inner_size=size, **place)
        self._leaves = [self._node(node_offset=k, node_depth=0, last_node=k == lanes - 1) for k in range(lanes)]

    def update(self, chunk: bytes) -> None:
        raw, step = self._rest + chunk, self._block * len(self._leaves)
        whole = len(raw) - len(raw) % step
        if whole:
            blocks = np.frombuffer(raw[:whole], np.uint8).reshape(-1, len(self._leaves), self._block)
            for k, leaf in enumerate(self._leaves):
                leaf.update(blocks[:, k].tobytes())
        self._rest = raw[whole:]

    def hexdigest(self) -> str:
        root = self._node(node_offset=0, node_depth=1, last_node=True)
        for k, leaf in enumerate(self._leaves):
            last = leaf.copy()
            last.update(self._rest[k * self._block : (k + 1) * self._block])
            root.update(last.digest())
        return root.hexdigest()


class _Chain:
    """A digest that can be taken up again: each link is the digest of the last link's hex digits and of its own range, and the last link stands for the content.

    Ranges end at ``LINKS``, so a content up to the first of them has the plain digest.  ``at`` and ``link`` say how far an earlier reader came.
    """

    def __init__(self, name: str, at: int = 0, link: str = ""):
        self._name, self._at, self._link, self._state = name, at, link, None

    def update(self, chunk: bytes) -> None:
        chunk = memoryview(chunk)
        while chunk:
            if self._state is None:
                self._state = hashlib.new(_HASHLIB.get(self._name, self._name), self._link.encode())
            end = next((b for b in LINKS if b > self._at), None)
            part = chunk if end is None else chunk[: end - self._at]
            self._state.update(part)
            self._at += len(part)
            chunk = chunk[len(part) :]
            if self._at == end:
                self._link, self._state = self._state.hexdigest(), None

    def hexdigest(self) -> str:
        if self._state is None and self._at:
            return self._link
        return (self._state or hashlib.new(_HASHLIB.get(self._name, self._name))).hexdigest()


def new_state(algorithm: str, at: int = 0, link: str = ""):
    """An object with ``update`` and ``hexdigest``; of a chained digest it goes on at byte ``at``, one of ``LINKS``, with the link that ends there."""
    name = canonical_name(algorithm)
    if name.endswith(CHAIN):
        return _Chain(name.removesuffix(CHAIN), at, link)
    if name == "cumulative":
        return _Words()
    if name in _PARALLEL:
        return _Lanes(*_PARALLEL[name])
    if name == "xxhash":
        import xxhash

        return xxhash.xxh64(seed=42)  # the seed of the column function
    return hashlib.new(_HASHLIB.get(name, name))


def streamed(chunks, algorithm: str = "blake2b") -> str:
    """Digest of a content that comes in chunks; equals the digest of the whole."""
    state = new_state(algorithm)
    for chunk in chunks:
        state.update(chunk)
    return state.hexdigest()
