"""Word boundaries and hashes of words and word windows over UTF-8 bytes with numpy.

Texts are UTF-8 bytes, taken some at a time. Every separator of the word classes used
here is ASCII, so bytes of multi-byte characters are always word bytes and no
decoding is needed. A word's hash mixes eight bytes at a time, so each bit of it
depends on every byte; windows are put together from hashes of shorter ones, either
by the same mixer or as Rabin-Karp polynomials modulo a prime.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for word bytes: all but those in the given inclusive ranges."""
    out = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = False
    return out


#: [^\x20\x09-\x0D]+
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, which upper-case letters aren't in: lower-case first.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Longer words are hashed one by one.
_LONG = 256
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)
_PRIME, _FOLD = _U(2**31 - 1), _U(31)
#: Bases of the two polynomials.
_BASES = (1_270_633_057, 1_847_052_349)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def bounds(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of ``data`` (uint8)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = np.take(word, data)
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def spans_hash(raw: bytes | np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of given byte spans."""
    data = np.frombuffer(raw, dtype=np.uint8)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    with np.errstate(over="ignore"):
        out = length.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(0x2545F4914F6CDD1D)
        which, at = slice(None), starts
        for i in range(0, _LONG, 8):
            if i:
                which = np.flatnonzero(length > i) if i == 8 else which[length[which] > i]
                if not len(which):
                    return out
                at = starts[which] + i
            block = eights[at] & _MASK[np.minimum(length[which] - i, 8)]
            out[which] = mix(out[which] ^ block) + _U(0xD1342543DE82EF95)
    for i in which[length[which] > _LONG].tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def _doubled(one: np.ndarray, k: int, join) -> np.ndarray:
    """Values of all windows of k from those of single places; ``join(left, right, n)`` puts n places to the right."""
    out, have = one, 1
    for bit in bin(k)[3:]:
        out, have = join(out[:-have], out[have:], have), 2 * have
        if bit == "1":
            out, have = join(out[:-1], one[have:], 1), have + 1
    return out


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive words; none if there are fewer words."""
    if len(hashes) < k or k < 1:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return mix(_doubled(hashes, k, lambda x, y, _: mix(x * _U(0x9FB21C651E98DF25) + y)) + _U(k))


def rabin_karp(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of k consecutive words: two polynomials modulo 2**31 - 1, 62 bits."""
    if len(hashes) < k or k < 1:
        return np.zeros(0, dtype=np.uint64)

    def reduced(x: np.ndarray) -> np.ndarray:
        x = (x & _PRIME) + (x >> _FOLD)
        return (x & _PRIME) + (x >> _FOLD)

    def polynomial(coefficients: np.ndarray, base: int) -> np.ndarray:
        out = _doubled(reduced(coefficients), k, lambda x, y, n: reduced(x * _U(pow(base, n, 2**31 - 1)) + y))
        out[out == _PRIME] = 0
        return out

    high, low = polynomial(hashes >> _U(32), _BASES[0]), polynomial(hashes & _U(2**32 - 1), _BASES[1])
    return mix((high << _FOLD) | low)


class Chunk:
    """Words of some consecutive texts.

    Words of text i are those from ``at[i]`` to ``at[i + 1]``; ``starts`` and
    ``ends`` are byte offsets into ``raw``, where the texts stand as they were.
    """

    def __init__(self, parts: list[bytes], word: np.ndarray, lower: bool):
        self.raw = b" ".join(parts)
        data = np.frombuffer(self.raw, dtype=np.uint8)
        if lower:
            data = np.take(LOWER, data)
        self.starts, self.ends = bounds(data, word)
        first = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(x) + 1 for x in parts], out=first[1:])
        self.first = first
        self.at = np.searchsorted(self.starts, first)
        self.hashes = spans_hash(data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.at) - 1

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all k-word windows; first and end window of each text in them."""
        n = np.maximum(np.diff(self.at) - k + 1, 0)
        return windows(self.hashes, k), self.at[:-1], self.at[:-1] + n


def chunks(column: pa.Array | pa.ChunkedArray, word: np.ndarray, lower: bool, size: int = 1 << 19) -> Iterator[Chunk]:
    """The texts of a column, in order, some at a time: about ``size`` bytes, or one longer text."""
    parts: list[bytes] = []
    total = 0
    for x in texts(column):
        if parts and total + len(x) > size:
            yield Chunk(parts, word, lower)
            parts, total = [], 0
        parts.append(x)
        total += len(x) + 1
    if parts:
        yield Chunk(parts, word, lower)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The bytes of each text; none for null."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from texts(chunk)
        return
    if pa.types.is_null(column.type):
        yield from (b"" for _ in range(len(column)))
        return
    for x in column.cast(pa.large_binary()):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list array of numpy rows."""
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=ends[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
