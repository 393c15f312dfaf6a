"""Words of texts as hashes, with numpy, a bounded block of bytes at a time.

A word's hash is a polynomial over a table of random numbers, one for each byte value, taken from prefix
sums modulo 2 ** 64; a mixing step follows. Hashes depend on the seed only, so they agree between tasks
and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once.
BLOCK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(7_331))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(int(_rng.integers(1, 1 << 61)) * 8 + 5)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_STEP = U(int(_rng.integers(1, 1 << 61)) * 8 + 3)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xA0761D6478BD642F)
    h ^= h >> U(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, BLOCK + 4096)
        up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _powers


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words; lower: A-Z count as a-z."""

    inside: np.ndarray
    lower: bool = True

    def values(self) -> np.ndarray:
        v = _VALUES.copy()
        if self.lower:
            v[65:91] = v[97:123]
        return v


def alphabet(separators: list[tuple[int, int]], lower: bool = True) -> Alphabet:
    """All bytes but those in the ranges, ends included. A-Z are inside if they are lower-cased to a-z that are."""
    inside = np.ones(256, bool)
    for a, b in separators:
        inside[a : b + 1] = False
    if lower:
        inside[65:91] = inside[97:123]
    return Alphabet(inside, lower)


#: Fixed values of the contracts: words between white space, and words of letters, digits and non-ASCII.
SPACED = alphabet([(0x20, 0x20), (0x09, 0x0D)])
SPACED_AS_IS = alphabet([(0x20, 0x20), (0x09, 0x0D)], lower=False)
ALNUM = alphabet([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def spans(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    m = inside[buf]
    turn = np.flatnonzero(m[1:] != m[:-1]) + 1
    if len(m) and m[0]:
        turn = np.concatenate(([0], turn))
    if len(m) and m[-1]:
        turn = np.concatenate((turn, [len(m)]))
    return turn[0::2], turn[1::2]


def hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash for each word."""
    up, down = powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, U)
    total[0] = 0
    np.cumsum(values[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def pieces(text: bytes, inside: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(offset, piece) of a long text, cut between words; a word is never cut."""
    at, n = 0, len(text)
    while at < n:
        to = min(n, at + BLOCK)
        while to < n:
            m = inside[np.frombuffer(text, np.uint8, to - at, at)]
            last = np.flatnonzero(~m)
            if len(last):
                to = at + int(last[-1]) + 1
                break
            to = min(n, to + BLOCK)
        yield at, text[at:to]
        at = to


@dataclass
class Words:
    """Words of consecutive texts. first: of each text's words, and their number in all."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray | None = None  # in each text, if asked for
    ends: np.ndarray | None = None


def words(texts: list[bytes], of: Alphabet, places: bool = False) -> Iterator[tuple[int, Words]]:
    """(number of the first text, words) for blocks of whole texts, in order. ``texts`` holds no None."""
    values, k = of.values(), 0
    while k < len(texts):
        if len(texts[k]) > BLOCK:
            got = []
            for at, piece in pieces(texts[k], of.inside):
                buf = np.frombuffer(piece, np.uint8)
                s, e = spans(buf, of.inside)
                got.append((hashed(buf, s, e, values), s + at, e + at))
            h = np.concatenate([g[0] for g in got])
            s, e = (np.concatenate([g[i] for g in got]) for i in (1, 2)) if places else (None, None)
            yield k, Words(h, np.array([0, len(h)]), s, e)
            k += 1
            continue
        to, size = k, 0
        while to < len(texts) and size + len(texts[to]) <= BLOCK:
            size += len(texts[to]) + 1
            to += 1
        block = texts[k:to]
        buf = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
        offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in block])))
        s, e = spans(buf, of.inside)
        first = np.searchsorted(s, offset)
        h = hashed(buf, s, e, values)
        if places:
            shift = np.repeat(offset[:-1], np.diff(first))
            yield k, Words(h, first, s - shift, e - shift)
        else:
            yield k, Words(h, first)
        k = to


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, U)
    total = h[:n].copy()
    for j in range(1, size):
        total *= _STEP
        total += h[j : j + n]
    return mix(total + U(size))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
