"""Numpy kernels over the bytes of a block of texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Fixed values of the hashes: an odd base and its inverse modulo 2**64, and the mixer's constants.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = h ^ (h >> U(30))
    h *= MIX_1
    h ^= h >> U(27)
    h *= MIX_2
    h ^= h >> U(31)
    return h


@lru_cache(maxsize=None)
def byte_values(seed: int) -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * U(BASE) + U(seed))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}
#: Powers of a base that a worker keeps: those of its usual blocks.
KEPT = 1 << 21


def powers(n: int, base: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64, kept up to a block's size."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _powers(max(n, 1 << 16), base)
        if n <= KEPT:
            _POWERS[base] = have
    return have[:n]


class Sums:
    """Hash of any byte range of a block in constant time (polynomial prefix sums modulo 2**64)."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.n = len(data)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(byte_values(seed)[data] * powers(self.n, BASE), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * powers(self.n + 1, INVERSE)[start]
        return mix(raw + (end - start).astype(np.uint64) * MIX_1)


def joined(texts: list[str], gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with ``gap`` zero bytes before each; first and last offset of each text.

    With a gap, what is before a text in the block never shows in a window of up to ``gap`` bytes.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(sizes + gap) - sizes
    return np.frombuffer(b"\0" * gap + (b"\0" * gap).join(raw), np.uint8), starts, starts + sizes


def ranges_within(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


#: White space of words: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Kinds of bytes: 0 white space, 1 letters and all of non-ASCII, 2 digits, 3 the rest.
KIND = np.full(256, 3, np.uint8)
KIND[SPACE] = 0
KIND[48:58] = 2
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def words(texts: list[str], seed: int = 0, by_kind: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every word, A-Z lower-cased.

    A word is a run of bytes that are no white space; with ``by_kind``, a run of one kind of bytes.
    """
    data, first, _ = joined([*texts, ""], 1)
    data = LOWER[data]
    kind = KIND[data] if by_kind else (~SPACE[data]).astype(np.uint8)
    kind[first - 1] = 0  # the gaps
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edges = np.append(edge, len(data))
    starts = edge[kind[edge] != 0]
    ends = edges[1:][kind[edge] != 0]
    return Sums(data, seed).of(starts, ends), np.searchsorted(first, starts, "right") - 1
