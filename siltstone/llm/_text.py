"""Vectorised word hashes over Arrow string columns.

A word is a maximal run of bytes outside `[\\x20\\x09-\\x0D]` in the UTF-8 text; those bytes never occur inside a
multi-byte character, so this equals the split by code points.  A word's hash is a Rabin-Karp polynomial of its bytes
modulo 2**64, mixed; a hash of consecutive words is again a polynomial, of the word hashes, read off prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64 bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, longer tables on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            out = []
            for b in (self.base, self.inv):
                p = np.full(size, b, U)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            if size > 1 << 22:  # a giant text: don't keep its tables
                return out[0], out[1]
            self.up, self.down = out
        return self.up, self.down


BYTES, WORDS, WORDS2 = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93), Powers(0xC2B2AE3D27D4EB4F)


def slices(col: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes; a longer text comes alone."""
    n, at = len(col), 0
    if not n:
        return
    o = offsets(col)
    while at < n:
        end = max(at + 1, int(np.searchsorted(o, o[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = end


def offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where each row starts and ends in them."""
    o = offsets(col)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return data, o - o[0]


def spans(data: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the number of words before it (one more than rows)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(o), np.int64)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = o[(o > 0) & (o < n)]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, o)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; spans are in order and do not overlap."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
        part = data[lo : ends[to - 1]]
        up, down = BYTES.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        at = to
    return out


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and for each row the number of words before it."""
    data, o = raw(col)
    starts, ends, ptr = spans(data, o)
    return span_hashes(data, starts, ends), ptr


def prefix(h: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial of h, and inverse powers: see run()."""
    up, down = powers.upto(len(h) + 1)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return sums, down


def run(sums: np.ndarray, down: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The hash of the sequence h[lo:hi], for arrays of lo and hi."""
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(U))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
