"""Hashed n-gram indicators of whole texts, for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import _text as X

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SHAPE = _BYTES.copy()
SHAPE[97:123], SHAPE[128:], SHAPE[65:91], SHAPE[48:58] = ord("a"), ord("a"), ord("A"), ord("0")
#: For bare words: everything but letters, digits and bytes of multi-byte characters separates.
LETTER = (SHAPE == ord("a")) | (SHAPE == ord("A")) | (SHAPE == ord("0"))
BARE = np.where(LETTER, LOWER, 32).astype(np.uint8)


def _seed(k: int) -> np.uint64:
    return X.U(0xA0761D6478BD642F * (2 * k + 1) % 2**64)


def _grams(h: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive items within one document, and the document of each."""
    size = np.diff(ptr)
    doc = np.repeat(np.arange(len(size)), size)
    if n == 1 or len(h) < n:
        return (h if n == 1 else h[:0]), (doc if n == 1 else doc[:0])
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = X.mix(out * X.U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    same = doc[: len(out)] == doc[n - 1 :]
    return out[same], doc[: len(out)][same]


def indicators(parts: list[tuple[np.ndarray, np.ndarray]], docs: int, bits: int, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different buckets of each document and where each document's begin; parts: hashes and documents by kind; used: leave out other buckets."""
    keys = []
    for k, (h, doc) in enumerate(parts):
        bucket = X.mix(h ^ _seed(k)) >> X.U(64 - bits)
        if used is not None:
            some = used[bucket]
            bucket, doc = bucket[some], doc[some]
        keys.append(bucket | (doc.astype(X.U) << X.U(bits)))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, X.U)
    return (key & X.U((1 << bits) - 1)).astype(np.int32), np.searchsorted(key, np.arange(docs + 1, dtype=X.U) << X.U(bits))


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: letters by case, digits and signs, each run once ('Ab9##' is 'Aa0#')."""
    kind = SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    to = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=to[1:])
    return X.span_hashes(kind[keep], to[starts], to[ends])


def style(col: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words without regard to case, and one to three consecutive word shapes; a word that repeats the one before has a shape of its own."""
    data, o = X.raw(col)
    starts, ends, ptr = X.spans(data, o)
    word = X.span_hashes(LOWER[data], starts, ends)
    shape = shapes(data, starts, ends)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    first = ptr[:-1]
    again[first[first < len(word)]] = False
    shape[again] = X.U(77)
    return indicators([_grams(word, ptr, 1)] + [_grams(shape, ptr, n) for n in (1, 2, 3)], len(col), bits)


def bare(col: pa.Array, bits: int, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and digits without regard to case, and the first 5 to 10 bytes of those that are longer."""
    data, o = X.raw(col)
    data = BARE[data]
    starts, ends, ptr = X.spans(data, o)
    word, doc = _grams(X.span_hashes(data, starts, ends), ptr, 1)
    parts = [(word, doc)]
    for n in range(5, 11):
        long = ends - starts > n
        parts.append((X.span_hashes(data, starts[long], starts[long] + n), doc[long]))
    return indicators(parts, len(col), bits, used)


def by_doc(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of each document's values."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[ptr[1:]] - sums[ptr[:-1]]
