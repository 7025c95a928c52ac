"""Whole batches of text as flat code-point arrays.

Per-character Python loops are what makes text work slow; these helpers let an
operator treat a batch of documents as one numpy array with document offsets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

#: Characters handled at once; bounds the scratch arrays of a worker.
CHUNK_CHARS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most limit characters each (a longer text stands alone)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def flatten(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row (uint32), and the offsets of each text."""
    texts = [t or "" for t in texts]
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), off


def _table(fn) -> np.ndarray:
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000:
            out[i] = fn(chr(i))
    return out


@cache
def lower_letters() -> np.ndarray:
    """Code point -> lower-case letter, 0 for anything that is no letter."""
    return _table(lambda c: ord(c.lower()[0]) if c.isalpha() else 0)


@cache
def lower_word_chars() -> np.ndarray:
    """Code point -> lower-case letter or digit, 0 for anything else."""
    return _table(lambda c: ord(c.lower()[0]) if c.isalnum() else 0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    p, q = np.full(n, _ODD, np.uint64), np.full(n, inverse, np.uint64)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit content hash of each slice values[start:end], whatever its place."""
    size = 1 << max(20, int(len(values)).bit_length())
    p, q = _powers(size)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that never cross a text's border."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.empty(len(mask), bool)
    begins[0] = mask[0]
    np.greater(mask[1:], mask[:-1], out=begins[1:])
    ends = np.empty(len(mask), bool)
    ends[-1] = mask[-1]
    np.greater(mask[:-1], mask[1:], out=ends[:-1])
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(mask))]
    begins[edges] = mask[edges]
    ends[edges - 1] = mask[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1
