"""Words and their hashes over Arrow buffers, in numpy."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed at once; a longer text is taken alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ups = np.full(size, _BASE, np.uint64)
    downs = np.full(size, _INVERSE, np.uint64)
    ups[0] = downs[0] = 1
    return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of running sums, and of its inverse: at least ``size`` of each."""
    return _powers(max(CHUNK + (1 << 16), 1 << size.bit_length()))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and its n + 1 offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Ranges of texts of about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, i: int, j: int):
    """Of texts i to j: start and end of each word in the chunk's bytes, its text's number, and the lower-cased bytes.

    Words are runs without the ASCII white space 0x20, 0x09-0x0D; only A-Z are lower-cased.
    """
    low = _LOWER[data[offsets[i] : offsets[j]]]
    gap = np.ones(len(low) + 2, bool)
    gap[1:-1] = _SPACE[low]
    edge = offsets[i : j + 1] - offsets[i]
    # a word also ends where its text does
    inner = edge[1:-1]
    change = gap[1:] != gap[:-1]
    starts = np.flatnonzero(change[:-1] & ~gap[1:-1])
    ends = np.flatnonzero(change[1:] & ~gap[1:-1]) + 1
    if len(inner):
        inner = np.unique(inner[(inner > 0) & (inner < len(low))])
        cut = inner[~gap[inner] & ~gap[inner + 1]]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    doc = np.searchsorted(edge, starts, "right") - 1
    return starts, ends, doc, low


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from one running polynomial sum over the chunk."""
    up, down = powers(len(low))
    run = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts])


def shingle_hashes(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int):
    """Yields for each text the sorted distinct hashes of its runs of ``width`` words.

    A shorter text has one, of all its words; a text without words none.
    """
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    n = max(0, len(hashes) - width + 1)
    each = np.zeros(n, np.uint64)
    for k in range(width):
        each = mix(each + hashes[k : k + n])
    for d in range(n_docs):
        a, b = bounds[d], bounds[d + 1]
        if b - a >= width:
            yield np.unique(each[a : b - width + 1])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in hashes[a:b]:
                h = mix(h + w)
            yield h
        else:
            yield np.zeros(0, np.uint64)
