"""Vectorised text kernels over Arrow string buffers: words, 64-bit word hashes and shingles.

A text is its UTF-8 bytes. Words are maximal runs of bytes that are no separator, so multi-byte characters always belong
to words. Work goes through segments of about SEGMENT bytes, so memory follows the longest word, not the longest text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_V = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: True for the bytes between words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: True for every ASCII byte that is no letter or digit.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: 0 between words, 1 for letters, digits and every byte of other characters, 2 for ASCII symbols.
RUNS = np.where(SPACE, 0, np.where(NON_ALNUM, 2, 1)).astype(np.uint8)
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    m, v = np.full(n + 1, _M), np.full(n + 1, _V)
    m[0] = v[0] = 1
    return np.multiply.accumulate(m), np.multiply.accumulate(v)


def _cuts(raw: np.ndarray, space: np.ndarray) -> list[int]:
    """Ends of segments, each just after a separator or at the end."""
    cuts, at = [], 0
    while at < len(raw):
        end = min(at + SEGMENT, len(raw))
        while end < len(raw):
            gap = np.flatnonzero(space[raw[end : end + SEGMENT]])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end = min(end + SEGMENT, len(raw))
        cuts.append(end)
        at = end
    return cuts


def words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, lower: bool = True, prefix: int = 0, runs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word in order, words before each row (one more than rows), and the words' lengths in bytes.

    prefix: hash so many first bytes of a word only. runs: space is a table of classes like RUNS; a word also ends where
    the class changes.
    """
    classes = space if runs else (~space).astype(np.uint8)
    hashes, starts, lengths, at = [], [], [], 0
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    for end in _cuts(raw, classes == 0):
        part = raw[at:end]
        kind = classes[part]
        inside = kind > 0
        first, last = inside.copy(), inside.copy()
        changed = kind[1:] != kind[:-1]
        first[1:] &= changed
        last[:-1] &= changed
        own = edges[(edges >= at) & (edges < end)] - at
        first[own] |= inside[own]
        own = own[own > 0] - 1
        last[own] |= inside[own]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        lengths.append(e - s)
        if prefix:
            e = np.minimum(e, s + prefix)
        size = max(SEGMENT, 1 << int(len(part)).bit_length())
        m, v = _powers(size)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((LOWER[part] if lower else part).astype(np.uint64) * v[: len(part)] + v[: len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * m[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    where = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(where, offsets), np.concatenate(lengths)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5):
    """For each row its sorted distinct word shingles as 64-bit hashes; a row with fewer words has its whole sequence as
    one shingle, a row without words none."""
    h, at, _ = words(raw, offsets)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _M) | np.uint64(1)
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        rolled += h[j : j + len(rolled)] * factors[j]
    rolled = mix(rolled)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            yield mix((h[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield h[:0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20, rows: int = 1 << 20):
    """The batch in runs of at most `rows` rows and limit bytes of the column (one row may exceed the latter)."""
    data = batch.column(column)
    if isinstance(data, pa.ChunkedArray):
        data = data.combine_chunks()
    _, offsets = buffers(data)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, a + rows, batch.num_rows)
        yield batch.slice(a, b - a)
        a = b
