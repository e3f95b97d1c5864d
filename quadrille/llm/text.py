"""Vectorised byte-level text kernels over Arrow string columns.

A batch is handled in chunks of whole documents of about ``CHUNK`` bytes, so that working arrays stay small however
many rows Arrow puts in a batch. Null texts count as empty.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Separators of words: ASCII white space, or all ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts of at most ``limit`` bytes, or one longer text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by text) of the words; words don't cross texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separators[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


class SpanHash:
    """64-bit hashes of any byte spans of a chunk, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def combine(h: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """An order-dependent hash of rows of hashes."""
    for x in more:
        h = mix(h * np.uint64(0xA0761D6478BD642F) + (x ^ np.uint64(0xE7037ED1A0B428DB)))
    return h


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words by text, or of the whole text where it has fewer words, and offsets by text.

    Not distinct; texts without words have none.
    """
    counts = np.diff(offsets)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_off = np.zeros(len(offsets), np.int64)
    np.cumsum(n, out=out_off[1:])
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(out_off[-1]) - out_off[text] + offsets[text]
    out = np.zeros(len(at), np.uint64)
    full = counts[text] >= size
    if full.any():
        p = at[full]
        out[full] = combine(words[p], *(words[p + k] for k in range(1, size)))
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        h = words[offsets[i] : offsets[i] + 1]
        out[out_off[i]] = combine(h, *(words[offsets[i] + k : offsets[i] + k + 1] for k in range(1, counts[i])), np.array([counts[i]], np.uint64))[0]
    return out, out_off
