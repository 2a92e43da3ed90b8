"""Words and word hashes of whole Arrow batches, by numpy over the UTF-8 bytes.

Classes of separators are ASCII, so bytes suffice: a byte from 0x80 on belongs
to a character that is no separator. 64-bit hashes stand for words; within a
document's or a pair's few thousand words a collision has odds below 1e-12.
"""

from __future__ import annotations

import ctypes
import functools
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa



def trimmed(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function of batches that gives a task's scratch memory back at its end; worker processes live on and would keep it."""

    @functools.wraps(run)
    def with_trim(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _tables.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return with_trim


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; scratch memory is about 40 times as much.
SPAN = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Everything but space and the controls 09 to 0D.
NOT_SPACE = ~_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, a to z and what isn't ASCII; for lower-cased bytes.
ALNUM = _class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _tables:
        _tables.clear()
        _tables[size] = (_powers(_BASE, size), _powers(_INVERSE, size))
    return _tables[size]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_marks: list[np.ndarray] = []


def _is_mark() -> np.ndarray:
    """For every code point from 0x80 on whether it is neither letter, combining mark nor number; made when first used."""
    if not _marks:
        _marks.append(np.array([unicodedata.category(chr(c))[0] not in "LMN" for c in range(sys.maxunicode + 1)]))
    return _marks[0]


def blank_marks(data: np.ndarray) -> np.ndarray:
    """The bytes with every character beyond ASCII that is no letter, combining mark or number made spaces, as many as it has bytes."""
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return data
    out = data
    for low, high, size in ((0xC2, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xF4, 4)):
        at = lead[(data[lead] >= low) & (data[lead] <= high)]
        if not len(at):
            continue
        code = data[at].astype(np.int64) & (0x7F >> size)
        for k in range(1, size):
            code = code << 6 | data[at + k] & 0x3F
        at = at[_is_mark()[code]]
        if len(at):
            out = out.copy() if out is data else out
            for k in range(size):
                out[at + k] = 0x20
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, lower: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of some documents, and where each document's words begin."""
    m = kept[lower[data]]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    after = np.empty(len(data), dtype=bool)  # the byte before is outside the word
    if len(data):
        after[0] = True
        after[1:] = ~m[:-1]
    after |= edge[:-1]
    starts = np.flatnonzero(m & after)
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[-1] = True
        before[:-1] = ~m[1:]
    before |= edge[1:]
    ends = np.flatnonzero(m & before) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, SPAN bytes at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _pow(hi - lo + 1)
        sums = np.empty(hi - lo + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((lower[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def slices(column: pa.Array, size: int = 2 * SPAN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A batch's documents a few at a time: first, last + 1, bytes, offsets. A longer document is a slice of its own."""
    data, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
