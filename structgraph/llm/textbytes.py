"""Whole texts as UTF-8 bytes: word spans and their hashes for a batch of texts at once.

A batch of an Arrow string column is one run of bytes and the place where each
text begins.  Words are spans of it, and the hash of a span comes from running
sums of a polynomial in its bytes, so no word becomes a Python object.  Running
sums go over blocks of ``BLOCK`` bytes (one longer word alone), which bounds
what a very long text takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: Texts are worked on in pieces of so many bytes, or one text.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lowered(column: pa.Array) -> pa.Array:
    """In lower case; a text that isn't UTF-8 only in its ASCII letters."""
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        rows = [column.slice(i, 1) for i in range(len(column))]
        return pa.concat_arrays([_one(x) for x in rows])


def _one(row: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(row)
    except pa.ArrowInvalid:
        return pc.ascii_lower(row)


def pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole texts and the place of their first."""
    i, last = 0, len(column)
    sizes = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    while i < last:
        j = min(last, max(i + 1, int(np.searchsorted(sizes, sizes[i] + PIECE, "right")) - 1))
        yield i, column.slice(i, j - i)
        i = j


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) and where each begins, and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return own, at - at[0]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes; none goes beyond a text."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    joined = inside[:-1] & inside[1:] & ~cut[1:-1]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~joined
    ends[:-1] &= ~joined
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of anything but ASCII white space."""
    return runs(~_SPACE[data], at)


def owners(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each span is in."""
    return np.searchsorted(at, starts, "right") - 1


def before(mask: np.ndarray) -> np.ndarray:
    """How many bytes of ``mask`` stand before each place (one place more than bytes)."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def blocks(starts: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    """Slices of sorted spans that cover ``BLOCK`` bytes at most, or one span."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        yield slice(i, j)
        i = j


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    return _powers(BLOCK)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(n + 1, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


class Hashes:
    """64-bit hashes of spans within bytes ``lo`` to ``hi``: equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, lo: int, hi: int) -> None:
        n = hi - lo
        power, self.inverse = _table() if n <= BLOCK else _powers(n)
        self.lo, self.sums = lo, np.zeros(n + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        a = starts - self.lo
        return mixed((self.sums[ends - self.lo] - self.sums[a]) * self.inverse[a] + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads what is in any bit over all of them."""
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)
