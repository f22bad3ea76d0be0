"""Words of UTF-8 text: runs of bytes outside space and 0x09-0x0D, A-Z lowered."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

PIECE = 1 << 18  # bytes tokenised at once
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict = {}


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """ARRAY<STRING> of the words; NULL has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{WORD_CLASS}+"), F.lit(0))


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        both = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        have = _POWERS["p"] = tuple(both)
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words(NamedTuple):
    row: np.ndarray      # row of each word, ascending
    start: np.ndarray    # in data
    end: np.ndarray
    data: np.ndarray     # lowered bytes
    first: int           # first row of the piece
    last: int            # last row of the piece
    goes_on: bool        # the last row continues in the next piece
    bounds: np.ndarray   # where each row of the piece begins in data, and the end

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        n = len(self.data)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def texts(self, pick: np.ndarray) -> pa.Array:
        """The picked words as an Arrow array."""
        size = self.end[pick] - self.start[pick]
        offsets = np.concatenate(([0], np.cumsum(size)))
        places = np.repeat(self.start[pick] - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.string(), len(size), [
            None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[places])])


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Words]:
    """The words of all rows, in pieces of about `size` bytes.

    Whole rows share a piece; a longer row is cut between words and continues in the
    next piece, so memory does not follow the longest text.
    """
    flat, offsets = utf8(column)
    rows = len(offsets) - 1
    row, at = 0, 0
    while row < rows:
        begin = int(offsets[row]) + at
        last = int(np.searchsorted(offsets, begin + size, "right")) - 2
        if last >= row:
            stop, goes_on = int(offsets[last + 1]), False
        else:
            last, end = row, int(offsets[row + 1])
            stop, goes_on = _cut(flat, begin, end, size), True
            goes_on = stop < end
        yield _words(flat[begin:stop], offsets[row:last + 2] - begin, row, last, goes_on)
        row, at = (last, stop - int(offsets[last])) if goes_on else (last + 1, 0)


def _cut(flat: np.ndarray, begin: int, end: int, size: int) -> int:
    """A place at or after begin + size where a line or at least a word has ended, else the end."""
    at = begin + size
    line = np.flatnonzero(flat[at:min(end, at + (PIECE >> 2))] == 10)
    if len(line):
        return at + int(line[0])
    while at < end:
        space = np.flatnonzero(_SPACE[flat[at:min(end, at + 4096)]])
        if len(space):
            return at + int(space[0])
        at += 4096
    return end


def _words(raw: np.ndarray, offsets: np.ndarray, first: int, last: int, goes_on: bool) -> Words:
    data = _LOWER[raw]
    n = len(data)
    space = np.ones(n + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    inside = ~space[1:-1]
    starts, ends = inside & space[:-2], inside & space[2:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    starts[borders] |= inside[borders]
    ends[borders - 1] |= inside[borders - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = first + np.searchsorted(offsets[1:-1], start, "right") if len(offsets) > 2 else np.full(len(start), first)
    return Words(row, start, end, data, first, last, goes_on, np.clip(offsets, 0, n))
