"""Log-frequency Bloom filters in segments of fixed size.

A count c is kept as its level 1 + floor(log_base c): the key goes in once for each level
up to its own, and probing level after level until the first miss reads it back. All levels
of a key share a segment, and all bits of a level share one 64-bit word. The number of segments
follows the number of insertions, so the error rate is the same for every corpus; a segment
has a fixed size, so a group of segments can be broadcast with a proven bound and a larger
filter takes several passes instead of a larger broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.words import mix

WORDS = 1 << 17                  # 64-bit words of a segment: 1 MB
BITS_PER_ENTRY = 6
PROBES = 4
GROUP_SEGMENTS = 128             # at most 128 MB are broadcast at once
LEVEL_BASE = 1.5
_STEP = 0xD6E8FEB86659FD93


def segment_count(entries: int, words: int = WORDS) -> int:
    return max(1, math.ceil(entries * BITS_PER_ENTRY / (64 * words)))


def levels(counts: np.ndarray, base: float = LEVEL_BASE) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def level_value(top: int = 255, base: float = LEVEL_BASE) -> np.ndarray:
    """Count that stands for each level; 0 for level 0: the mean of the whole numbers of the level."""
    out = np.zeros(top + 1)
    for j in range(1, top + 1):
        low, high = math.ceil(base ** (j - 1) - 1e-9), math.ceil(base ** j - 1e-9) - 1
        out[j] = (low + max(low, high)) / 2
    return out


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(segments)).astype(np.int64)


def _place(keys: np.ndarray, level: int | np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the segment and bit mask of (key, level)."""
    e = mix(keys + np.asarray(level, dtype=np.uint64) * np.uint64(_STEP))
    word = (e % np.uint64(words)).astype(np.int64)
    e = e >> np.uint64(20)
    mask = np.zeros(len(keys), dtype=np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((e >> np.uint64(6 * i)) & np.uint64(63))
    return word, mask


def fill_segments(keys: np.ndarray, counts: np.ndarray, segments: int, words: int = WORDS) -> dict[int, np.ndarray]:
    """Bit arrays by segment for keys that may repeat; their counts add up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    keys, level = keys[first], levels(np.add.reduceat(counts, first)) if len(first) else np.zeros(0, dtype=np.int64)
    seg = segment_of(keys, segments)
    out = {int(s): np.zeros(words, dtype=np.uint64) for s in np.unique(seg)}
    j = 1
    while len(keys):
        word, mask = _place(keys, j, words)
        for s, bits in out.items():
            here = seg == s if len(out) > 1 else slice(None)
            np.bitwise_or.at(bits, word[here], mask[here])
        more = level > j
        keys, level, seg, j = keys[more], level[more], seg[more], j + 1
    return out


def build(rows: DataFrame, segments: int, words: int = WORDS) -> DataFrame:
    """(seg, bits) from rows (h long, n long): one task gathers about one segment's keys."""
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            keys, counts = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            own = segment_of(keys, segments)
            for s in np.unique(own):
                held.setdefault(int(s), []).append((keys[own == s], counts[own == s]))
        while held:  # a task may get a few segments; each is filled on its own
            seg, parts = held.popitem()
            keys, counts = (np.concatenate(x) for x in zip(*parts))
            del parts
            bits = fill_segments(keys, counts, segments, words)[seg]
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([bits.tobytes()])], ["seg", "bits"])

    seg = F.shiftrightunsigned("h", 33) % F.lit(segments)
    return rows.select("h", "n").repartition(segments, seg).mapInArrow(reduce, "seg int, bits binary")


class Filter:
    """Some segments of a filter, in memory."""

    def __init__(self, slot: np.ndarray, bits: np.ndarray, segments: int, words: int = WORDS):
        self.slot, self.bits, self.segments, self.words = slot, bits, segments, words

    @classmethod
    def of(cls, parts: dict[int, bytes], segments: int, words: int = WORDS) -> Filter:
        slot = np.full(segments, -1, dtype=np.int64)
        slot[list(parts)] = np.arange(len(parts))
        bits = np.frombuffer(b"".join(parts.values()), dtype=np.uint64) if parts else np.zeros(0, dtype=np.uint64)
        return cls(slot, bits, segments, words)

    def plain(self) -> tuple:
        """What `Filter(*...)` needs, without this class: broadcasts are pickled by reference."""
        return self.slot, self.bits, self.segments, self.words

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key by repeated probes; 0 where it is absent or its segment is elsewhere."""
        out = np.zeros(len(keys), dtype=np.uint8)
        slot = self.slot[segment_of(keys, self.segments)]
        alive = np.flatnonzero(slot >= 0)
        base = slot[alive] * self.words
        j = 1
        while len(alive) and j < 256:
            word, mask = _place(keys[alive], j, self.words)
            hit = (self.bits[base + word] & mask) == mask
            alive, base = alive[hit], base[hit]
            out[alive] = j
            j += 1
        return out


def groups(stored: DataFrame, segments: int, words: int = WORDS, group: int = GROUP_SEGMENTS) -> Iterator[Filter]:
    """The stored filter piece by piece; each holds at most `group` segments."""
    for low in range(0, segments, group):
        part = stored.filter((F.col("seg") >= low) & (F.col("seg") < low + group)).toArrow()
        slot = np.full(segments, -1, dtype=np.int64)
        slot[part.column("seg").to_numpy()] = np.arange(part.num_rows)
        bits = np.empty(part.num_rows * words, dtype=np.uint64)
        at = 0
        for chunk in part.column("bits").chunks:  # copied once, straight from the batches
            for value in chunk:
                bits[at:at + words] = np.frombuffer(value.as_buffer(), dtype=np.uint64)
                at += words
        del part
        yield Filter(slot, bits, segments, words)
