"""Near duplicates by SimHash, found through an inverted index of byte positions.

Fingerprints at most 4 bits apart agree in at least 4 of their 8 bytes. The index holds each
fingerprint under the positional bytes of every choice of that guaranteed minimum, so a list is as
short as 32 equal bits make it. In a list the shared positional bytes of pairs are tallied, pairs
with the minimum are kept and verified by their differing bits. Equal fingerprints are one entry.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.components import components
from pactlens.llm.words import pieces
from pactlens.sources.scratch import store

WIDTH = 4
MAX_BITS = 4
BYTES = 8
LIST_ROWS = 2_048     # longest list whose pairs one task tallies; longer ones are split by further nibbles
_SLAB = 1 << 16


def _fingerprint(tokens: list[bytes], width: int) -> int:
    if not tokens:
        return 0
    text = b" ".join(tokens)
    ends = list(itertools.accumulate(len(t) + 1 for t in tokens))
    n = max(1, len(tokens) - width + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, n, _SLAB):
        high = min(n, low + _SLAB)
        if len(tokens) < width:
            hashes = [digest(text, 42)]
        else:
            begins = [0, *ends[:high - 1]][low:high]
            hashes = [digest(text[b:e - 1], 42) for b, e in zip(begins, ends[low + width - 1:high + width - 1])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    """Replace the first column, the text, by its fingerprint."""
    for batch in batches:
        found: list[list[bytes]] = []
        out = np.zeros(batch.num_rows, dtype=np.uint64)
        held: list[bytes] = []
        for piece in pieces(batch.column(0)):
            raw = piece.data.tobytes()
            cut = np.searchsorted(piece.row, np.arange(piece.first, piece.last + 2))
            tokens = [raw[s:e] for s, e in zip(piece.start.tolist(), piece.end.tolist())]
            for r in range(piece.first, piece.last + 1):
                own = tokens[cut[r - piece.first]:cut[r - piece.first + 1]]
                if piece.goes_on:
                    held += own
                else:
                    out[r] = _fingerprint(held + own, width)
                    held = []
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), *batch.columns[1:]], ["fp", *batch.schema.names[1:]])


def fingerprints(docs: DataFrame, keep: tuple[str, ...], text: str = "text", width: int = WIDTH) -> DataFrame:
    """(fp long, keep...) of every row."""
    rows = docs.select(F.col(text).alias("_text"), *keep)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(lambda b: fingerprint_batches(b, width), f"fp long, {kinds}")


def _byte(i: int):
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def _positions(fps: DataFrame, need: int):
    """(key, fp): one row for each choice of `need` byte positions; the key packs choice and bytes."""
    keys = []
    for number, choice in enumerate(itertools.combinations(range(BYTES), need)):
        mask = sum(255 << (8 * i) for i in choice)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed)), F.lit(number)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _spanning(fps: np.ndarray, max_bits: int, need: int) -> list[tuple[int, int]]:
    """Edges that connect what is within `max_bits` in one list of distinct fingerprints.

    A breadth-first search: each step tallies the shared bytes of the reached ones against
    those not reached, so a fingerprint leaves the search once.
    """
    edges, left = [], fps
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = np.zeros(len(left), dtype=bool)
            for x in front.tolist():
                apart = left ^ np.uint64(x)
                shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                hit = np.flatnonzero((shared >= need) & ~reached)
                hit = hit[np.bitwise_count(apart[hit]) <= max_bits]
                reached[hit] = True
                edges += [(x, int(y)) for y in left[hit]]
            front, left = left[reached], left[~reached]
    return edges


def _lists(batches: Iterator[pa.RecordBatch], max_bits: int, need: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(a, b, over) from rows (key, fp) sorted by both: edges of each list.

    Of a list longer than `longest` every member comes out with `over` set to the list's key, for
    a finer split; a list is never held beyond that.
    """
    def emit(rows: list[tuple]) -> pa.RecordBatch:
        a, b, over = (np.array(c, dtype=np.uint64).view(np.int64) for c in zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(over)], ["a", "b", "over"])

    open_key, held, spilled = None, np.zeros(0, dtype=np.uint64), False
    out: list[tuple] = []

    def close():
        if not spilled and len(held) > 1:
            out.extend((x, y, 0) for x, y in _spanning(held, max_bits, need))

    for batch in batches:
        keys, fps = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        if not len(keys):
            continue
        cut = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        long_runs = set(np.flatnonzero(np.diff(cut) > 1).tolist()) | {0, len(cut) - 2}
        for i in sorted(long_runs):
            low, high = cut[i], cut[i + 1]
            if keys[low] != open_key:
                close()
                open_key, held, spilled = keys[low], fps[low:high], False
            else:
                held = np.concatenate((held, fps[low:high]))
            if len(held) > longest or spilled:
                spilled = True
                out.extend((int(x), int(x), int(open_key) | 1) for x in held)
                held = held[:0]
        if len(out) > 10_000:
            yield emit(out)
            out.clear()
    close()
    if out:
        yield emit(out)


def links(fps: DataFrame, max_bits: int = MAX_BITS, longest: int = LIST_ROWS) -> DataFrame:
    """(a, b): edges between distinct fingerprints whose components are those of all links.

    A list of more than `longest` members is split by each choice of half of its nibbles: two
    that differ in at most 4 bits agree in 12 of 16 nibbles, of which 8 are fixed by 4 bytes
    already, so every link meets again in a list with 16 free bits, at most 65,536 members.
    """
    need = BYTES - max_bits
    if not 0 < need <= BYTES or max_bits > 4:
        raise ValueError("the byte index guarantees a match for at most 4 differing bits")

    def run(rows: DataFrame, most: int) -> DataFrame:
        return (rows.repartition("key").sortWithinPartitions("key", "fp")
                .mapInArrow(lambda b: _lists(b, max_bits, need, most), "a long, b long, over long"))

    first = store(run(_positions(fps, need), longest), "links")
    over = first.filter("over <> 0").select(F.col("a").alias("fp")).distinct()
    found = first.filter("over = 0").select("a", "b")
    if over.isEmpty():
        return found
    picks = [sum(15 << (4 * i) for i in c) for c in itertools.combinations(range(16), 16 - max_bits)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in picks])
    fine = over.select("fp", F.posexplode(masks).alias("n", "mask")).select(
        F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "n").alias("key"), "fp")
    return found.union(run(fine, 1 << 16).select("a", "b"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """key, fingerprint, component_id of every row.

    Texts link at `max_bits` or fewer differing bits; component_id is the smallest key in reach.
    Texts without words (NULL, empty, blank) have fingerprint zero and are linked like others;
    shorter texts than a shingle are one shingle; equal rows share a component; a NULL key
    never names a component but where all keys of it are NULL; an empty table gives no rows.
    """
    rows = store(fingerprints(docs, (key,), text, width), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min(key).alias("_least"))
    edges = links(firsts.select("fp"), max_bits)
    found = components(edges)
    named = (firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("_c", F.coalesce("component", "fp")))
    least = named.groupBy("_c").agg(F.min("_least").alias("component_id"))
    ids = named.join(least, "_c").select("fp", "component_id")
    return rows.join(ids, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each group, the one with the smallest key; of rows with that key, one of the first text.

    A group whose keys are all NULL keeps one row. The columns are those of `docs`.
    """
    ids = store(groups(docs.select(key, text), key, text, **how).groupBy(key, "component_id").agg(F.count("*").alias("n")), "groups")
    kept = ids.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_kept"), "n")
    once = docs.join(kept.filter("n = 1").select("_kept"), F.col(key).eqNullSafe(F.col("_kept")), "left_semi")
    again = kept.filter("n > 1")
    if again.isEmpty():
        return once
    first = Window.partitionBy(key).orderBy(text)
    more = (docs.join(again.select("_kept").distinct(), F.col(key).eqNullSafe(F.col("_kept")), "left_semi")
            .withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth"))
    return once.unionByName(more)
