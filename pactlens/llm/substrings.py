"""Exact substring dedup: bytes covered by a long string that also starts earlier go.

Equal windows of LENGTH bytes pick the same anchor, the least hashed k-gram in them, at the same
place. So windows meet by their anchor: anchors that occur once are done with, and where all
contexts of an anchor (the bytes of the windows that picked it) are equal, all but the first occurrence
repeat. The anchors whose contexts differ go, context by context, into buckets of bounded size.
A bucket is indexed by the run-compressed Burrows-Wheeler transform of its contexts, with the text
position sampled at the runs; a pass over the windows reads from the samples whether each
also starts earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm import bloom
from pactlens.llm.words import PIECE, mix, powers, utf8
from pactlens.sources.scratch import store

LENGTH = 100
GRAM = 24                  # bytes of an anchor
BUCKET_BYTES = 1 << 19     # text that one index holds
HOT_CONTEXTS = 4_096       # contexts of one anchor beyond which its windows are compared one by one
_POSITION = 21             # bits of a place within a piece
_OPEN = np.uint64(0xC2B2AE3D27D4EB4F)


class Anchors(NamedTuple):
    row: np.ndarray
    anchor: np.ndarray
    context: np.ndarray     # hash of the bytes start .. last + LENGTH and of the anchor's place in them
    start: np.ndarray       # first window that picks the anchor, in its text
    last: np.ndarray        # last one
    again: np.ndarray       # the text has this anchor and context earlier


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from running minima of blocks."""
    n = len(v) - width + 1
    block = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, dtype=v.dtype)
    block[:len(v)] = v
    block = block.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def _piece_anchors(flat: np.ndarray, row: np.ndarray, length: int, gram: int):
    """(first window, last window, anchor hash, context hash) within one piece of bytes."""
    n = len(flat)
    if n < length:
        return None
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * down[:n - gram + 1])
    low = np.uint64((1 << _POSITION) - 1)
    place = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    valid = row[:n - length + 1] == row[length - 1:]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | ~valid[:-1])) & valid
    start = np.flatnonzero(new)
    if not len(start):
        return None
    # A run ends before the next start or the next invalid window.
    ends = np.flatnonzero(np.concatenate((new[1:] | ~valid[1:], [True])) & valid)
    p = place[start]
    context = mix((total[ends + length] - total[start]) * down[start] + mix((p - start).astype(np.uint64) * _OPEN + (ends - start).astype(np.uint64)))
    return start, ends, h[p], context


def text_anchors(column: pa.Array, length: int = LENGTH, gram: int = GRAM, size: int = PIECE) -> tuple[Anchors, np.ndarray, np.ndarray]:
    """The anchors of all rows, with the bytes and row offsets. Texts longer than a piece overlap by length - 1."""
    flat, offsets = utf8(column)
    parts = []
    for low in range(0, max(1, len(flat)), size):
        high = min(len(flat), low + size + length - 1)
        first = max(0, int(np.searchsorted(offsets, low, "right")) - 1)
        last = int(np.searchsorted(offsets, high, "left"))
        borders = np.clip(offsets[first:last + 1], low, high)
        rows = np.repeat(np.arange(first, first + len(borders) - 1, dtype=np.int32), np.diff(borders))
        got = _piece_anchors(flat[low:high], rows, length, gram)
        if got is not None:
            start, last, anchor, context = got
            r = rows[start]
            parts.append((r, anchor, context, low + start - offsets[r], low + last - offsets[r]))
    if parts:
        row, anchor, context, start, last = (np.concatenate(x) for x in zip(*parts))
    else:
        row, anchor, context, start, last = (np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    same = mix(mix(anchor + row.astype(np.uint64) * _OPEN) + context)
    order = np.argsort(same, kind="stable")
    again = np.zeros(len(row), dtype=bool)
    again[order[1:]] = same[order[1:]] == same[order[:-1]]
    return Anchors(row.astype(np.int64), anchor, context, start, last, again), flat, offsets


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _first_pass(batches: Iterator[pa.RecordBatch], length: int, gram: int):
    """(anchor, context, key, again): one row for each text and context."""
    for batch in batches:
        a, _, _ = text_anchors(batch.column(0), length, gram)
        repeated = mix(mix(a.anchor + a.row.astype(np.uint64) * _OPEN) + a.context)
        pick = np.flatnonzero(~a.again)
        marked = np.isin(repeated[pick], repeated[a.again])
        yield pa.RecordBatch.from_arrays(
            [_signed(a.anchor[pick]), _signed(a.context[pick]), batch.column("key").take(pa.array(a.row[pick])), pa.array(marked)],
            ["anchor", "context", "key", "again"])


def _second_pass(repeated, length: int, gram: int):
    """(anchor, context, key, tag, start, last, again, bytes) of anchors in the filter; bytes where contexts may differ."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.Filter(*repeated.value)
        for batch in batches:
            a, flat, offsets = text_anchors(batch.column(0), length, gram)
            levels = known.levels(a.anchor)
            pick = np.flatnonzero(levels > 0)
            differs = levels[pick] > 1
            begin = (offsets[a.row[pick]] + a.start[pick]).tolist()
            end = (offsets[a.row[pick]] + a.last[pick] + length).tolist()
            texts = [flat[b:e].tobytes() if d else None for b, e, d in zip(begin, end, differs.tolist())]
            rows = pa.array(a.row[pick])
            yield pa.RecordBatch.from_arrays(
                [_signed(a.anchor[pick]), _signed(a.context[pick]), batch.column("key").take(rows), batch.column("tag").take(rows),
                 pa.array(a.start[pick]), pa.array(a.last[pick]), pa.array(a.again[pick]), pa.array(texts, pa.binary())],
                ["anchor", "context", "key", "tag", "start", "last", "again", "bytes"])
    return run


class RunIndex(NamedTuple):
    """Run-compressed Burrows-Wheeler transform of a text whose suffixes are ordered by their first bytes."""
    heads: np.ndarray       # preceding byte of each run
    sizes: np.ndarray       # suffixes in the run
    samples: np.ndarray     # least text position in the run
    matches: np.ndarray     # which runs share their first bytes


def run_index(text: np.ndarray, length: int) -> tuple[RunIndex, np.ndarray]:
    """The index of a text (values 0-255, separators above and all different), and each suffix's class.

    Suffixes are ranked by 4, 8, 16, ... bytes and at last by `length`; those that agree keep
    their order in the text, so the first of a run is its least position.
    """
    n = len(text)
    padded = np.concatenate((text.astype(np.int64), np.zeros(length, dtype=np.int64)))
    base = int(padded.max()) + 1
    rank = np.unique(padded[:n] * base + padded[1:n + 1], return_inverse=True)[1].astype(np.int64)
    done = 2
    while done < length:
        step = min(done, length - done)
        later = np.zeros(n, dtype=np.int64)
        later[:max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        done += step
    order = np.argsort(rank, kind="stable")
    before = np.where(order > 0, text[order - 1], -1)
    # Within a class the suffixes are taken by preceding byte, so equal ones form one run.
    order = order[np.lexsort((order, before, rank[order]))]
    before = np.where(order > 0, text[order - 1], -1)
    classes = rank[order]
    first = np.flatnonzero(np.concatenate(([True], (classes[1:] != classes[:-1]) | (before[1:] != before[:-1]))))
    return RunIndex(before[first], np.diff(np.concatenate((first, [n]))), order[first], classes[first]), rank


def earlier_windows(contexts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its first `windows` windows also start earlier in the list.

    Matching statistics cut off at `length`: a window matches that far where its class has a
    sampled run with a lesser position.
    """
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    text = np.empty(int(sizes.sum()) + len(contexts), dtype=np.int64)
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    inside = np.ones(len(text), dtype=bool)
    inside[begin + sizes] = False
    text[inside] = data
    text[begin + sizes] = 256 + np.arange(len(contexts))
    index, rank = run_index(text, length)
    least = np.full(int(rank.max()) + 1, len(text), dtype=np.int64)
    np.minimum.at(least, index.matches, index.samples)
    repeats = least[rank] < np.arange(len(text))
    return [repeats[b:b + w] for b, w in zip(begin.tolist(), windows)]


def _spans(hits: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Byte spans of runs of windows, the first of which starts at `start`."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hits.astype(np.int8), [0]))))
    return [(start + int(b), start + int(e) - 1 + length) for b, e in edge.reshape(-1, 2)]


def _buckets(batches: Iterator[pa.RecordBatch], length: int, most: int):
    """(key, tag, begin, end) of repeated spans, from contexts sorted by anchor, key and start."""
    schema = None
    held: list[tuple] = []
    size, open_anchor = 0, None

    def settle() -> pa.RecordBatch | None:
        spans = []
        if held:
            found = earlier_windows([h[3] for h in held], [h[4] for h in held], length)
            for (key, tag, start, _, _), hits in zip(held, found):
                spans += [(key, tag, b, e) for b, e in _spans(hits, start, length)]
        if not spans:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type if n in ("key", "tag") else pa.int64())
                                           for n, c in zip(("key", "tag", "begin", "end"), zip(*spans))], ["key", "tag", "begin", "end"])

    for batch in batches:
        schema = batch.schema
        columns = [batch.column(c).to_pylist() for c in ("anchor", "key", "tag", "start", "last", "bytes")]
        for anchor, key, tag, start, last, text in zip(*columns):
            if held and anchor == open_anchor and held[-1][:3] == (key, tag, start):
                continue  # the same row of the table again
            if anchor != open_anchor and size >= most:
                out = settle()
                if out is not None:
                    yield out
                held, size = [], 0
            open_anchor = anchor
            held.append((key, tag, start, text, last - start + 1))
            size += len(text)
    out = settle()
    if out is not None:
        yield out


def _single_windows(batches: Iterator[pa.RecordBatch], length: int):
    """(anchor, key, tag, start, last, again): each window of the contexts as an anchor of its own."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "tag", "start", "last", "bytes")]
        keys, tags, starts, hashes = [], [], [], []
        for key, tag, start, last, text in zip(*columns):
            data = np.frombuffer(text, dtype=np.uint8)
            up, down = powers(len(data) + 1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])))
            n = last - start + 1
            hashes.append(mix((total[length:length + n] - total[:n]) * down[:n] + _OPEN))
            keys += [key] * n
            tags += [tag] * n
            starts.append(np.arange(start, start + n))
        if keys:
            at = pa.array(np.concatenate(starts))
            yield pa.RecordBatch.from_arrays(
                [_signed(np.concatenate(hashes)), pa.array(keys, batch.schema.field("key").type), pa.array(tags, pa.int64()), at],
                ["anchor", "key", "tag", "start"])


def _settle(with_spans, with_kept: bool):
    """(text, key, tag, then the result) of every row: complete, without its text, where the text surely has no span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.Filter(*with_spans.value)
        for batch in batches:
            flat, offsets = utf8(batch.column("text"))
            opened = known.levels(batch.column("tag").to_numpy().view(np.uint64)) > 0
            spans: list = [None] * batch.num_rows
            result = _covered(flat, offsets, spans, with_kept, ~opened)
            mask = pa.array(opened)
            text = pc.if_else(mask, batch.column("text"), pa.scalar(None, batch.column("text").type))
            yield pa.RecordBatch.from_arrays([text, batch.column("key"), batch.column("tag"), *result], [
                "text", "key", "tag", *_RESULT[:len(result)]])
    return run


_RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _covered(flat: np.ndarray, offsets: np.ndarray, spans: list, with_kept: bool, wanted: np.ndarray) -> list[pa.Array]:
    """The result columns of the wanted rows, NULL in the others."""
    rows: list[tuple] = []
    for r, own in enumerate(spans):
        if not wanted[r]:
            rows.append((None, None, None, None, None))
            continue
        data = flat[offsets[r]:offsets[r + 1]]
        size, removed, runs = len(data), 0, 0
        if own:
            edge = np.zeros(size + 1, dtype=np.int64)
            np.add.at(edge, [s["begin"] for s in own], 1)
            np.add.at(edge, [s["end"] for s in own], -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            data = data[~gone]
        kept = data.tobytes()
        rows.append((size, removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * 5
    return [pa.array(c, k) for c, k in zip(columns, kinds)][:4 + with_kept]


def _cover(batches: Iterator[pa.RecordBatch], with_kept: bool):
    """Complete the rows that still have their text, with their spans."""
    for batch in batches:
        flat, offsets = utf8(batch.column("text"))
        waiting = ~np.asarray(batch.column("n_bytes").is_valid().to_numpy(zero_copy_only=False))
        fresh = _covered(flat, offsets, batch.column("spans").to_pylist(), with_kept, waiting)
        mask = pa.array(waiting)
        columns = [pc.if_else(mask, new, batch.column(name)) for name, new in zip(_RESULT, fresh)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", *_RESULT[:len(columns)]])


def _filter_of(keys: DataFrame) -> tuple[int, DataFrame]:
    """(segments, stored filter) of rows (h long, n long), n at most 2."""
    segments = bloom.segment_count(2 * keys.count())
    return segments, store(bloom.build(keys, segments), "filter")


def repeated_spans(docs: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM,
                   bucket_bytes: int = BUCKET_BYTES, hot_contexts: int = HOT_CONTEXTS, group: int = bloom.GROUP_SEGMENTS) -> DataFrame:
    """(key, tag, begin, end): spans of bytes that repeat, overlapping; tag is a hash of the text."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(text).alias("text"), F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tag"))
    first = source.select("text", "key").mapInArrow(
        lambda b: _first_pass(b, length, gram), f"anchor long, context long, key {kind}, again boolean")
    # A NULL key sorts first: `nulls` says that an anchor has one.
    table = store(first.groupBy("anchor").agg(
        F.min("context").alias("c1"), F.max("context").alias("c2"), F.min("key").alias("k1"), F.max("key").alias("k2"),
        F.max(F.col("again") | F.col("key").isNull()).alias("more"), F.max(F.col("key").isNull()).alias("nulls"))
        .filter("more OR c1 <> c2 OR NOT (k1 <=> k2)").select(
            "anchor", "k1", "nulls", (F.col("c1") != F.col("c2")).alias("differs")), "anchors")

    # Anchors with one context count once, the others twice; each group of segments takes its own pass.
    segments, stored = _filter_of(table.select(F.col("anchor").alias("h"), F.when(F.col("differs"), 2).otherwise(1).cast("bigint").alias("n")))
    found = None
    for known in bloom.groups(stored, segments, bloom.WORDS, group):
        rows = source.mapInArrow(_second_pass(spark.sparkContext.broadcast(known.plain()), length, gram), (
            f"anchor long, context long, key {kind}, tag long, start long, last long, again boolean, bytes binary"))
        found = rows if found is None else found.unionByName(rows)
    found = store(found.join(table, "anchor"), "occurrences")

    def earlier(rows: DataFrame) -> DataFrame:
        """Occurrences that are not the first of their text."""
        return rows.filter("again OR (nulls AND key IS NOT NULL) OR (NOT nulls AND key > k1)")

    span = ("key", "tag", F.col("start").alias("begin"), (F.col("last") + length).alias("end"))
    spans = earlier(found.filter("NOT differs")).select(*span)

    mixed = found.filter("differs").drop("k1", "nulls")
    heads = mixed.groupBy("anchor", "context").agg(F.min("key").alias("k1"), F.max(F.col("key").isNull()).alias("nulls"))
    crowd = heads.groupBy("anchor").agg(F.count("*").alias("contexts"))
    mixed = mixed.join(heads, ["anchor", "context"])
    again = earlier(mixed).select(*span)
    firsts = store(mixed.filter("NOT (again OR (nulls AND key IS NOT NULL) OR (NOT nulls AND key > k1))").join(crowd, "anchor")
                   .select("anchor", "key", "tag", "start", "last", "bytes", "contexts"), "contexts")
    few = firsts.filter(F.col("contexts") <= hot_contexts).drop("contexts")
    indexed = (few.repartition("anchor").sortWithinPartitions("anchor", "key", "start", "tag")
               .mapInArrow(lambda b: _buckets(b, length, bucket_bytes), f"key {kind}, tag long, begin long, end long"))
    spans = spans.unionByName(again).unionByName(indexed)

    hot = firsts.filter(F.col("contexts") > hot_contexts)
    if not hot.isEmpty():
        windows = store(hot.mapInArrow(lambda b: _single_windows(b, length), f"anchor long, key {kind}, tag long, start long"), "windows")
        least = windows.groupBy("anchor", "key").agg(F.min("start").alias("start"))
        head = least.groupBy("anchor").agg(F.min("key").alias("k1"), F.max(F.col("key").isNull()).alias("nulls"))
        own = least.withColumnsRenamed({"anchor": "_a", "key": "_k", "start": "_s"})
        rows = (windows.join(head, "anchor").join(own, (F.col("anchor") == F.col("_a")) & F.col("key").eqNullSafe(F.col("_k")))
                .withColumn("again", F.col("start") > F.col("_s")).withColumn("last", F.col("start")))
        spans = spans.unionByName(earlier(rows).select(*span))
    return spans


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_kept: bool = False, group: int = bloom.GROUP_SEGMENTS, **how) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with `with_kept` the bytes kept.

    A NULL text is empty; texts shorter than the length keep all; a NULL key comes before all others; rows
    that are equal do not remove from each other, but a row repeats itself as any text does; matches never
    cross texts; an empty table gives no rows. Rows of one key with different texts are one document
    here: either may lose what both hold.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    spans = store(repeated_spans(docs, key, text, group=group, **how).groupBy(F.col("key").alias("_k"), F.col("tag").alias("_t"))
                  .agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")
    # Texts without a span, most of them, are settled where they are; the others move to their spans.
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tag"))
    result = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    segments, stored = _filter_of(spans.select(F.col("_t").alias("h"), F.lit(1).cast("bigint").alias("n")).distinct())
    if segments <= group:
        shared = spark.sparkContext.broadcast(next(bloom.groups(stored, segments)).plain())
        settled = rows.mapInArrow(_settle(shared, with_kept), f"text string, key {kind}, tag long, {result}")
    else:  # a filter beyond the bound is not broadcast: every text moves
        settled = rows.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in result.split(", "))])
    joined = settled.join(spans, F.col("key").eqNullSafe(F.col("_k")) & (F.col("tag") == F.col("_t")), "left").drop("tag", "_k", "_t")
    return joined.mapInArrow(lambda b: _cover(b, with_kept), f"key {kind}, {result}").withColumnRenamed("key", key)
