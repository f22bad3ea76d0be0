"""Hard negatives of anchors by exact inner products, with bounds from segment summaries.

Each vector is cut into segments and the index stores each segment's sum (its mean times its length) and its
deviation, the norm of what is left after taking off the mean. For two vectors the inner product of a segment lies
within the product of the deviations of the product of the means, so the sums over the segments bound the score from
both sides. Summaries of a coarser level follow from those of the finer one. A pair is refined level by level
and scored exactly only if its bounds still allow it among the rows asked for.

Anchors meet all rows in blocks: a task holds one block of anchors and streams its rows, and keeps only the
rows asked for of each anchor, which a last ranking merges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.sources.scratch import store

UNIT = 256               # components are stored as floor(UNIT * x)
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # percent of the positive's score between which a negative lies
SEGMENTS = (4, 16)       # levels from coarse to fine; each divides the next
ANCHOR_BLOCK = 8_192     # anchors that a task holds
ROW_BLOCK = 1 << 18      # rows that a task streams past them
_ANCHORS, _ROWS = 512, 1_024  # of one step of a task
_LIMIT = 1 << 50         # scores below are exact in doubles
_NONE = -(1 << 62)


def summaries(q: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, deviations) of each row's segments; the length is padded to a multiple."""
    parts = q.reshape(len(q), segments, -1)
    sums = parts.sum(axis=2)
    return sums, np.sqrt(np.maximum((parts * parts).sum(axis=2) - sums * sums / parts.shape[2], 0))


def coarser(sums: np.ndarray, devs: np.ndarray, segments: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of `segments` segments from finer ones of `length` components each."""
    fine = sums.shape[1] // segments
    s, d = sums.reshape(len(sums), segments, fine), devs.reshape(len(devs), segments, fine)
    whole = s.sum(axis=2)
    squares = (d * d + s * s / length).sum(axis=2)
    return whole, np.sqrt(np.maximum(squares - whole * whole / (length * fine), 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones padded with zeros."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat[offsets[0]:offsets[-1]]
    return out


def _index(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Add the finest summaries to rows (id, label, q, ...)."""
    fine = SEGMENTS[-1]
    offsets = lambda n: pa.array(np.arange(0, n * fine + 1, fine, dtype=np.int32))
    for batch in batches:
        sums, devs = summaries(_matrix(batch.column("q"), width), fine)
        n = batch.num_rows
        lists = [pa.ListArray.from_arrays(offsets(n), pa.array(x.ravel())) for x in (sums, devs)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "sums", "devs"])


class Rows:
    """Vectors of a step with their summaries, ordered by id."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        ids = batch.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], batch.column("label").to_numpy()[order]
        self.q = _matrix(batch.column("q"), width)[order]
        sums, devs = (_matrix(batch.column(c), SEGMENTS[-1])[order] for c in ("sums", "devs"))
        length = width // SEGMENTS[-1]
        self.levels = []
        for segments in SEGMENTS:
            s, d = (sums, devs) if segments == SEGMENTS[-1] else coarser(sums, devs, segments, length)
            self.levels.append((s / math.sqrt(width // segments), d))
        self.batch = batch


def allowed(anchors: Rows, a: slice, rows: Rows, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of the wanted pairs may have a score from `low` to `high` (one of each anchor), level by level."""
    alive = wanted
    for level in range(len(SEGMENTS)):
        (m, d), (n, e) = anchors.levels[level], rows.levels[level]
        left, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(left):
            break
        middle = m[a][left] @ n[cols].T
        spread = d[a][left] @ e[cols].T + 1e-6 * (1 + np.abs(middle))
        fits = (middle + spread >= low[left, None]) & (middle - spread <= high[left, None])
        kept = np.zeros_like(alive)
        kept[np.ix_(left, cols)] = alive[np.ix_(left, cols)] & fits
        alive = kept
    return alive


def _scores(anchors: Rows, a: slice, rows: Rows, alive: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs alive, else the least number."""
    out = np.full(alive.shape, _NONE)
    left, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    if len(left):
        block = np.ix_(left, cols)
        out[block] = np.where(alive[block], (anchors.q[a][left] @ rows.q[cols].T).astype(np.int64), _NONE)
    return out


def _merge(best: np.ndarray, ids: np.ndarray, scores: np.ndarray, row_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best rows so far (scores and ids, best first) and new scores: the best of both; ties by the smaller id."""
    k = best.shape[1]
    take = min(k, scores.shape[1])
    # Rows stand in order of ids, so a stable order by score settles ties.
    top = np.argsort(-scores, axis=1, kind="stable")[:, :take] if take == scores.shape[1] else _top(scores, take)
    both = np.concatenate((best, np.take_along_axis(scores, top, 1)), axis=1)
    both_ids = np.concatenate((ids, row_ids[top]), axis=1)
    order = np.lexsort((both_ids, -both), axis=1)[:, :k]
    return np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)


def _top(scores: np.ndarray, take: int) -> np.ndarray:
    """Places of the `take` highest scores of each line, of equal ones the first."""
    n = scores.shape[1]
    rank = np.where(scores == _NONE, _NONE, scores * n + np.arange(n - 1, -1, -1))
    return np.argpartition(-rank, take - 1, axis=1)[:, :take]


def _steps(batches: Iterator[pa.RecordBatch], width: int):
    """("begin" | "rows" | "end", anchors, rows) of each block pair, from rows sorted by (pair, kind, id)."""
    held: list[pa.RecordBatch] = []
    open_pair, anchors = None, None
    for batch in batches:
        pairs, kinds = batch.column("pair").to_numpy(), batch.column("kind").to_numpy()
        cut = np.flatnonzero(np.diff(pairs) | np.diff(kinds)) + 1
        for low, high in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            if pairs[low] != open_pair:
                if anchors is not None:
                    yield "end", anchors, None
                held, open_pair, anchors = [], pairs[low], None
            if kinds[low] == 0:
                held.append(part)
                continue
            if anchors is None:
                if not held:
                    continue
                anchors = Rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width)
                yield "begin", anchors, None
            for at in range(0, part.num_rows, _ROWS):
                yield "rows", anchors, Rows(part.slice(at, _ROWS), width)
    if anchors is not None:
        yield "end", anchors, None


def _nearest(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    """(anchor, id, score): the best rows of each anchor's label in a block."""
    best = ids = None
    for what, anchors, rows in _steps(batches, width):
        n = len(anchors.ids)
        if what == "begin":
            best, ids = np.full((n, most), _NONE), np.zeros((n, most), dtype=np.int64)
        elif what == "rows":
            for at in range(0, n, _ANCHORS):
                a = slice(at, at + _ANCHORS)
                wanted = (anchors.labels[a, None] == rows.labels) & (anchors.ids[a, None] != rows.ids)
                low = best[a, -1].astype(float)
                alive = allowed(anchors, a, rows, wanted, low, np.full(len(low), np.inf))
                if alive.any():
                    best[a], ids[a] = _merge(best[a], ids[a], _scores(anchors, a, rows, alive), rows.ids)
        else:
            i, j = np.nonzero(best != _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[i]), pa.array(ids[i, j]), pa.array(best[i, j])], ["anchor", "id", "score"])


def _between(batches: Iterator[pa.RecordBatch], width: int, positives: int, most: int, lowest: int, highest: int) -> Iterator[pa.RecordBatch]:
    """(anchor, nth, id, score): the best rows of other labels between the bounds of each positive, in a block."""
    best = ids = low = high = None
    for what, anchors, rows in _steps(batches, width):
        n = len(anchors.ids)
        if what == "begin":
            order = np.argsort(anchors.batch.column("id").to_numpy(), kind="stable")
            goals = np.full((n, positives), np.nan)
            for i, k in enumerate(order.tolist()):
                got = anchors.batch.column("bounds")[k].as_py() or []
                goals[i, :len(got)] = got
            none = ~(goals >= 0)  # with a negative score, or without a positive, no score fits
            low = np.where(none, np.inf, np.ceil(lowest * goals / 100))
            high = np.where(none, -np.inf, np.floor(highest * goals / 100))
            best = np.full((n, positives, most), _NONE)
            ids = np.zeros((n, positives, most), dtype=np.int64)
        elif what == "rows":
            for at in range(0, n, _ANCHORS):
                a = slice(at, at + _ANCHORS)
                wanted = (anchors.labels[a, None] != rows.labels) & (anchors.ids[a, None] != rows.ids)
                need = np.maximum(low[a], best[a, :, -1].astype(float)).min(axis=1)
                alive = allowed(anchors, a, rows, wanted, need, high[a].max(axis=1))
                if not alive.any():
                    continue
                scores = _scores(anchors, a, rows, alive)
                for p in range(positives):
                    floor = np.maximum(low[a, p], best[a, p, -1].astype(float))
                    fits = (scores >= floor[:, None]) & (scores <= high[a, p, None])
                    if fits.any():
                        best[a, p], ids[a, p] = _merge(best[a, p], ids[a, p], np.where(fits, scores, _NONE), rows.ids)
        else:
            i, p, j = np.nonzero(best != _NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.ids[i]), pa.array(p.astype(np.int32)), pa.array(ids[i, p, j]), pa.array(best[i, p, j])],
                ["anchor", "nth", "id", "score"])


def segment_index(rows: DataFrame, key: str, vector: str, label: str, anchor: Column, unit: int = UNIT) -> tuple[DataFrame, int]:
    """(stored index (id, label, anchor, q, sums, devs), padded width) of the rows that take part."""
    x = F.col("v")
    source = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                         F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < math.inf), F.lit(False)))
    source = source.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).filter(usable)
    quantised = F.transform(x, lambda e: F.floor(F.lit(float(unit)) * e).cast("double")).alias("q")
    # Of rows with one key the least takes part.
    once = source.select("id", F.struct("label", quantised, "anchor").alias("r")).groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*")
    once = store(once, "vectors")
    size = once.agg(F.max(F.size("q")).alias("width"), F.max(F.aggregate("q", F.lit(0.0), lambda a, e: a + e * e)).alias("norm")).first()
    if (size["norm"] or 0) >= _LIMIT:
        raise ValueError("vectors are too long for exact scores")
    width = max(1, math.ceil((size["width"] or 0) / SEGMENTS[-1])) * SEGMENTS[-1]
    kinds = "id long, label long, q array<double>, anchor boolean, sums array<double>, devs array<double>"
    return store(once.mapInArrow(lambda b: _index(b, width), kinds), "segments"), width


def _block(column: str, blocks: int, seed: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(blocks))


def _pairs(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int) -> DataFrame:
    """Each block of anchors with each block of rows, sorted: the anchors of a pair first, then its rows."""
    def every(n: int, other: Column, first: bool) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * row_blocks + other) if first else (other * row_blocks + i)).cast("array<bigint>"))

    left = anchors.select("id", "label", "q", "sums", "devs", "bounds", F.lit(0).alias("kind"),
                          every(row_blocks, _block("id", anchor_blocks, "a"), False).alias("pair"))
    right = rows.select("id", "label", "q", "sums", "devs", F.lit(None).cast("array<double>").alias("bounds"), F.lit(1).alias("kind"),
                        every(anchor_blocks, _block("id", row_blocks, "r"), True).alias("pair"))
    return left.unionByName(right).repartition("pair").sortWithinPartitions("pair", "kind", "id")


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
                   anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where `anchor` holds. An anchor's positives are its best rows of the same label, a positive's negatives
    the best rows of other labels whose score is `lowest` to `highest` percent of the positive's; higher scores come
    first, ties by the smaller key. Rows with a NULL key, label, vector or component, or a component that is not
    finite, take no part; of rows with one key the one of the least label and vector does; shorter vectors
    end in zeros; an empty table, or one without anchors or positives, gives no rows.
    """
    index, width = segment_index(rows, key, vector, label, anchor)
    counts = index.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    anchor_blocks = max(1, math.ceil(counts["anchors"] / anchor_block))
    row_blocks = max(1, math.ceil(counts["rows"] / row_block), min(2 * cores, math.ceil(counts["rows"] / _ROWS)))
    anchors = index.filter("anchor")

    paired = _pairs(anchors.withColumn("bounds", F.lit(None).cast("array<double>")), index, anchor_blocks, row_blocks)
    found = paired.mapInArrow(lambda b: _nearest(b, width, positives), "anchor long, id long, score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = store(found.withColumn("nth", F.row_number().over(best) - 1).filter(F.col("nth") < positives), "positives")

    bounds = near.groupBy(F.col("anchor").alias("_a")).agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("_s"))
    goals = anchors.join(bounds, F.col("id") == F.col("_a")).withColumn("bounds", F.transform("_s", lambda s: s["score"].cast("double")))
    paired = _pairs(goals, index, anchor_blocks, row_blocks)
    found = paired.mapInArrow(lambda b: _between(b, width, positives, negatives, lowest, highest), "anchor long, nth int, id long, score long")
    best = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    chosen = near.select(F.col("anchor").alias("_a"), F.col("nth").alias("_n"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = ranked.join(chosen, (F.col("anchor") == F.col("_a")) & (F.col("nth") == F.col("_n")))
    return joined.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
                         "positive_score", F.col("score").alias("negative_score"))
