"""Near duplicates of whole texts: SimHash links and MinHash bands propose, exact similarity decides.

The similarity is the one that SimHash estimates, the cosine of the sets of five-word shingles: the shared ones over
the geometric mean of the sizes. Texts at 0.8 differ in about 13 fingerprint bits, beyond the SimHash index, so
bands of MinHash values add the candidates that it does not promise. A cosine of c means a Jaccard similarity of
c / (2 - c) for sets of equal size, and of c * c at least whatever the sizes; the number of bands follows from the former.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm import simhash
from pactlens.llm.components import components
from pactlens.llm.paragraphs import GROUP_SHINGLES, RECALL, SIMILARITY, WIDTH, band_count, cosine_of, verified_links
from pactlens.llm.prefilter import bitmap, marked
from pactlens.llm.words import mix, pieces
from pactlens.sources.scratch import store

BAND_ROWS = 3
_CHUNK = 1 << 18       # shingles handled at once, where one text has no more
_NEXT = np.uint64(0x9FB21C651E98DF25)


def _set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; fewer words than a shingle are one, none too."""
    if len(h) < width:
        width = max(1, len(h))
        h = h if len(h) else np.zeros(1, dtype=np.uint64)
    run = h[:len(h) - width + 1].copy()
    for k in range(1, width):
        run = mix(run * _NEXT + h[k:k + len(run)])
    return np.unique(run)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(rows, shingle sets) in chunks; each row of the column once."""
    rows, sets, size, held = [], [], 0, []
    for piece in pieces(column):
        h = piece.hashes()
        cut = np.searchsorted(piece.row, np.arange(piece.first, piece.last + 2))
        for r in range(piece.first, piece.last + 1):
            held.append(h[cut[r - piece.first]:cut[r - piece.first + 1]])
            if piece.goes_on:
                continue
            rows.append(r)
            sets.append(_set(np.concatenate(held), width))
            size, held = size + len(sets[-1]), []
            if size >= _CHUNK:
                yield rows, sets
                rows, sets, size = [], [], 0
    if rows:
        yield rows, sets


def _bands(batches: Iterator[pa.RecordBatch], bands: int, width: int):
    seeds = np.random.default_rng(13).integers(1, 1 << 63, bands * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        for rows, sets in _sets(batch.column(0), width):
            flat = np.concatenate(sets)
            first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
            keys = np.empty((len(rows), bands), dtype=np.uint64)
            for b in range(bands):
                keys[:, b] = b
                for seed in seeds[b * BAND_ROWS:(b + 1) * BAND_ROWS]:
                    keys[:, b] = mix(keys[:, b] * _NEXT + np.minimum.reduceat(mix(flat * seed), first))
            offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))], ["pid", "bands"])


def _fetch(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for rows, sets in _sets(batch.column(0), width):
            at = pa.array(rows)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(at), batch.column(2).take(at),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["pid", "group", "shingles"])


def _pid(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def clusters(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL,
             width: int = WIDTH, most: int = GROUP_SHINGLES) -> DataFrame:
    """(node, component): texts, by hash, that verified links join; others have no row."""
    bands = band_count(similarity / (2 - similarity), BAND_ROWS, recall)
    source = docs.select(F.col(text).alias("text"), _pid(text).alias("pid"))
    found = store(source.mapInArrow(lambda b: _bands(b, bands, width), "pid long, bands array<long>").dropDuplicates(["pid"]), "bands")
    keyed = found.select(F.explode("bands").alias("band"), "pid")
    shared = keyed.groupBy("band").agg(F.min("pid").alias("low"), F.max("pid").alias("high")).filter("low <> high").select("band", "low")
    stars = keyed.join(shared, "band").filter("pid <> low").select(F.col("pid").alias("a"), F.col("low").alias("b"))

    prints = store(simhash.fingerprints(source, ("pid",), "text", width).distinct(), "fingerprints")
    linked = components(simhash.links(prints.select("fp").distinct()))
    named = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("pid", F.coalesce("component", "fp").alias("_c"))
    least = named.groupBy("_c").agg(F.min("pid").alias("b"))
    prints = named.join(least, "_c").filter("pid <> b").select(F.col("pid").alias("a"), "b")

    groups = components(stars.union(prints)).select(F.col("node").alias("_p"), F.col("component").alias("group"))
    groups = store(groups, "groups")
    # Most texts have no candidate: they stay where they are.
    likely = marked(source, F.col("pid"), bitmap(groups, "_p")).filter("_likely")
    wanted = likely.join(groups, F.col("pid") == F.col("_p")).select("text", "pid", "group")
    sets = store(wanted.mapInArrow(lambda b: _fetch(b, width), "pid long, group long, shingles array<long>").dropDuplicates(["pid"]), "shingles")
    return components(verified_links(sets, similarity, most, cosine_of))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each cluster, of the smallest key; NULL keys come last, equal keys follow by the text's hash.

    Texts link at a cosine of `similarity` or more of their shingle sets. Texts without words are alike. The columns
    are those of `docs`, whatever their names; an empty table gives no rows. Texts are named by 64-bit
    hashes in the search; a row is dropped only beside a kept one, found under its key and a second, independent hash.
    """
    # Columns of the search stand in structs, apart from those of the table.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("key"),
                       _pid(f"`{text}`").alias("pid"), F.xxhash64(F.lit(1), F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("check"))
    counts = rows.groupBy("key", "pid", "check").agg(F.count("*").alias("n"))
    joined = clusters(docs, text, **how).withColumnRenamed("node", "pid")
    # Texts without a cluster are groups of their own, two of one hash too.
    named = counts.join(joined, "pid", "left").withColumn("lone", F.when(F.col("component").isNull(), F.col("check")))
    first = named.groupBy(F.coalesce("component", "pid"), "lone").agg(
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "pid", "check", "n")).alias("kept"))
    kept = store(first.select(F.col("kept.key").alias("_k"), F.col("kept.pid").alias("_p"), F.col("kept.check").alias("_c"), F.col("kept.n").alias("_n")), "kept")
    picked = rows.join(kept, F.col("key").eqNullSafe(F.col("_k")) & (F.col("pid") == F.col("_p")) & (F.col("check") == F.col("_c")))
    again = picked.filter("_n > 1").withColumn("_nth", F.row_number().over(Window.partitionBy("_k", "_p", "_c").orderBy("_p"))).filter("_nth = 1")
    return picked.filter("_n = 1").select("row.*").unionByName(again.select("row.*"))
