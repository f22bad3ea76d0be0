"""Repeated paragraphs across documents by MinHash banding.

There are two kinds of paragraphs. A line of MIN_WORDS words or more is one as it stands: lines whose
five-word shingle sets agree in a band of MinHash values are candidates; candidates that hang together are
gathered by connected components and verified by their exact Jaccard similarity; verified links form the clusters, of
which the first occurrence stays. The number of bands follows from the recall asked for.

A passage may also repeat inside other lines, or broken into lines in another way. So the words of a whole text, whatever
its lines, are cut into pieces where their content says so: before a word whose three-word hash is the least among
the REACH on either side, or at equal steps where no word is that for long. A passage holds the same cuts wherever it stands but for REACH words at its ends. Pieces are
too short to differ and be alike, so their band is their whole content: equal pieces collide, and runs of repeated pieces
of MIN_WORDS words or more are passages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.components import components
from pactlens.llm.words import mix, pieces
from pactlens.sources.scratch import store

WIDTH = 5
SIMILARITY = 0.8
MIN_WORDS = 25
REACH = 5
BAND_ROWS = 4
RECALL = 0.99
GROUP_SHINGLES = 1 << 20  # shingles of a candidate group that make a block; a task verifies two at once
_NEXT = np.uint64(0x9FB21C651E98DF25)
_BATCH = 20_000


def band_count(similarity: float = SIMILARITY, rows: int = BAND_ROWS, recall: float = RECALL) -> int:
    """Fewest bands of `rows` values that find a pair of this similarity with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


class Texts(NamedTuple):
    """Whole texts of a chunk: each word's row, hash and line, rows ascending."""
    row: np.ndarray
    h: np.ndarray
    line: np.ndarray

    def first(self) -> np.ndarray:
        """Whether a word begins its row."""
        return np.concatenate(([True], self.row[1:] != self.row[:-1])) if len(self.row) else np.zeros(0, bool)


def whole_texts(column: pa.Array) -> Iterator[Texts]:
    """The words of each text in one chunk: a text that is longer than a piece of the tokeniser is put together."""
    held: list[tuple] = []
    carried = 0
    for piece in pieces(column):
        breaks = np.flatnonzero(piece.data == 10)
        before = np.searchsorted(breaks, piece.bounds[:-1])
        line = np.searchsorted(breaks, piece.start) - before[piece.row - piece.first]
        if held:
            line = line + np.where(piece.row == piece.first, carried, 0)
        part = (piece.row, piece.hashes(), line)
        if piece.goes_on:
            # The row that goes on is the last one, and alone in its piece where it began in an earlier one.
            own = len(breaks) - int(before[-1])
            carried = carried + own if held and piece.first == piece.last else own
            held.append(part)
            continue
        held.append(part)
        yield Texts(*(np.concatenate(x) for x in zip(*held)))
        held, carried = [], 0


def _spans(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the runs that begin where `new` holds."""
    start = np.flatnonzero(new)
    return start, np.diff(np.concatenate((start, [len(new)])))


def _content(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each span's words in their order."""
    place = (np.arange(len(h)) - np.repeat(start, size)).astype(np.uint64)
    return mix(np.add.reduceat(mix(h + place * _NEXT), start) + size.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    run = h[:max(0, len(h) - width + 1)].copy()
    for k in range(1, width):
        run = mix(run * _NEXT + h[k:k + len(run)])
    return run


def lines(texts: Texts, min_words: int, width: int) -> tuple:
    """(row, line, words, id, shingles, first): lines of enough words, of any length, each one unit.

    `shingles` holds the hashes of all paragraphs, `first` each one's first place in it.
    """
    start, size = _spans(texts.first() | np.concatenate(([False], texts.line[1:] != texts.line[:-1]))[:len(texts.row)])
    ids = _content(texts.h, start, size)
    big = size >= min_words
    start, size, ids = start[big], size[big], ids[big]
    counts = size - width + 1
    first = np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int64)
    places = np.repeat(start - first, counts) + np.arange(counts.sum())
    return texts.row[start], texts.line[start], size, ids, _shingles(texts.h, width)[places], first


def content_pieces(texts: Texts, reach: int = REACH) -> tuple:
    """(row, start, words, id): the pieces of each text, `start` in words of the text."""
    n = len(texts.h)
    new = texts.first()
    begins = np.flatnonzero(new)
    if n > 2:
        grams = np.concatenate((_shingles(texts.h, 3), texts.h[-2:]))
        cut = np.ones(n, bool)
        for k in range(1, reach + 1):
            same = texts.row[k:] == texts.row[:-k]
            cut[k:] &= ~same | (grams[k:] < grams[:-k])
            cut[:-k] &= ~same | (grams[:-k] <= grams[k:])
        new = new | cut
        # Words that go round in circles have no cuts: such a stretch is cut at equal steps from its beginning.
        start, size = _spans(new)
        step = 4 * reach
        parts = np.where(size > 2 * step, size // step, 1)
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        new[np.repeat(start, parts) + place * step] = True
    start, size = _spans(new)
    ids = _content(texts.h, start, size)
    return texts.row[start], start - begins[np.searchsorted(begins, start, "right") - 1], size, ids


def _occurrences(batches: Iterator[pa.RecordBatch], bands: int, rows: int, min_words: int, width: int):
    """(pid, key, check, line, words, bands): lines with their bands, pieces with their first word for the line and no bands."""
    seeds = _seeds(bands * rows)
    for batch in batches:
        keys_of, checks_of = batch.column("key"), batch.column("check")

        def out(row, place, size, pid, keys):
            at = pa.array(row)
            empty = keys is None
            offsets = pa.array(np.zeros(len(row) + 1, np.int32) if empty else np.arange(0, keys.size + 1, bands, dtype=np.int32))
            values = pa.array(np.zeros(0, np.int64) if empty else keys.ravel().view(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(pid.view(np.int64)), keys_of.take(at), checks_of.take(at), pa.array(place.astype(np.int64)),
                 pa.array(size.astype(np.int32)), pa.array(np.full(len(row), empty)), pa.ListArray.from_arrays(offsets, values)],
                ["pid", "key", "check", "place", "words", "piece", "bands"])

        for texts in whole_texts(batch.column(0)):
            if not len(texts.row):
                continue
            row, line, size, pid, shingles, first = lines(texts, min_words, width)
            if len(row):
                keys = np.empty((len(row), bands), dtype=np.uint64)
                for b in range(bands):
                    band = np.full(len(row), b, dtype=np.uint64)
                    for r in range(rows):
                        x = shingles * seeds[b * rows + r]
                        x ^= x >> np.uint64(32)
                        band = mix(band * _NEXT + np.minimum.reduceat(x * seeds[r], first))
                    keys[:, b] = band
                yield out(row, line, size, pid, keys)
            yield out(*content_pieces(texts), None)


def _fetch(batches: Iterator[pa.RecordBatch], min_words: int, width: int):
    """(pid, group, shingles) of the wanted paragraphs of each document, their shingles sorted and distinct."""
    for batch in batches:
        wanted = [{w["pid"]: w["group"] for w in ws} for ws in batch.column("wanted").to_pylist()]
        pids, groups, sets = [], [], []
        for texts in whole_texts(batch.column(0)):
            row, _, size, pid, shingles, first = lines(texts, min_words, width)
            counts = size - width + 1
            for r, p, f, c in zip(row.tolist(), pid.view(np.int64).tolist(), first.tolist(), counts.tolist()):
                group = wanted[r].pop(p, None)
                if group is not None:
                    pids.append(p)
                    groups.append(group)
                    sets.append(np.unique(shingles[f:f + c]))
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pids, pa.int64()), pa.array(groups, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            ["pid", "group", "shingles"])


def jaccard_of(both: np.ndarray, mine: int, theirs: np.ndarray) -> np.ndarray:
    return both / (mine + theirs - both)


def cosine_of(both: np.ndarray, mine: int, theirs: np.ndarray) -> np.ndarray:
    return both / np.sqrt(mine * theirs.astype(float))


def similar(pids: np.ndarray, flat: np.ndarray, sizes: np.ndarray, similarity: float, measure=jaccard_of) -> list[tuple[int, int]]:
    """Edges that connect what has the similarity or more, of sets given as sorted runs of `flat`.

    A breadth-first search: what is reached leaves the search, so copies of one text cost one step.
    """
    edges, alive = [], np.arange(len(pids))
    owner = np.repeat(np.arange(len(pids)), sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    while len(alive) > 1:
        front, alive = [int(alive[0])], alive[1:]
        while front and len(alive):
            x = front.pop()
            mine = flat[begin[x]:begin[x + 1]]
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.bincount(owner[mine[at] == flat], minlength=len(pids))[alive]
            hit = measure(both, int(sizes[x]), sizes[alive]) >= similarity - 1e-9
            edges += [(int(pids[x]), int(pids[y])) for y in alive[hit]]
            front += alive[hit].tolist()
            alive = alive[~hit]
            keep = np.isin(owner, alive) if len(alive) * 2 < len(np.unique(owner)) else None
            if keep is not None and front:
                keep |= np.isin(owner, front)
            if keep is not None:
                # Rows that have left need no further comparison.
                flat_sizes = np.where(np.isin(np.arange(len(pids)), owner[keep]), sizes, 0)
                flat, owner = flat[keep], owner[keep]
                begin = np.concatenate(([0], np.cumsum(flat_sizes)))
    return edges


def _verify(batches: Iterator[pa.RecordBatch], similarity: float, measure):
    """(a, b) of the verified links in each group of rows (slot, pid, shingles) sorted by slot."""
    held: list[tuple] = []
    open_slot = None

    def close() -> list[tuple[int, int]]:
        unique = {p: s for p, s in held}
        if len(unique) < 2:
            return []
        sets = list(unique.values())
        return similar(np.array(list(unique), dtype=np.int64), np.concatenate(sets), np.array([len(s) for s in sets]), similarity, measure)

    out: list[tuple[int, int]] = []
    for batch in batches:
        slots, pids = batch.column("slot").to_pylist(), batch.column("pid").to_pylist()
        column = batch.column("shingles")
        flat, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
        for i, (slot, p) in enumerate(zip(slots, pids)):
            if slot != open_slot:
                out += close()
                held, open_slot = [], slot
            held.append((p, flat[offsets[i]:offsets[i + 1]].copy()))
        if len(out) >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
            out = []
    out += close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])


def verified_links(sets: DataFrame, similarity: float = SIMILARITY, most: int = GROUP_SHINGLES, measure=jaccard_of) -> DataFrame:
    """(a, b) links from (pid, group, shingles).

    A group of more than `most` shingles is cut into blocks by a hash and every two blocks meet in a
    task of their own, so a task holds about two blocks, and no pair is left out. Groups of thousands of texts
    of ordinary length are one block, whose sets move once.
    """
    blocks = sets.groupBy("group").agg((F.floor(F.sum(F.size("shingles")) / F.lit(most)) + 1).cast("int").alias("blocks"))
    rows = sets.join(blocks.withColumnRenamed("group", "_g"), F.col("group") == F.col("_g")).drop("_g")
    mine = F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64(
        F.col("group"), F.least(F.col("mine"), j), F.greatest(F.col("mine"), j)))
    spread = rows.withColumn("mine", mine).select(F.explode(meets).alias("slot"), "pid", "shingles")
    return (spread.repartition("slot").sortWithinPartitions("slot")
            .mapInArrow(lambda b: _verify(b, similarity, measure), "a long, b long"))


def _similar_lines(source: DataFrame, found: DataFrame, similarity: float, min_words: int, width: int, most: int) -> DataFrame:
    """(pid, cluster) of lines that verified links join."""
    keyed = found.select(F.explode("bands").alias("band"), "pid")
    shared = keyed.groupBy("band").agg(F.min("pid").alias("low"), F.max("pid").alias("high")).filter("low <> high").select("band", "low")
    stars = keyed.join(shared, "band").filter("pid <> low").select(F.col("pid").alias("a"), F.col("low").alias("b"))
    groups = components(stars)
    # One text that holds a wanted line gives its shingles; texts are named by key and hash, so a hot key is spread.
    where = found.groupBy("pid").agg(F.min(F.struct("key", "check")).alias("at")).select("pid", "at.*")
    wanted = (where.join(groups.select(F.col("node").alias("pid"), F.col("component").alias("group")), "pid")
              .groupBy(F.col("key").alias("_k"), F.col("check").alias("_c")).agg(F.collect_list(F.struct("pid", "group")).alias("wanted")))
    fetched = source.join(wanted, F.col("key").eqNullSafe(F.col("_k")) & (F.col("check") == F.col("_c"))).select("text", "wanted")
    sets = store(fetched.mapInArrow(lambda b: _fetch(b, min_words, width), "pid long, group long, shingles array<long>").dropDuplicates(["pid"]), "shingles")
    return components(verified_links(sets, similarity, most)).withColumnRenamed("node", "pid").withColumnRenamed("component", "cluster")


def _again(places: DataFrame, cluster: str) -> DataFrame:
    """Places (key, check, place, ...) of clusters with several, but for each one's first: + kept (key, place)."""
    many = places.groupBy(F.col(cluster).alias("_many")).agg(F.count("*").alias("n")).filter("n > 1").select("_many")
    several = places.join(many, F.col(cluster) == F.col("_many")).drop("_many")
    first = several.groupBy(F.col(cluster).alias("_c")).agg(F.min(F.struct("key", "place", "check")).alias("kept"))
    joined = several.join(first, F.col(cluster) == F.col("_c")).drop("_c")
    here = F.col("key").eqNullSafe(F.col("kept.key")) & (F.col("place") == F.col("kept.place")) & (F.col("check") == F.col("kept.check"))
    return joined.filter(~here)


def repeated_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                        min_words: int = MIN_WORDS, width: int = WIDTH, rows: int = BAND_ROWS,
                        recall: float = RECALL, most: int = GROUP_SHINGLES) -> DataFrame:
    """key, kind, line, first_word, n_words, cluster, kept_<key>, kept_line, kept_word: what repeats earlier text.

    Kind `line`: a line like an earlier one, named by its number from 0. Kind `passage`: the words from first_word (from 0, lines
    do not matter) on repeat earlier ones piece by piece, in this document or another; kept_word is where the first
    piece stands. Of a cluster the paragraph of the smallest key and place stays and is named in each row. NULL and
    empty texts have no paragraphs; a row that occurs twice counts once, so it removes nothing; documents with a
    NULL key come first; an empty table gives no rows; other columns of `docs` are not read.
    """
    bands = band_count(similarity, rows, recall)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(text).alias("text"), F.col(key).alias("key"), F.xxhash64(text).alias("check"))
    found = store(source.mapInArrow(lambda b: _occurrences(b, bands, rows, min_words, width),
                                    f"pid long, key {kind}, check long, place long, words int, piece boolean, bands array<long>"), "paragraphs")
    columns = ["pid", "key", "check", "place", "words"]
    places = found.filter("NOT piece").select(*columns).distinct()
    clusters = _similar_lines(source, found.filter("NOT piece"), similarity, min_words, width, most)
    named = places.join(clusters, "pid", "left").withColumn("cluster", F.coalesce("cluster", "pid"))
    again = _again(store(named, "clusters"), "cluster")
    of_lines = again.select(
        F.col("key").alias(key), F.lit("line").alias("kind"), F.col("place").alias("line"), F.lit(None).cast("bigint").alias("first_word"),
        F.col("words").cast("bigint").alias("n_words"), "cluster", F.col("kept.key").alias(f"kept_{key}"),
        F.col("kept.place").alias("kept_line"), F.lit(None).cast("bigint").alias("kept_word"))

    # Most pieces occur once and leave before their places move.
    found_pieces = found.filter("piece").select(*columns)
    many = found_pieces.groupBy("pid").agg(F.count("*").alias("n")).filter("n > 1").select("pid")
    repeats = _again(found_pieces.join(many, "pid").distinct(), "pid")
    text_of = Window.partitionBy("key", "check").orderBy("place")
    runs = repeats.withColumn("_new", F.coalesce(F.lag(F.col("place") + F.col("words")).over(text_of) != F.col("place"), F.lit(True)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(text_of))
    passages = runs.groupBy("key", "check", "_run").agg(
        F.min("place").alias("first_word"), F.sum("words").alias("n_words"), F.min_by(F.struct("pid", "kept"), "place").alias("at"))
    of_passages = passages.filter(F.col("n_words") >= min_words).select(
        F.col("key").alias(key), F.lit("passage").alias("kind"), F.lit(None).cast("bigint").alias("line"), "first_word", "n_words",
        F.col("at.pid").alias("cluster"), F.col("at.kept.key").alias(f"kept_{key}"), F.lit(None).cast("bigint").alias("kept_line"),
        F.col("at.kept.place").alias("kept_word"))
    return of_lines.unionByName(of_passages)
