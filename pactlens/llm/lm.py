"""Language-model scores from n-gram counts in a log-frequency Bloom filter.

The filter holds the quantised counts of the training tokens and of their pairs. It is broadcast
in groups of segments of bounded size; workers read counts back by repeated probes and
interpolate them: P(w | v) = (c(vw) + mu P(w)) / (c(v) + mu), with mu chosen by the leave-one-out
likelihood of all training texts. P(w) shares the Good-Turing mass of single words among unseen kinds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm import bloom
from pactlens.llm.words import mix, pieces
from pactlens.sources.scratch import store

HOT_WORDS = 1 << 17          # commonest words whose exact counts are broadcast; the others are joined
FLUSH_TOKENS = 1_000_000     # tokens a task counts before it hands on its sums
MUS = (1.0, 8.0, 64.0, 512.0, 4096.0, 1e5, 1e7)
END = ""                     # the end token; no word is empty

_END_HASH = np.uint64(0x51ED270B7F4A7C15)
_START_HASH = np.uint64(0xA0761D6478BD642F)
_PAIR = np.uint64(0xE7037ED1A0B428DB)
_ONE = np.uint64(0x8EBC6AF09C88C6E3)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 7; a NULL key is as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + word)


def unigram_keys(word: np.ndarray) -> np.ndarray:
    return mix(word ^ _ONE)


def _sums(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(keys), return_counts=True)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): token counts of a task's texts, the end token once a text."""
    parts: list[tuple] = []
    texts = waiting = 0

    def flush() -> pa.RecordBatch:
        hashes, counts = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
        names = pa.concat_arrays([p[2] for p in parts]) if parts else pa.array([], pa.string())
        _, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        sums = np.bincount(where, weights=counts, minlength=len(first)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([names.take(pa.array(first)), pa.array([END])]), pa.array(np.append(sums, texts))], ["word", "n"])

    for batch in batches:
        texts += batch.num_rows
        for piece in pieces(batch.column(0)):
            hashes, first, n = np.unique(piece.hashes(), return_index=True, return_counts=True)
            parts.append((hashes, n, piece.texts(first)))
            waiting += len(piece.row)
            if waiting >= FLUSH_TOKENS:
                yield flush()
                parts, texts, waiting = [], 0, 0
    if texts or parts:
        yield flush()


def token_pairs(piece, carried: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, before, token, carried on): hashes of the piece's tokens; the end token follows a row's last word.

    `carried` holds the last word of a row that the former piece began.
    """
    rows = np.arange(piece.first, piece.last + 1)
    ended = rows[:-1] if piece.goes_on else rows
    row = np.concatenate((piece.row, ended))
    token = np.concatenate((hashes, np.full(len(ended), _END_HASH)))
    order = np.argsort(row, kind="stable")
    row, token = row[order], token[order]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    new = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=bool)
    before[new] = _START_HASH
    if len(row) and len(carried) and row[0] == piece.first:
        before[0] = carried[-1]
    if piece.goes_on:
        carry = token[-1:] if len(row) and row[-1] == piece.last else carried
    else:
        carry = token[:0]
    return row, before, token, carry


def count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): counts of token and pair keys, summed over up to FLUSH_TOKENS tokens."""
    parts: list[np.ndarray] = []
    waiting = 0

    def flush() -> pa.RecordBatch:
        keys, n = _sums(parts)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    for batch in batches:
        carry = np.zeros(0, dtype=np.uint64)
        for piece in pieces(batch.column(0)):
            _, before, token, carry = token_pairs(piece, carry, piece.hashes())
            parts += [unigram_keys(token), pair_keys(before, token)]
            waiting += len(token)
            if waiting >= FLUSH_TOKENS:
                yield flush()
                parts, waiting = [], 0
    if parts:
        yield flush()


def _token_levels(column: pa.Array, filters: bloom.Filter) -> Iterator[tuple]:
    """(piece, hashes, row, levels) by piece; levels are (token's, pair's), 0 where not found."""
    carry = np.zeros(0, dtype=np.uint64)
    for piece in pieces(column):
        hashes = piece.hashes()
        row, before, token, carry = token_pairs(piece, carry, hashes)
        unique, where = np.unique(token, return_inverse=True)
        one = filters.levels(unigram_keys(unique))[where]
        yield piece, hashes, row, np.stack((one, filters.levels(pair_keys(before, token))), axis=1)


def _probe(part):
    """Task function: note the levels of the tokens whose segments are in the group, beside those noted before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = bloom.Filter(*part.value)
        for batch in batches:
            rows, parts = [], []
            for _, _, row, levels in _token_levels(batch.column(0), filters):
                rows.append(row)
                parts.append(levels)
            row, levels, noted = np.concatenate(rows), np.concatenate(parts), _noted(batch)
            if noted is not None:
                levels = np.maximum(levels, noted)  # each key is found in one group alone
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1)) * 2
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(levels.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], batch.schema.names)
    return run


def _noted(batch: pa.RecordBatch) -> np.ndarray | None:
    """Levels that earlier passes noted, of all rows in order; None in the first pass."""
    noted = batch.column("levels")
    if noted.null_count:
        return None
    return np.frombuffer(b"".join(noted.to_pylist()), dtype=np.uint8).reshape(-1, 2)


def unigrams(value: np.ndarray, mass: float, train_tokens: int, singles: int, distinct: int) -> np.ndarray:
    """P of one token by its count: the Good-Turing share of single words goes to the kinds never seen.

    That share is split among as many unseen kinds as there are known ones, and one more; the rest follows the counts,
    which sum to `mass` over the known kinds as the filter holds them.
    """
    unseen = min(0.5, max(singles, 1) / max(train_tokens, 1))
    return np.where(value > 0, (1 - unseen) * value / max(mass, 1), unseen / (distinct + 1))


def score_tables(train_tokens: int, texts: int, singles: int, distinct: int, mass: float) -> tuple[int, np.ndarray, np.ndarray]:
    """log10 P and its leave-one-out form for each mu by (token's level, former token's, pair's).

    The former token's level `top` stands for the start of a text, seen once a text. Without its own occurrence
    a word seen once is an unknown one.
    """
    top = int(bloom.levels(np.array([max(train_tokens, 1)]))[0]) + 2
    value = bloom.level_value(top)[:top]
    c1, cv, c2 = np.meshgrid(value, np.append(value, texts), value, indexing="ij")
    c2 = np.minimum(np.minimum(c2, c1), cv)
    p1, p1_less = (unigrams(c, mass, train_tokens, singles, distinct) for c in (c1, np.maximum(c1 - 1, 0)))
    model = [np.log10((c2 + mu * p1) / (cv + mu)).ravel() for mu in MUS]
    loo = [np.log10((np.maximum(c2 - 1, 0) + mu * p1_less) / (np.maximum(cv - 1, 0) + mu)).ravel() for mu in MUS]
    return top, np.array(model), np.array(loo)


def _score(part, hot, tables):
    """Task function: the figures and the rare words of each text, with the last group of the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = bloom.Filter(*part.value)
        hot_hash, hot_log = hot.value
        top, model_table, loo_table = tables.value
        for batch in batches:
            n = batch.num_rows
            tokens, known, logs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            model, loo = np.zeros((n, len(MUS))), np.zeros((n, len(MUS)))
            rare, noted, seen, goes_on, last_level = [], _noted(batch), 0, False, 0
            for piece, all_hashes, row, levels in _token_levels(batch.column(0), filters):
                if noted is not None:
                    levels = np.maximum(levels, noted[seen:seen + len(levels)])
                seen += len(levels)
                levels = levels.astype(np.int64)
                if len(row):
                    begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                    former = np.concatenate(([last_level], levels[:-1, 0]))
                    former[begin[int(goes_on):]] = top
                    at = (levels[:, 0] * (top + 1) + former) * top + levels[:, 1]
                    for k in range(len(MUS)):
                        model[row[begin], k] += np.add.reduceat(model_table[k][at], begin)
                        loo[row[begin], k] += np.add.reduceat(loo_table[k][at], begin)
                    last_level = levels[-1, 0]
                    goes_on = piece.goes_on
                hashes, first, where = np.unique(all_hashes, return_index=True, return_inverse=True)
                is_hot, log = np.zeros(len(hashes), bool), np.zeros(len(hashes))
                if len(hot_hash):
                    at = np.minimum(np.searchsorted(hot_hash, hashes), len(hot_hash) - 1)
                    is_hot = hot_hash[at] == hashes
                    log = np.where(is_hot, hot_log[at], 0.0)
                here, count = piece.row - piece.first, piece.last - piece.first + 1
                span = slice(piece.first, piece.last + 1)
                tokens[span] += np.bincount(here, minlength=count)
                known[span] += np.bincount(here, weights=is_hot[where], minlength=count).astype(np.int64)
                logs[span] += np.bincount(here, weights=log[where], minlength=count)
                cold = np.flatnonzero(~is_hot[where])
                pairs, times = np.unique(piece.row[cold] * len(hashes) + where[cold], return_counts=True)
                if len(pairs):
                    rare.append((pairs // len(hashes), piece.texts(first[pairs % len(hashes)]), times))
            train = ~np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), dtype=bool)
            loo *= train[:, None]
            counts = np.bincount(np.concatenate([r for r, _, _ in rare]), minlength=n) if rare else np.zeros(n, np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays([w for _, w, _ in rare]) if rare else pa.array([], pa.string())),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([t for _, _, t in rare]) if rare else [], pa.int64()))]
            flat = pa.array(np.arange(0, n * len(MUS) + 1, len(MUS), dtype=np.int32))
            scores = [pa.ListArray.from_arrays(flat, pa.array(m.ravel())) for m in (model, loo)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("same"), batch.column("held_out"), pa.array(tokens + 1), pa.array(known),
                 pa.array(logs), *lists, *scores],
                ["key", "same", "held_out", "n_tokens", "n_known", "logs", "rare", "times", "model", "loo"])
    return run


def _hot_table(hot: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, log10(n + 1)) of (word, n) rows, by hash."""
    joined = " ".join(hot.column("word").to_pylist())
    hashes = np.concatenate([np.zeros(0, np.uint64)] + [p.hashes() for p in pieces(pa.array([joined]))])
    order = np.argsort(hashes)
    return hashes[order], np.log10(hot.column("n").to_numpy() + 1.0)[order]


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = bloom.GROUP_SEGMENTS,
                words: int = bloom.WORDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, mu of every row.

    The base counts are exact: the commonest words' counts are broadcast, at most `hot_words`, and
    the words beyond are joined. NULL texts are empty and have one token, the end; empty tables
    give no rows; without any training row nothing is known; repeated rows score alike.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(text).alias("text"), F.col(key).alias("key"))
    train = source.filter(~held_out(F.col("key"))).select("text")
    vocabulary = store(train.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    level = 1 + F.floor(F.log("n") / F.log(F.lit(bloom.LEVEL_BASE)))
    total, distinct, singles, texts, entries = vocabulary.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1),
        F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0)), F.coalesce(F.sum(level), F.lit(0))).first()
    log_all = float(np.log10(total + distinct + 1))
    kinds = vocabulary.groupBy(level.cast("int").alias("level")).agg(F.count("*").alias("n")).collect()  # a row a level
    mass = float(sum(r["n"] * bloom.level_value(r["level"])[-1] for r in kinds))

    segments = bloom.segment_count(total + entries, words)  # a pair enters at most once a token
    stored = store(bloom.build(train.mapInArrow(count_keys, "h long, n long"), segments, words), "filter")
    rows = source.select(
        "text", "key", F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))).alias("same"),
        held_out(F.col("key")).alias("held_out"), F.lit(None).cast("binary").alias("levels"))
    hot = vocabulary.filter(F.col("word") != END).orderBy(F.desc("n"), "word").limit(hot_words).toArrow()
    table = spark.sparkContext.broadcast(_hot_table(hot))
    tables = spark.sparkContext.broadcast(score_tables(total, texts, singles, distinct, mass))
    schema = (f"key {docs.schema[key].dataType.simpleString()}, same long, held_out boolean, n_tokens long, n_known long, logs double, "
              "rare array<string>, times array<long>, model array<double>, loo array<double>")
    last = -(-segments // group) - 1
    for i, part in enumerate(bloom.groups(stored, segments, words, group)):
        shared = spark.sparkContext.broadcast(part.plain())
        del part
        if i < last:
            rows = store(rows.mapInArrow(_probe(shared), rows.schema), "levels")
            shared.destroy()
    scored = store(rows.mapInArrow(_score(shared, table, tables), schema), "scored")

    # Words beyond the broadcast ones: one row a text and word; equal rows are summed together and shared out again.
    per = (scored.select("same", F.explode(F.arrays_zip("rare", "times")).alias("x"))
           .select("same", F.col("x.rare").alias("word"), F.col("x.times").alias("times")))
    cold = (per.join(vocabulary.withColumnRenamed("n", "c"), "word").groupBy("same")
            .agg(F.sum("times").alias("known2"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs2"))
            .join(scored.groupBy("same").agg(F.count("*").alias("rows")), "same"))
    sums = scored.filter(~F.col("held_out")).agg(*[F.sum(F.get("loo", F.lit(k))) for k in range(len(MUS))]).first()
    best = int(np.argmax([-np.inf if s is None else s for s in sums]))
    if total == 0:
        best = len(MUS) - 1
    joined = scored.join(cold, "same", "left")
    end_known = F.lit(1 if texts else 0)
    base = (F.col("logs") + F.coalesce(F.col("logs2") / F.col("rows"), F.lit(0.0)) + F.lit(float(np.log10(texts + 1)))
            - F.col("n_tokens") * F.lit(log_all))
    return joined.select(
        F.col("key").alias(key), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce((F.col("known2") / F.col("rows")).cast("bigint"), F.lit(0)) + end_known).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"), base.alias("base_score"),
        F.get("model", F.lit(best)).alias("score"), F.lit(MUS[best]).alias("mu"))
