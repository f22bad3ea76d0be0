"""Language identification by a small convolutional network over bytes, in numpy.

Filters of several widths run over windows of fixed length; the highest response of each filter
goes through a softmax layer. A text's prediction is the mean of its windows' probabilities, so
all of a text counts. The network is trained on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.words import utf8

LENGTH = 256             # bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 12             # of each width
TRAIN_TEXTS = 600        # labelled texts of each language that the network is fitted on, at most
TRAIN_WINDOWS = 4        # windows of each, at even distances over the whole text
EPOCHS = 12
BATCH = 512              # windows that one step of inference holds
UNKNOWN = "und"


class Network(NamedTuple):
    labels: list
    filters: list            # per width: array (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray          # (len(WIDTHS) * FILTERS, labels)
    out_bias: np.ndarray


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; a NULL key is as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def windows(data: np.ndarray) -> np.ndarray:
    """All bytes in rows of LENGTH, the last one filled up with spaces."""
    n = max(1, -(-len(data) // LENGTH))
    out = np.full(n * LENGTH, 32, dtype=np.uint8)
    out[:len(data)] = data
    return out.reshape(n, LENGTH)


def responses(net: Network, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Highest response of each filter (windows, filters) and where it was, by width."""
    best, where = [], []
    for table in net.filters:
        span = rows.shape[1] - len(table) + 1
        total = table[0][rows[:, :span]]
        for k in range(1, len(table)):
            total += table[k][rows[:, k:k + span]]
        where.append(total.argmax(axis=1))
        best.append(np.take_along_axis(total, where[-1][:, None, :], 1)[:, 0])
    return np.concatenate(best, axis=1), where


def pooled(net: Network, rows: np.ndarray) -> np.ndarray:
    """Highest response of each filter, without the places."""
    best = []
    for table in net.filters:
        span = rows.shape[1] - len(table) + 1
        total = table[0].take(rows[:, :span], axis=0)
        for k in range(1, len(table)):
            total += table[k].take(rows[:, k:k + span], axis=0)
        best.append(total.max(axis=1))
    return np.concatenate(best, axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict_windows(net: Network, rows: np.ndarray) -> np.ndarray:
    return np.concatenate([
        _softmax(np.maximum(pooled(net, rows[i:i + BATCH]) + net.bias, 0) @ net.out + net.out_bias)
        for i in range(0, len(rows), BATCH)])


def train(rows: np.ndarray, target: np.ndarray, labels: list, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit by Adam on the cross-entropy, each language weighing the same."""
    rng = np.random.default_rng(seed)
    k, f = len(labels), len(WIDTHS) * FILTERS
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(f, np.float32), rng.normal(0, 0.3, (f, k)).astype(np.float32), np.zeros(k, np.float32)]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = 1.0 / np.maximum(np.bincount(target, minlength=k), 1)
    weight = (weight / weight[target].mean()).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), 64):
            pick = order[low:low + 64]
            net = Network(labels, params[:len(WIDTHS)], *params[len(WIDTHS):])
            x, y = rows[pick], target[pick]
            best, where = responses(net, x)
            hidden = np.maximum(best + net.bias, 0)
            delta = _softmax(hidden @ net.out + net.out_bias)
            delta[np.arange(len(y)), y] -= 1
            delta *= weight[y][:, None] / len(y)
            back = (delta @ net.out.T) * (hidden > 0)
            grads = []
            for i, table in enumerate(net.filters):
                g = np.zeros_like(table)
                own = back[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(len(table)):
                    seen = np.take_along_axis(x, where[i] + j, 1)
                    np.add.at(g[j], (seen, np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]
            step += 1
            for p, g, m, s in zip(params, grads, moment, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= (0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return Network(labels, params[:len(WIDTHS)], *params[len(WIDTHS):])


def training_sample(docs: DataFrame, key: str, text: str, lang: str, texts: int = TRAIN_TEXTS) -> DataFrame:
    """(lang, part, part...): at most `texts` texts of each language, by a hash, as windows spread over each."""
    rows = docs.filter(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    picked = (rows.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"),
                          F.xxhash64(F.col(key), F.lit("train")).alias("_h"), F.length(text).alias("_n")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "key", "_n"))
    step = F.greatest(F.col("_n") - LENGTH, F.lit(0)) / float(max(1, TRAIN_WINDOWS - 1))
    parts = F.array_distinct(F.array(*[F.substr("text", (F.floor(step * i) + 1).cast("int"), F.lit(LENGTH)) for i in range(TRAIN_WINDOWS)]))
    return (picked.select("key", "lang", "_h", "_n", parts.alias("parts"))
            .withColumn("_r", nth).filter(F.col("_r") <= texts).select("lang", F.col("_r").alias("nth"), "parts"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> Network | None:
    """The network fitted on the training sample; None without a labelled text."""
    rows = training_sample(docs, key, text, lang, **how).orderBy("lang", "nth").collect()
    if not rows:
        return None
    labels = sorted({r["lang"] for r in rows})
    data = [(np.frombuffer(p.encode("utf-8"), np.uint8)[:LENGTH], labels.index(r["lang"])) for r in rows for p in r["parts"]]
    return train(np.concatenate([windows(d) for d, _ in data]), np.array([y for _, y in data]), labels)


def predict(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score of every row.

    NULL texts and texts without a letter are `und` with score 0, and so are all without a
    network. Ties go to the first language by name; long texts are read window by window;
    repeated rows are predicted alike.
    """
    spark = docs.sparkSession
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), letters.alias("letters"))
    if net is None:
        return rows.select(F.col("key").alias(key), "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(tuple(net))  # plain values: a broadcast is pickled by reference

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(*shared.value)
        for batch in batches:
            flat, offsets = utf8(batch.column(0))
            letters = batch.column("letters").to_pylist()
            total = np.zeros((batch.num_rows, len(model.labels)))
            waiting, owners, held = [], [], 0

            def settle():
                p = predict_windows(model, np.concatenate(waiting))
                np.add.at(total, np.concatenate(owners), p)

            for r in range(batch.num_rows):
                if not letters[r]:
                    continue
                for low in range(int(offsets[r]), int(offsets[r + 1]), BATCH * LENGTH):
                    own = windows(flat[low:min(int(offsets[r + 1]), low + BATCH * LENGTH)])
                    waiting.append(own)
                    owners.append(np.full(len(own), r))
                    held += len(own)
                    if held >= BATCH:
                        settle()
                        waiting, owners, held = [], [], 0
            if waiting:
                settle()
            n = total.sum(axis=1)
            best = total.argmax(axis=1)
            score = np.where(n > 0, total.max(axis=1) / np.maximum(n, 1), 0.0)
            names = [model.labels[b] if c > 0 else UNKNOWN for b, c in zip(best, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))],
                ["key", "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)
