"""TF-IDF over 1..n-grams: sub-linear tf, smoothed idf, L2-normalised rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.functions.text import ngrams, term_counts, tokens
from pactlens.operators.hold import hold
from pactlens.sources.scratch import store

MAX_FEATURES = 20_000
WEIGHTS = T.ArrayType(T.StructType([T.StructField("term_idx", T.IntegerType()), T.StructField("weight", T.DoubleType())]))


def with_terms(df: DataFrame, text: str = "sentence", n_max: int = 2) -> DataFrame:
    """Add `_terms`, the 1..n_max-grams of the text.

    Tokens are read many times by the n-grams, so each step is held.
    """
    tokenised = hold(df, _tokens=tokens(F.col(text)))
    return hold(tokenised, _terms=ngrams(F.col("_tokens"), n_max)).drop("_tokens")


def term_rows(df: DataFrame, keys: tuple = (), text: str = "sentence", n_max: int = 2) -> DataFrame:
    """(keys..., term, tf): term counts of each row, counted inside the row."""
    grams = with_terms(df.select(*keys, text), text, n_max)
    return grams.select(*keys, F.inline(term_counts(F.col("_terms"))))


def term_batches(n_max: int):
    """Arrow batches of (_tokens) to (term, cf, df) counted within each batch, and a NULL term with its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, terms = _coded(batch.column("_tokens"), n_max)
            cf = np.bincount(code, minlength=len(terms))
            once = np.unique(code * batch.num_rows + row) // max(batch.num_rows, 1)
            df = np.bincount(once, minlength=len(terms))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([terms, pa.nulls(1, pa.string())]), pa.array(np.append(cf, batch.num_rows)),
                pa.array(np.append(df, batch.num_rows))], ["term", "cf", "df"])
    return run


def _terms(token_lists: pa.ListArray, n_max: int) -> tuple[np.ndarray, pa.Array]:
    """(row, term): all 1..n_max-grams of a batch of token arrays."""
    words = token_lists.flatten()
    row = pc.list_parent_indices(token_lists).to_numpy(zero_copy_only=False).astype(np.int64)
    rows, terms, grams = [row], [words], words
    for n in range(2, n_max + 1):
        # The (n-1)-gram at each place and the word that follows it; places stay, so grams over a row's end are cut last.
        grams = pc.binary_join_element_wise(grams.slice(0, max(len(words) - n + 1, 0)), words.slice(n - 1), " ")
        inside = row[:len(grams)] == row[n - 1:]
        rows.append(row[:len(grams)][inside])
        terms.append(grams.filter(pa.array(inside)))
    return np.concatenate(rows), pa.concat_arrays(terms)


def _coded(token_lists: pa.ListArray, n_max: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, terms): the distinct terms of a batch, and each occurrence by its place among them."""
    row, terms = _terms(token_lists, n_max)
    coded = terms.dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class Weigher:
    """The TF-IDF weights of a batch of token arrays, by a vocabulary of at most `max_features` terms."""

    def __init__(self, vocab: list, n_max: int):
        self.n_max = n_max
        self.terms = [r["term"] for r in vocab]
        self.idf = np.array([r["idf"] for r in vocab], dtype=np.float64)

    def __call__(self, token_lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term_idx, weight), sorted; each row's weights have length one."""
        row, code, terms = _coded(token_lists, self.n_max)
        place = pc.index_in(terms, value_set=pa.array(self.terms, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = place[code]
        known = at >= 0
        size = max(len(self.terms), 1)
        cells, tf = np.unique(row[known] * size + at[known], return_counts=True)
        row, at = cells // size, cells % size
        raw = (1.0 + np.log(tf)) * self.idf[at]
        norm = np.sqrt(np.bincount(row, raw * raw, len(token_lists)))
        return row, at, raw / norm[row]


def vocabulary(df: DataFrame, text: str = "sentence", n_max: int = 2,
               max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, term_idx, cf, df, idf): the most frequent terms of the corpus.

    Terms are counted in each Arrow batch first, so one hash aggregation over the batches' distinct terms yields
    the corpus and the document frequency; a NULL term counts the rows themselves. A frequent term sends
    one row per batch at most. The final numbering sees at most `max_features` rows.
    """
    words = df.select(tokens(F.col(text)).alias("_tokens"))
    counts = store(words.mapInArrow(term_batches(n_max), "term string, cf bigint, df bigint").groupBy("term").agg(
        F.sum("cf").alias("cf"), F.sum("df").alias("df")), "terms")
    row = counts.filter("term IS NULL").first()
    n_rows = row["df"] if row else 0
    top = counts.filter("term IS NOT NULL").orderBy(F.desc("cf"), "term").limit(max_features)
    idf = F.log(F.lit(1.0 + n_rows) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    index = F.row_number().over(Window.orderBy("term")) - 1
    return top.select("term", index.alias("term_idx"), "cf", "df", idf.alias("idf"))


def idf_rows(vocab: DataFrame, max_features: int = MAX_FEATURES) -> list:
    """The vocabulary as (term, idf) rows in term_idx order; at most `max_features`."""
    return vocab.select("term_idx", "term", "idf").filter(F.col("term_idx") < max_features).orderBy("term_idx").collect()


def with_weights(df: DataFrame, vocab: list, text: str = "sentence", n_max: int = 2,
                 name: str = "weights") -> DataFrame:
    """Add ARRAY<STRUCT<term_idx, weight>>: the L2-normalised TF-IDF row, by term_idx.

    The vocabulary, at most the parameter `max_features`, goes to every task, so each row is weighted
    where it is, a batch at a time: no explode, no regrouping, no shuffle.
    """
    if not vocab:
        return df.withColumn(name, F.array().cast("array<struct<term_idx:int,weight:double>>"))
    weigh = Weigher(vocab, n_max)

    def run(batch: pa.RecordBatch) -> pa.Array:
        row, at, weight = weigh(batch.column("_tokens"))
        ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
        cells = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(weight)], ["term_idx", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), cells)

    return with_batches(df, text, run, name, WEIGHTS)


def with_batches(df: DataFrame, text: str, run, name: str, kind: T.DataType) -> DataFrame:
    """Add the column `name` that `run` makes of an Arrow batch with the tokens of the text as `_tokens`."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], run(batch)], [*batch.schema.names[:-1], name])

    staged = df.withColumn("_tokens", tokens(F.col(text)))
    return staged.mapInArrow(step, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def tfidf(df: DataFrame, keys: tuple, text: str = "sentence", n_max: int = 2,
          max_features: int = MAX_FEATURES) -> DataFrame:
    """(keys..., term, weight) of every row and vocabulary term."""
    rows = idf_rows(vocabulary(df, text, n_max, max_features), max_features)
    names = F.from_json(F.lit(json.dumps([r["term"] for r in rows])), "array<string>")
    weights = with_weights(df.select(*keys, text), rows, text, n_max)
    return weights.select(*keys, F.inline("weights")).select(
        *keys, F.get(names, F.col("term_idx")).alias("term"), "weight")


def vector_struct(weights: Column, size: int) -> Column:
    """The stored form of an ML sparse vector, of a sorted weight array.

    Written to a file and read back with the vector type it is a vector.
    """
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.transform(weights, lambda x: x["term_idx"]).alias("indices"),
        F.transform(weights, lambda x: x["weight"]).alias("values"))
