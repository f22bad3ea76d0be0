"""Documents to sentence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.functions.text import sentences
from pactlens.operators.sizing import spread


def segment_sentences(docs: DataFrame, text: str = "text", keys: tuple = ("doc_id",)) -> DataFrame:
    """(keys..., sent_idx, sentence): one row per non-blank sentence, 0-based order.

    A narrow transformation: no shuffle beyond the optional spread of a small input.
    """
    pieces = spread(docs.select(*keys, text))
    return pieces.select(*keys, F.posexplode(sentences(F.col(text))).alias("sent_idx", "sentence"))


def sentence_array(docs: DataFrame, text: str = "text", name: str = "sentences") -> DataFrame:
    """One row per document with its sentences as an array (documents without any keep [])."""
    return spread(docs).withColumn(name, sentences(F.col(text)))
