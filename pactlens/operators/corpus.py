"""Labelled corpora: cleaning, union, de-duplication, conflicts and label mapping.

"First seen" is always explicit: rows carry (source_rank, seq) and ties are resolved
by that order, never by the physical row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.config import NONE_LABEL
from pactlens.functions.risk import contains_any
from pactlens.functions.text import clean, strip
from pactlens.operators.hold import hold
from pactlens.operators.sizing import broadcast_if_small, spread
from pactlens.taxonomy import (
    PROVISION_TO_LABEL, QUESTION_RULES, TITLE_TO_LABEL, mapping_frame)

ORDER = ("source_rank", "seq")
MIN_ANSWER_CHARS = 20
WIDE = "1" + "0" * 30  # a rank counts so many positions


def clean_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Clean the text columns and drop rows where any of them is blank."""
    held = hold(spread(df), **{f"_clean_{c}": clean(F.col(c)) for c in columns})
    kept = held.filter(" AND ".join(f"`_clean_{c}` != ''" for c in columns))
    return kept.select(*[F.col(f"_clean_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def merge_corpora(sources: list) -> DataFrame:
    """UNION ALL of (name, DataFrame) pairs, earlier sources first in precedence.

    A missing source (None) is skipped, a missing `source` column gets the name.
    """
    parts = []
    for rank, (name, df) in enumerate(sources):
        if df is None:
            continue
        tagged = df if "source" in df.columns else df.withColumn("source", F.lit(name))
        parts.append(tagged.withColumn("source_rank", F.lit(rank)))
    if not parts:
        raise ValueError("no source found")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _order(order: tuple) -> Column:
    """The order columns, (seq) or (source_rank, seq), as one number: an aggregation keeps it in place.

    A rank has up to 7 digits and a position up to 30.
    """
    seq = F.col(order[-1]).cast("decimal(30,0)")
    if len(order) == 1:
        return seq.cast("decimal(38,0)")
    rank = order[0]
    wide = F.lit(WIDE).cast("decimal(31,0)")
    return (F.col(rank).cast("decimal(7,0)") * wide + seq).cast("decimal(38,0)")


def _key_hash(key: str) -> tuple:
    """A 128-bit stand-in for a text key, so that aggregations move and compare numbers.

    The second hash begins with a constant, which gives it a seed of its own; a constant after the key
    would make it a function of the first hash.
    """
    return F.xxhash64(F.col(key)).alias("_k1"), F.xxhash64(F.lit(1), F.col(key)).alias("_k2")


def _rows_at(df: DataFrame, best: DataFrame, order: tuple) -> DataFrame:
    """The rows of `df` at the orders that `best` holds in its column `_o`.

    Both sides are sorted by a hash of the order first: wide decimals are compared among equal hashes only.
    """
    won = best.select("_o", F.xxhash64("_o").alias("_h"))
    return df.join(won, (F.xxhash64(_order(order)) == F.col("_h")) & (_order(order) == F.col("_o")), "left_semi")


def dedup_first(df: DataFrame, key: str = "sentence", order: tuple = ORDER) -> DataFrame:
    """First-seen row per key.

    The order columns are fixed-width and name one row. The first order of each key is found
    over hashes and numbers, with map-side combine, so a text that fills a third of the corpus
    sends one row per task; the texts move once, to meet the orders that won.
    """
    best = df.groupBy(*_key_hash(key)).agg(F.min(_order(order)).alias("_o"))
    rest = [c for c in df.columns if c != key]
    return _rows_at(df, best, order).select(key, *rest)


def distinct_pairs(df: DataFrame, key: str = "sentence", label: str = "label", order: tuple = ORDER) -> DataFrame:
    """Distinct (key, label) with the order of their first occurrence."""
    pairs = df.groupBy(key, label).agg(F.min(_order(order)).alias("_o"))
    kinds = {c: df.schema[c].dataType for c in order}
    if len(order) == 1:
        return pairs.select(key, label, F.col("_o").cast(kinds[order[0]]).alias(order[0]))
    rank = F.expr(f"_o div {WIDE}")
    seq = (F.col("_o") - rank.cast("decimal(7,0)") * F.lit(WIDE).cast("decimal(31,0)")).cast("decimal(30,0)")
    return pairs.select(key, label, rank.cast(kinds[order[0]]).alias(order[0]), seq.cast(kinds[order[1]]).alias(order[1]))


def dedup_stats(df: DataFrame, key: str = "sentence") -> DataFrame:
    """(rows_before, rows_after): counts per key first, then one row per task."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after"))


def resolve_conflicts(df: DataFrame, strategy: str, none_label: str = NONE_LABEL, key: str = "sentence",
                      label: str = "label", order: tuple = ORDER, distinct: bool = False) -> DataFrame:
    """One label per key (prefer_non_none, majority) or all distinct ones (keep_all).

    With `distinct` the rows are those of `distinct_pairs`: a key has one row per label, so its rows may meet in a window.
    """
    if strategy == "keep_all":
        return distinct_pairs(df, key, label, order)
    if strategy not in ("prefer_non_none", "majority"):
        raise ValueError(f"Unknown conflict strategy: {strategy}")
    if distinct:
        return _resolve_pairs(df, strategy, none_label, key, label, order)
    if strategy == "prefer_non_none":
        # The first order among the labels that are not benign, else the first of all.
        risky = F.when(F.col(label) != none_label, _order(order))
        best = df.groupBy(*_key_hash(key)).agg(F.min(risky).alias("_a"), F.min(_order(order)).alias("_b"))
        best = best.select(F.coalesce("_a", "_b").alias("_o"))
    else:
        counted = df.groupBy(*_key_hash(key), label).agg(F.count("*").alias("_n"), F.min(_order(order)).alias("_o"))
        most = counted.groupBy("_k1", "_k2").agg(F.max("_n").alias("_most"))
        # No label has more than the most; as an equality the counts would be join keys and all sides be dealt anew.
        won = counted.join(most, ["_k1", "_k2"]).filter("_n >= _most")
        best = won.groupBy("_k1", "_k2").agg(F.min("_o").alias("_o"))
    return _rows_at(df, best, order).select(key, label)


def _resolve_pairs(pairs: DataFrame, strategy: str, none_label: str, key: str, label: str, order: tuple) -> DataFrame:
    """The winning rows of distinct (key, label) pairs.

    The pairs lie by key and label already, so counting them moves nothing; their texts move once, to
    their key, and no table of keys is dealt beside them. A key without an order has no first label.
    """
    counted = pairs.groupBy(key, label).agg(F.count("*").alias("_n"), F.min(_order(order)).alias("_o"))
    own = Window.partitionBy(key)
    if strategy == "prefer_non_none":
        risky = F.when(F.col(label) != none_label, F.col("_o"))
        first = F.coalesce(F.min(risky).over(own), F.min("_o").over(own))
        return counted.withColumn("_first", first).filter("_o = _first").select(key, label)
    ranked = counted.withColumn("_most", F.max("_n").over(own))
    first = F.min(F.when(F.col("_n") >= F.col("_most"), F.col("_o"))).over(own)
    return ranked.withColumn("_first", first).filter("_o = _first").select(key, label)


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """Add label_idx, the 0-based rank of the label among the sorted distinct labels.

    The window sees the distinct labels only.
    """
    names = df.select(label).distinct()
    index = names.withColumn("label_idx", F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(broadcast_if_small(index), label)


def question_category(question: Column) -> Column:
    """Class of a question by the first matching rule, NULL if none."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return F.coalesce(*[F.when(contains_any(q, words), F.lit(name)) for name, words in QUESTION_RULES])


def map_titles(examples: DataFrame) -> DataFrame:
    """(sentence, label, source) from (…, qas ARRAY<STRUCT<id, answers STRUCT<text>>>).

    The title is the second `__` part of the id; unmapped titles and answers of up to
    20 characters drop out.
    """
    titles = mapping_frame(examples.sparkSession, TITLE_TO_LABEL, "title", "label")
    kept = [c for c in examples.columns if c != "qas"]
    qas = examples.select(*kept, F.inline("qas"))
    title = F.coalesce(F.try_element_at(F.split("id", "__"), F.lit(2)), F.lit(""))
    labelled = qas.withColumn("title", title).join(titles, "title")
    answers = labelled.select(*kept, "id", "label", F.explode("answers.text").alias("answer"))
    sentence = strip(F.col("answer"))
    return (answers.withColumn("sentence", sentence).filter(F.length("sentence") > MIN_ANSWER_CHARS)
            .select(*kept, "id", "sentence", "label", F.lit("cuad").alias("source")))


def map_provisions(examples: DataFrame, label_names: list) -> DataFrame:
    """(sentence, label, source) from (…, text, label INT) and the index -> name list."""
    mapped = {i: PROVISION_TO_LABEL[n] for i, n in enumerate(label_names) if n in PROVISION_TO_LABEL}
    lookup = mapping_frame(examples.sparkSession, mapped, "label_no", "class")
    kept = [c for c in examples.columns if c not in ("text", "label")]
    rows = examples.filter(F.col("label") >= 0).withColumn("sentence", strip(F.col("text")))
    return (rows.filter(F.length("sentence") > 0).join(lookup, rows["label"] == lookup["label_no"])
            .select(*kept, "sentence", F.col("class").alias("label"), F.lit("ledgar").alias("source")))
