"""Build labelled corpora from raw sources."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pactlens.config import NONE_LABEL
from pactlens.operators import mining
from pactlens.operators.corpus import (
    clean_rows, dedup_first, distinct_pairs, merge_corpora, resolve_conflicts)
from pactlens.operators.sampling import balance, balance_cap


def corpus_from_wide(wide: DataFrame, keys: tuple, none_ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """(sentence, label) from a wide clause table."""
    return mining.prepared_corpus(mining.wide_candidates(mining.wide_clauses(wide, keys)), none_ratio, seed)


def corpus_from_qa(files: DataFrame, none_ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """(sentence, label) from nested QA files."""
    return mining.prepared_corpus(mining.qa_candidates(mining.qa_paragraphs(files)), none_ratio, seed)


def capped_corpus(sources: list, cap: int, seed: int = 42) -> DataFrame:
    """(sentence, label, source...): sources merged, first-seen rows kept, at most `cap` of a class.

    `sources` are (name, DataFrame with sentence, label, seq) in order of precedence.
    """
    return balance_cap(dedup_first(merge_corpora(sources)), cap, ("sentence",), seed=seed)


def merged_training_corpus(sources: list, conflicts: str = "prefer_non_none", dedupe: bool = False,
                           balance_mode: str = "none", none_label: str = NONE_LABEL, seed: int = 42) -> DataFrame:
    """Clean, union, optionally de-duplicate, resolve conflicts and balance.

    `sources` are (name, DataFrame with sentence, label, seq) in order of precedence.
    """
    rows = clean_rows(merge_corpora(sources), "sentence", "label")
    if dedupe:
        rows = distinct_pairs(rows)
    resolved = resolve_conflicts(rows, conflicts, none_label, distinct=dedupe).select("sentence", "label")
    return balance(resolved, balance_mode, ("sentence", "label"), seed=seed)
