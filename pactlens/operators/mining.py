"""Positives and benign candidates from wide clause tables and nested QA corpora."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.config import NONE_LABEL, Lexicon
from pactlens.functions.risk import keyword_risk
from pactlens.functions.text import WHITESPACE, clean, clean_clause, sentences, strip
from pactlens.operators.corpus import question_category
from pactlens.operators.hold import hold
from pactlens.operators.sampling import sample_negatives
from pactlens.operators.sizing import spread
from pactlens.sources.scratch import store
from pactlens.taxonomy import NONE_COLUMNS, POSITIVE_COLUMNS, mapping_frame

# Answers that mean "no answer".
NO_ANSWER = ("n/a", "na")

GRAM, STRIDE = 5, 4          # bytes of a run in the index of sentences, and from one run to the next
BATCH = 10_000               # sentences given back at once
IN_ROW_WORK = 1 << 26        # characters times answers of a paragraph that its row tests by itself


# --- wide clause tables -------------------------------------------------------------------


def wide_clauses(wide: DataFrame, keys: tuple) -> DataFrame:
    """(keys..., clause, label, text): one row per non-blank clause cell, text cleaned.

    `label` is "None" for the columns that only supply benign candidates. Columns the
    table lacks are skipped.
    """
    columns = [c for c in (*POSITIVE_COLUMNS, *NONE_COLUMNS) if c in wide.columns]
    cells = spread(wide).unpivot(list(keys), columns, "clause", "text")
    classes = {**{c: NONE_LABEL for c in NONE_COLUMNS}, **POSITIVE_COLUMNS}
    labels = mapping_frame(wide.sparkSession, classes, "clause", "label")
    cleaned = hold(cells.filter("text IS NOT NULL"), _clean=clean_clause(F.col("text")))
    return cleaned.filter("_clean != ''").join(labels, "clause").select(
        *keys, "clause", "label", F.col("_clean").alias("text"))


def _clause_sentences(cells: DataFrame) -> DataFrame:
    pieces = F.filter(F.transform(sentences(F.col("text")), clean), lambda s: s != "")
    return cells.select("label", F.explode(pieces).alias("sentence"))


def wide_candidates(cells: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Distinct (sentence, label) of the class columns, and of the benign columns where no
    risk keyword occurs; one pass over the cells."""
    rows = hold(_clause_sentences(cells), _lower=F.lower("sentence"))
    kept = (F.col("label") != NONE_LABEL) | keyword_risk(F.col("_lower"), lexicon).isNull()
    return rows.filter(kept).select("sentence", "label").distinct()


def wide_positives(cells: DataFrame) -> DataFrame:
    """Distinct (sentence, label) of the class columns."""
    return wide_candidates(cells.filter(F.col("label") != NONE_LABEL))


def wide_negatives(cells: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Distinct sentences of the benign columns without any risk keyword."""
    return wide_candidates(cells.filter(F.col("label") == NONE_LABEL), lexicon).select("sentence")


# --- nested QA corpora --------------------------------------------------------------------


def qa_paragraphs(files: DataFrame, keep: tuple = ()) -> DataFrame:
    """(keep..., context, qas): paragraphs with a context and at least one question."""
    paragraphs = F.flatten(F.transform("data", lambda d: F.coalesce(
        d["paragraphs"], F.array().cast(files.schema["data"].dataType.elementType["paragraphs"].dataType))))
    flat = files.select(*keep, F.inline(paragraphs))
    return flat.filter((F.length("context") > 0) & (F.size("qas") > 0))


def qa_answers(paragraphs: DataFrame, keep: tuple = ()) -> DataFrame:
    """(keep..., question, label, answer): mapped questions with usable answers."""
    questions = paragraphs.select(*keep, F.inline("qas"))
    mapped = hold(questions, label=question_category(F.col("question"))).filter("label IS NOT NULL")
    answers = mapped.select(*keep, "question", "label", F.explode("answers.text").alias("_raw"))
    kept = hold(answers, answer=strip(F.col("_raw")))
    return kept.filter(_usable(F.col("answer"))).select(*keep, "question", "label", "answer")


def _usable(answer: Column) -> Column:
    return (answer != "") & ~F.lower(answer).isin(*NO_ANSWER)


def qa_positives(answers: DataFrame) -> DataFrame:
    """Distinct (sentence, label) of the answers."""
    return answers.select(F.explode(sentences(F.col("answer"))).alias("sentence"), "label").distinct()


def qa_negatives(paragraphs: DataFrame, in_row_work: int | None = None) -> DataFrame:
    """Distinct context sentences that contain no answer of their own paragraph.

    Context and answers sit in the same row, so the exclusion is an array test there:
    no join, no shuffle and no pairs; only the final distinct moves data. An answer with
    a sentence break inside cannot be part of one sentence and is left out of the test.

    The test reads the context once for each answer. With `in_row_work`, paragraphs whose characters
    times answers exceed it go through an index of their sentences instead; the result is the same.
    """
    if in_row_work is None:
        return _free_in_row(paragraphs).distinct()
    answers = F.aggregate("qas", F.lit(0).cast("bigint"), lambda n, qa: n + F.greatest(F.size(qa["answers"]), F.lit(0)))
    sized = hold(paragraphs, _work=F.length("context") * answers)
    light = _free_in_row(sized.filter(F.col("_work") <= in_row_work))
    heavy = _free_by_index(sized.filter(F.col("_work") > in_row_work))
    return light.unionByName(heavy).distinct()


def _with_snippets(paragraphs: DataFrame) -> DataFrame:
    """Add `_snippets`, the distinct answers of the mapped questions that one sentence can contain."""
    mapped = F.filter("qas", lambda qa: question_category(qa["question"]).isNotNull())
    texts = F.flatten(F.transform(mapped, lambda qa: F.transform(
        F.coalesce(qa["answers"], F.array().cast(_answers_type(paragraphs))), lambda a: strip(a["text"]))))
    return hold(paragraphs, _sents=sentences(F.col("context")),
                _snippets=F.array_distinct(F.filter(
                    texts, lambda t: _usable(t) & ~F.rlike(t, F.lit(rf"[.!?]{WHITESPACE}")))))


def _free_in_row(paragraphs: DataFrame) -> DataFrame:
    free = F.filter("_sents", lambda s: ~F.exists("_snippets", lambda p: F.contains(s, p)))
    return _with_snippets(paragraphs).select(F.explode(free).alias("sentence"))


def _runs(text: bytes, first: int = 0) -> set:
    """The runs of GRAM bytes at every STRIDE-th place from `first` on."""
    return {text[i:i + GRAM] for i in range(first, len(text) - GRAM + 1, STRIDE)}


def free_sentences(texts: list, answers: list) -> list:
    """The texts that contain none of the answers, found through runs of bytes.

    Only every STRIDE-th run of a text is looked up, so an answer waits at one run for each way in which it can lie
    on those places, the one that fewest texts have; where none has it, the answer is nowhere. Only texts with that run are
    compared with it. Shorter answers are tested one by one. Only runs of the answers are held; the texts are read twice.
    """
    short = [a for a in answers if len(a) < GRAM + STRIDE - 1]
    ways = [(a, _runs(a, first)) for a in answers if len(a) >= GRAM + STRIDE - 1 for first in range(STRIDE)]
    counts = dict.fromkeys((g for _, runs in ways for g in runs), 0)
    for t in texts:
        for g in counts.keys() & _runs(t):
            counts[g] += 1
    waiting: dict = {}
    for a, runs in ways:
        rarest = min(runs, key=counts.__getitem__)
        if counts[rarest]:
            waiting.setdefault(rarest, []).append(a)
    return [t for t in texts if not any(a in t for a in short)
            and not any(a in t for g in _runs(t) if g in waiting for a in waiting[g])]


def _free_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept: list = []
        for texts, answers in zip(batch.column(0), batch.column(1)):
            kept += free_sentences(texts.as_py(), answers.as_py())
            if len(kept) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["sentence"])
                kept = []
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["sentence"])


def _free_by_index(paragraphs: DataFrame) -> DataFrame:
    """(sentence): the sentences without an answer, each paragraph by an index of its own; nothing is shuffled.

    Texts go as bytes, which compare as in the row. A paragraph is a row, and its work grows with its characters
    and answers, not with their product.
    """
    held = _with_snippets(paragraphs)
    texts = [F.transform(c, lambda s: s.cast("binary")).alias(n) for c, n in (
        (F.array_distinct("_sents"), "sentences"), (F.col("_snippets"), "answers"))]
    return held.select(*texts).mapInArrow(_free_batches, "sentence binary").select(F.col("sentence").cast("string").alias("sentence"))


def _answers_type(paragraphs: DataFrame):
    return paragraphs.schema["qas"].dataType.elementType["answers"].dataType


# --- prepared corpora ---------------------------------------------------------------------


def qa_candidates(paragraphs: DataFrame) -> DataFrame:
    """Distinct (sentence, label) of answers and free context sentences."""
    return qa_positives(qa_answers(paragraphs)).unionByName(
        qa_negatives(paragraphs, IN_ROW_WORK).select("sentence", F.lit(NONE_LABEL).alias("label")))


def prepared_corpus(candidates: DataFrame, none_ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Labelled candidates with int(n_pos * ratio) of their benign sentences.

    The candidates are written once: positives are counted and the benign ones ranked.
    """
    rows = store(candidates, "candidates")
    positives, benign = rows.filter(F.col("label") != NONE_LABEL), rows.filter(F.col("label") == NONE_LABEL)
    return positives.unionByName(
        sample_negatives(benign, positives.count(), none_ratio, ("sentence",), seed))
