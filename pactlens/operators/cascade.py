"""The three-tier risk cascade over sentence rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.config import NONE_LABEL, CascadeConfig
from pactlens.functions import risk
from pactlens.functions.calibration import calibrate, top1
from pactlens.functions.text import blank as blank_text
from pactlens.operators.hold import hold

SCORES_TYPE = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))
TOP_TYPE = T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())])
KEYS = ("doc_id", "sent_idx")


def attach_scores(sentences: DataFrame, scores: DataFrame, name: str, keys: tuple = KEYS) -> DataFrame:
    """Left join a tier's top-1 as STRUCT<label, confidence>; a missing row means the tier failed.

    The score arrays shrink to their top entry before they move. A score table has one row per
    sentence: a second row of a key would repeat the sentence. The key is unique, so no
    key is hot, and attaching a second score table reuses the first join's partitioning.
    Give `keyword_signals` first and the texts stay behind.
    """
    best = scores.select(*keys, top1(F.col("scores")).alias(name))
    return sentences.join(best, list(keys), "left")


def with_scores(
    df: DataFrame,
    scorer: Callable[[pd.Series], pd.DataFrame],
    name: str = "scores",
    sentence: str = "sentence",
    where: str | None = None,
    on_error: str = "raise",
    top: bool = False,
    doubtful: str | None = None,
) -> DataFrame:
    """Score sentences with a user's batch function inside Arrow batches; also on a stream.

    `scorer` maps a Series of sentences to a frame with one score column per label, in
    label order; `models.loaded` gives it a model that every Python worker loads once.
    `where` names a boolean column: only its true rows reach the scorer, the others get
    NULL, so a later tier never scores what an earlier tier has settled. If the scorer fails, the
    job does; with `on_error="abstain"` a failing batch is parted until the sentences at fault stand
    alone, and these get NULL scores, with which a tier abstains at confidence 0.0. A scorer that fails on k of n
    sentences is called about k * (log2(n / k) + 2) times. With `top` the column is what `top1` gives for the
    scores, STRUCT<label, confidence>, found for a whole batch at once; all that a tier asks of its scores.
    `doubtful` names a boolean column: its true rows, such as those that an earlier tier failed on, go to the scorer apart
    from the others. Those that fail again then cost about one call each, and the others need no search for them.
    """
    if on_error not in ("raise", "abstain"):
        raise ValueError("on_error must be raise or abstain")

    def flags(batch: pa.RecordBatch, column: str) -> np.ndarray:
        return np.asarray(batch.column(column).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = flags(batch, where) if where else np.ones(batch.num_rows, dtype=bool)
            texts = batch.column(sentence).to_pandas()
            runs = [chosen]
            if doubtful:
                apart = flags(batch, doubtful)
                runs = [chosen & ~apart, chosen & apart]
            parts = [p for rows in runs for p in scored_parts(scorer, texts, np.flatnonzero(rows), on_error == "abstain")]
            scores = (_score_tops if top else _score_lists)(parts, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, TOP_TYPE if top else SCORES_TYPE)])
    return df.mapInArrow(run, schema)


def scored_parts(scorer: Callable, texts: pd.Series, rows: np.ndarray, abstain: bool) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """(rows, scores) of runs of sentences that the scorer takes; with `abstain` those at fault are left out.

    Runs are tried in order. In one that fails the first sentence at fault is searched by halves, and what follows it is
    tried anew, in runs of about as many sentences as lie between faults so far. The sentences are picked once, so a run
    is a slice; the scorer gets a copy of its own, which it may change.
    """
    asked = texts.iloc[rows]

    def attempt(start: int, stop: int) -> pd.DataFrame | None:
        try:
            frame = scorer(asked.iloc[start:stop].copy())
            if len(frame) != stop - start:
                raise ValueError(f"the scorer gave {len(frame)} rows for {stop - start} sentences")
            return frame
        except Exception:
            if not abstain:
                raise
            return None

    at, faults = 0, 0
    while at < len(rows):
        end = min(len(rows), at + max(1, int(at / faults * 0.69))) if faults else len(rows)
        tried = end
        while at < end:
            frame = attempt(at, tried)
            if frame is not None:
                yield rows[at:tried], frame
                at = tried
            elif tried - at == 1:
                at, faults = tried, faults + 1
                break
            else:
                end = tried
            tried = at + max(1, (end - at) // 2)


def _score_lists(parts: list, n: int) -> pa.ListArray:
    """ARRAY<STRUCT<label, score>> of n rows; rows that no part scores are NULL."""
    names, places, codes, scores = [], {}, [], []  # labels once for each list of columns, and the place of each score's label
    first, size = np.zeros(n, dtype=np.int64), np.full(n, -1)
    at = 0
    for rows, frame in parts:
        columns = tuple(map(str, frame.columns))
        width = len(columns)
        if columns not in places:
            places[columns] = len(names) + np.arange(width)
            names.extend(columns)
        codes.append(np.tile(places[columns], len(rows)))
        scores.append(frame.to_numpy(dtype="float64").ravel())
        first[rows], size[rows] = at + np.arange(len(rows)) * width, width
        at += width * len(rows)
    counts = np.maximum(size, 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    source = np.repeat(first - offsets[:-1], counts) + np.arange(offsets[-1])
    codes = np.concatenate(codes)[source] if codes else source
    labels = pa.array(names, pa.string()).take(pa.array(codes))
    scores = pa.array(np.concatenate(scores) if scores else [], pa.float64()).take(pa.array(source))
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype("int32")), pa.StructArray.from_arrays([labels, scores], ["label", "score"]), mask=pa.array(size < 0))


def _score_tops(parts: list, n: int) -> pa.StructArray:
    """STRUCT<label, confidence> of n rows, as `top1` has it of their scores; rows that no part scores are NULL."""
    alike = {}  # (rows, scores) of the parts with the same columns
    for rows, frame in parts:
        alike.setdefault(tuple(map(str, frame.columns)), []).append((rows, frame.to_numpy(dtype="float64")))
    names, codes, confidence, missing = [], np.zeros(n, dtype=np.int64), np.zeros(n), np.ones(n, dtype=bool)
    for columns, found in alike.items():
        rows, scores = (np.concatenate(x) for x in zip(*found))
        missing[rows] = False
        codes[rows] = len(names)
        if columns:
            best = scores.argmax(axis=1)  # the first of equal ones, NaN above all, as in Spark's order
            codes[rows] += best
            confidence[rows] = scores[np.arange(len(rows)), best]
        names.extend(NONE_LABEL if c.startswith("LABEL_") else c for c in columns or (NONE_LABEL,))
    labels = pa.array(names, pa.string()).take(pa.array(codes)) if names else pa.nulls(n, pa.string())
    return pa.StructArray.from_arrays([labels, pa.array(confidence)], ["label", "confidence"], mask=pa.array(missing))


def keyword_signals(df: DataFrame, config: CascadeConfig, sentence: str = "sentence") -> DataFrame:
    """Add all that the cascade reads from the text: _kw (keyword class), _modal, _delta and _blank."""
    held = hold(df, _lower=F.lower(F.col(sentence)))
    lower, lexicon = F.col("_lower"), config.lexicon
    return hold(held, _kw=risk.keyword_risk(lower, lexicon), _modal=risk.modal_score(lower, lexicon),
                _delta=risk.amplifier_delta(lower, lexicon), _blank=blank_text(F.col(sentence))).drop("_lower")


def tier_top(scores: Column, sentence: Column, is_array: bool = False, blank: Column | None = None) -> Column:
    """A tier's top-1 for a sentence; a blank sentence is benign without asking the model."""
    return F.when(
        blank_text(sentence) if blank is None else blank,
        F.struct(F.lit(NONE_LABEL).alias("label"), F.lit(0.0).alias("confidence")),
    ).otherwise(top1(scores) if is_array else scores)


def tier1_decision(top: Column, config: CascadeConfig) -> Column:
    """STRUCT<label, confidence> of the transformer tier from its top-1; a NULL label abstains."""
    calibrated = calibrate(top["confidence"], config.temperature)
    benign = top["label"] == NONE_LABEL
    accepted = ~benign
    if config.enforce_thresholds:
        accepted = accepted & (calibrated >= F.lit(config.transformer_threshold))
    confidence = F.coalesce(F.when(benign, top["confidence"]).otherwise(calibrated), F.lit(0.0))
    return F.struct(F.when(accepted, top["label"]).alias("label"), confidence.alias("confidence"))


def tier2_decision(top: Column, config: CascadeConfig) -> Column:
    """STRUCT<label, confidence> of the classifier tier from its top-1.

    A confidence of exactly 0.0 passes the threshold, and a missing score row gives
    (NULL, 0.0).
    """
    accepted = top["label"] != NONE_LABEL
    if config.enforce_thresholds:
        low = (top["confidence"] != 0.0) & (top["confidence"] < F.lit(config.ml_threshold))
        accepted = accepted & ~low
    return F.struct(F.when(accepted, top["label"]).alias("label"),
                    F.coalesce(top["confidence"], F.lit(0.0)).alias("confidence"))


def _column_top(df: DataFrame, column: str | None, sentence: Column) -> Column:
    """Top-1 from a score array, a top-1 struct, or no scores at all."""
    blank = F.col("_blank") if "_blank" in df.columns else None
    if column is None:
        return tier_top(F.lit(None).cast("struct<label:string,confidence:double>"), sentence, blank=blank)
    return tier_top(F.col(column), sentence, isinstance(df.schema[column].dataType, T.ArrayType), blank)


def decide(
    df: DataFrame,
    config: CascadeConfig,
    sentence: str = "sentence",
    tier1: str | None = "tier1",
    tier2: str | None = "tier2",
    keep_benign: bool = False,
) -> DataFrame:
    """Run the cascade: adds risk_type, confidence and detector, drops sentences without risk.

    With `keep_benign` those stay, with a NULL risk_type.

    A tier that settles a sentence hides the later ones. In `auto` and `ml` mode the
    classifier's confidence stays on the row even when the keyword tier decides.
    `tier1` and `tier2` name columns with the tiers' score arrays or top-1 structs; None
    means the tier has no scores, so in its modes it fails on every row. A column _t1 is the first tier's decision,
    made before.
    """
    s = F.col(sentence)
    made = "_t1" in df.columns
    tops = {"_top1": _column_top(df, tier1, s)} if config.uses_transformer and not made else {}
    if config.uses_ml:
        tops["_top2"] = _column_top(df, tier2, s)
    topped = hold(df, **tops) if tops else df
    known = "_kw" in df.columns
    staged = {} if known else {"_lower": F.lower(s)}
    if config.uses_transformer and not made:
        staged["_t1"] = tier1_decision(F.col("_top1"), config)
    if config.uses_ml:
        staged["_t2"] = tier2_decision(F.col("_top2"), config)
    held = (hold(topped, **staged) if staged else topped).drop(*tops)

    first = F.col("_t1.label") if config.uses_transformer else F.lit(None).cast("string")
    second = F.col("_t2.label") if config.uses_ml else F.lit(None).cast("string")
    third = F.col("_kw") if known else risk.keyword_risk(F.col("_lower"), config.lexicon)
    carried = F.col("_t2.confidence") if config.uses_ml else F.lit(None).cast("double")
    if config.uses_transformer:
        carried = F.when(first.isNotNull(), F.col("_t1.confidence")).otherwise(carried)
    detector = (F.when(first.isNotNull(), F.lit("transformer"))
                .when(second.isNotNull(), F.lit("ml")).otherwise(F.lit("keyword")))
    decided = hold(held, risk_type=F.coalesce(first, second, third), confidence=carried, detector=detector)
    return (decided if keep_benign else decided.filter("risk_type IS NOT NULL")).drop("_t1", "_t2")


def score_severity(df: DataFrame, config: CascadeConfig, sentence: str = "sentence") -> DataFrame:
    """Add severity and severity_score to rows with risk_type and confidence."""
    lexicon = config.lexicon
    signals = df
    if "_kw" not in df.columns:
        if "_lower" not in df.columns:
            df = df.withColumn("_lower", F.lower(F.col(sentence)))
        lower = F.col("_lower")
        signals = hold(df, _modal=risk.modal_score(lower, lexicon), _delta=risk.amplifier_delta(lower, lexicon))
    scored = hold(signals, _score=risk.composite(
        F.col("_modal"), F.col("_delta"), risk.base_weight(F.col("risk_type"), lexicon), F.col("confidence")))
    return (scored.withColumn("severity", risk.severity_label(F.col("_score"), lexicon))
            .withColumn("severity_score", risk.severity_score(F.col("_score")))
            .drop("_lower", "_kw", "_blank", "_modal", "_delta", "_score"))


def cascade(df: DataFrame, config: CascadeConfig, **columns) -> DataFrame:
    """`decide` followed by `score_severity`."""
    return score_severity(decide(df, config, **columns), config, columns.get("sentence", "sentence"))


def risk_records(scored: DataFrame, keys: tuple = KEYS, sentence: str = "sentence") -> DataFrame:
    """The stored risk record: rounded confidence and a template explanation."""
    return scored.select(
        *keys,
        F.col(sentence).alias("original_sentence"),
        "risk_type", "severity", "severity_score",
        risk.explanation(F.col("risk_type"), F.col("severity")).alias("explanation"),
        F.lit("template").alias("explanation_source"),
        F.bround("confidence", 4).alias("confidence"),
        "detector",
    )
