"""Distributions, document summaries and the nested analysis report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.config import DETECTORS, SEVERITIES, CascadeConfig
from pactlens.functions import risk
from pactlens.operators.sizing import spread


def _zero_filled(column: str, values, names) -> list:
    return [F.count_if(F.col(column) == v).alias(n) for v, n in zip(values, names)]


def _distribution(docs: DataFrame, risks: DataFrame, keys: tuple, column: str, values, names) -> DataFrame:
    counts = risks.groupBy(*keys).agg(*_zero_filled(column, values, names))
    return docs.select(*keys).join(counts, list(keys), "left").fillna(0, subset=list(names))


def severity_distribution(docs: DataFrame, risks: DataFrame, keys: tuple = ("doc_id",)) -> DataFrame:
    """Counts by severity of every document, zeros for one without risks."""
    return _distribution(docs, risks, keys, "severity", SEVERITIES, ("high", "medium", "low"))


def detector_distribution(docs: DataFrame, risks: DataFrame, keys: tuple = ("doc_id",)) -> DataFrame:
    """Counts by detector of every document, zeros for one without risks."""
    return _distribution(docs, risks, keys, "detector", DETECTORS, [f"n_{d}" for d in DETECTORS])


def percentage(part: Column, total: Column) -> Column:
    """Two-decimal percentage, 0.0 of nothing."""
    return F.when(total > 0, F.bround(part / total * 100, 2)).otherwise(F.lit(0.0))


def document_summary(docs: DataFrame, risks: DataFrame, totals: DataFrame, keys: tuple = ("doc_id",)) -> DataFrame:
    """One summary row per document, documents without sentences or risks included.

    `totals` holds (keys..., total_sentences). Sides are reduced to one row per
    document before they meet.
    """
    counts = risks.groupBy(*keys).agg(
        F.count("*").alias("risky_count"),
        *_zero_filled("severity", SEVERITIES, ("high", "medium", "low")),
        *_zero_filled("detector", DETECTORS, [f"n_{d}" for d in DETECTORS]),
    )
    names = counts.columns[len(keys):]
    joined = docs.select(*keys).join(totals, list(keys), "left").join(counts, list(keys), "left")
    filled = joined.fillna(0, subset=["total_sentences", *names])
    return filled.select(
        *keys, "total_sentences", "risky_count",
        percentage(F.col("risky_count"), F.col("total_sentences")).alias("risk_percentage"),
        *names[1:],
    )


def summarize_sentences(scored: DataFrame, keys: tuple = ("doc_id",)) -> DataFrame:
    """Document summary from sentence rows that keep their benign sentences.

    `scored` has one row per sentence with NULL risk columns where there is no risk,
    and one row with a NULL sentence for a document without sentences. A single
    aggregation with map-side combine: the shuffle carries one short row per document
    and task.
    """
    counted = scored.groupBy(*keys).agg(
        F.count("sentence").alias("total_sentences"),
        F.count("risk_type").alias("risky_count"),
        *_zero_filled("severity", SEVERITIES, ("high", "medium", "low")),
        *_zero_filled("detector", DETECTORS, [f"n_{d}" for d in DETECTORS]),
    )
    rest = counted.columns[len(keys) + 2:]
    return counted.select(
        *keys, "total_sentences", "risky_count",
        percentage(F.col("risky_count"), F.col("total_sentences")).alias("risk_percentage"), *rest)


def summarize_scored(docs: DataFrame, scored: DataFrame, keys: tuple = ("doc_id",)) -> DataFrame:
    """Document summary from a cascade's rows with the benign ones kept (NULL risk_type).

    One aggregation with map-side combine; documents without sentences are joined in.
    """
    def among(column, values, names):
        return [F.count_if(F.col("risk_type").isNotNull() & (F.col(column) == v)).alias(n) for v, n in zip(values, names)]

    counts = scored.groupBy(*keys).agg(
        F.count("*").alias("total_sentences"), F.count("risk_type").alias("risky_count"),
        *among("severity", SEVERITIES, ("high", "medium", "low")),
        *among("detector", DETECTORS, [f"n_{d}" for d in DETECTORS]))
    names = counts.columns[len(keys):]
    filled = docs.select(*keys).join(counts, list(keys), "left").fillna(0, subset=names)
    return filled.select(*keys, *names[:2], percentage(
        F.col("risky_count"), F.col("total_sentences")).alias("risk_percentage"), *names[2:])


def category_shares(risks: DataFrame, config: CascadeConfig) -> DataFrame:
    """Count, share of total and running share per category, in lexicon order.

    The windows run over the aggregated categories only.
    """
    names = config.lexicon.category_names
    rank = reduce(lambda acc, p: acc.when(F.col("risk_type") == p[1], F.lit(p[0])),
                  list(enumerate(names))[1:], F.when(F.col("risk_type") == names[0], F.lit(0)))
    counts = (risks.groupBy("risk_type").agg(F.count("*").alias("n"))
              .withColumn("cat_rank", rank.otherwise(F.lit(len(names)))))
    running = Window.orderBy("cat_rank", "risk_type").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(
        "risk_type", "cat_rank", "n",
        F.bround(F.col("n") / total, 6).alias("share"),
        F.bround(F.sum("n").over(running) / total, 6).alias("cumulative_share"),
    )


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


# --- nested report without a shuffle ----------------------------------------------------


def risk_array(sentences: Column, config: CascadeConfig) -> Column:
    """ARRAY<risk record> of a sentence array, keyword tier.

    Stays inside the document row: nothing is exploded or shuffled, so it also serves
    streams without any state. Each `transform` binds what the next one uses.
    """
    lexicon = config.lexicon
    lowered = F.transform(sentences, lambda s: F.struct(s.alias("s"), F.lower(s).alias("l")))
    typed = F.filter(
        F.transform(lowered, lambda x: F.struct(
            x["s"].alias("s"), x["l"].alias("l"), risk.keyword_risk(x["l"], lexicon).alias("t"))),
        lambda x: x["t"].isNotNull())
    signals = F.transform(typed, lambda x: F.struct(
        x["s"].alias("s"), x["t"].alias("t"),
        risk.modal_score(x["l"], lexicon).alias("m"), risk.amplifier_delta(x["l"], lexicon).alias("d")))
    scored = F.transform(signals, lambda x: F.struct(
        x["s"].alias("s"), x["t"].alias("t"),
        risk.composite(x["m"], x["d"], risk.base_weight(x["t"], lexicon),
                       F.lit(None).cast("double")).alias("c")))
    labelled = F.transform(scored, lambda x: F.struct(
        x["s"].alias("s"), x["t"].alias("t"), x["c"].alias("c"),
        risk.severity_label(x["c"], lexicon).alias("v")))
    return F.transform(labelled, lambda x: F.struct(
        x["s"].alias("original_sentence"), x["t"].alias("risk_type"), x["v"].alias("severity"),
        risk.severity_score(x["c"]).alias("severity_score"),
        risk.explanation(x["t"], x["v"]).alias("explanation"),
        F.lit("template").alias("explanation_source"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit("keyword").alias("detector")))


def _array_counts(risks: Column, field: str, values) -> Column:
    def count(value):
        return F.size(F.filter(risks, lambda r: r[field] == value)).cast("bigint").alias(value)

    return F.struct(*[count(v) for v in values])


def report_columns(total: Column, risks: Column, config: CascadeConfig) -> list:
    """The nested response of one document: risks, ccic and summary."""
    risky = F.size(risks).cast("bigint")
    ccic = F.struct(
        F.lit(config.mode).alias("mode"),
        F.lit(float(config.temperature)).alias("temperature"),
        F.lit(float(config.transformer_threshold)).alias("transformer_threshold"),
        F.lit(float(config.ml_threshold)).alias("ml_threshold"),
        _array_counts(risks, "detector", DETECTORS).alias("detector_distribution"))
    summary = F.struct(
        total.cast("bigint").alias("total_sentences"), risky.alias("risky_count"),
        percentage(risky, total).alias("risk_percentage"),
        _array_counts(risks, "severity", SEVERITIES).alias("severity_distribution"))
    return [risks.alias("risks"), ccic.alias("ccic"), summary.alias("summary")]


def keyword_report(docs: DataFrame, config: CascadeConfig, sentences: Column, keys: tuple = ("doc_id",)) -> DataFrame:
    """(keys..., risks, ccic, summary) per document for the keyword tier."""
    staged = spread(docs).select(*keys, sentences.alias("_sents"))
    staged = staged.select(*keys, F.size("_sents").alias("_total"), F.explode(
        F.array(risk_array(F.col("_sents"), config))).alias("_risks"))
    return staged.select(*keys, *report_columns(F.col("_total"), F.col("_risks"), config))


def assemble_report(docs: DataFrame, totals: DataFrame, records: DataFrame, config: CascadeConfig,
                    keys: tuple = ("doc_id",)) -> DataFrame:
    """The same nested response from risk-record rows of any cascade mode.

    The response holds a document's records in one value, each with its sentence and
    an explanation of bounded length, so gathering is inherent in it: a row grows with the
    number of the document's sentences.
    """
    record = [c for c in records.columns if c not in (*keys, "sent_idx")]
    gathered = records.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct("sent_idx", F.struct(*record).alias("r")))).alias("_rows"))
    joined = docs.select(*keys).join(totals, list(keys), "left").join(gathered, list(keys), "left")
    empty = F.array().cast(gathered.schema["_rows"].dataType)
    staged = joined.select(
        *keys, F.coalesce("total_sentences", F.lit(0)).alias("_total"),
        F.transform(F.coalesce("_rows", empty), lambda x: x["r"]).alias("_risks"))
    return staged.select(*keys, *report_columns(F.col("_total"), F.col("_risks"), config))
