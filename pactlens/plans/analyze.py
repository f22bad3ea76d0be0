"""Score a document collection and summarise it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.config import CascadeConfig
from pactlens.functions import risk
from pactlens.functions.text import blank, sentences
from pactlens.operators.cascade import (
    KEYS, attach_scores, cascade, keyword_signals, risk_records, tier1_decision, tier_top, with_scores)
from pactlens.operators.hold import hold
from pactlens.operators.report import assemble_report, keyword_report, summarize_sentences
from pactlens.operators.segment import segment_sentences
from pactlens.operators.sizing import spread


def score_sentences(sents: DataFrame, config: CascadeConfig, tier1: DataFrame | None = None,
                    tier2: DataFrame | None = None, keep_benign: bool = False) -> DataFrame:
    """Sentence rows to risk rows, with optional score tables for the two model tiers."""
    staged, names = sents, {"tier1": None, "tier2": None}
    if (tier1 is not None and config.uses_transformer) or (tier2 is not None and config.uses_ml):
        staged = keyword_signals(staged, config)  # so that the joins move numbers where no text is asked for
    if tier1 is not None and config.uses_transformer:
        staged, names["tier1"] = attach_scores(staged, tier1, "tier1"), "tier1"
    if tier2 is not None and config.uses_ml:
        staged, names["tier2"] = attach_scores(staged, tier2, "tier2"), "tier2"
    return cascade(staged, config, **names, keep_benign=keep_benign).drop("tier1", "tier2")


def analyze_risks(sents: DataFrame, config: CascadeConfig, tier1: DataFrame | None = None,
                  tier2: DataFrame | None = None) -> DataFrame:
    """Sentence rows to stored risk records."""
    return risk_records(score_sentences(sents, config, tier1, tier2), KEYS)


def summarize_documents(docs: DataFrame, config: CascadeConfig, text: str = "text") -> DataFrame:
    """Keyword-tier summary per document in one aggregation, empty documents included."""
    lexicon = config.lexicon
    pieces = spread(docs.select("doc_id", text)).select(
        "doc_id", F.explode_outer(sentences(F.col(text))).alias("sentence"))
    return summarize_sentences(keyword_columns(pieces, lexicon))


def keyword_columns(sents: DataFrame, lexicon) -> DataFrame:
    """Add keyword-tier risk columns to every sentence row, NULL where there is no risk."""
    typed = hold(hold(sents, _lower=F.lower("sentence")),
                 risk_type=risk.keyword_risk(F.col("_lower"), lexicon))
    lower, none = F.col("_lower"), F.lit(None).cast("double")
    signals = (typed.withColumn("_modal", risk.modal_score(lower, lexicon))
               .withColumn("_delta", risk.amplifier_delta(lower, lexicon)))
    score = risk.composite(F.col("_modal"), F.col("_delta"), risk.base_weight(F.col("risk_type"), lexicon), none)
    hit = F.col("risk_type").isNotNull()
    return signals.select(
        *sents.columns, "risk_type",
        F.when(hit, risk.severity_label(score, lexicon)).alias("severity"),
        F.when(hit, F.lit("keyword")).alias("detector"))


def analyze_report(docs: DataFrame, config: CascadeConfig, text: str = "text", tier1: DataFrame | None = None,
                   tier2: DataFrame | None = None) -> DataFrame:
    """(doc_id, risks, ccic, summary): the nested response of every document.

    Without score tables nothing leaves the document's row; with them the sentences are
    joined and gathered again.
    """
    if tier1 is None and tier2 is None and not (config.uses_ml or config.uses_transformer):
        return keyword_report(docs, config, sentences(F.col(text)))
    return report_of_sentences(docs, segment_sentences(docs, text), config, tier1, tier2)


def report_of_sentences(docs: DataFrame, sents: DataFrame, config: CascadeConfig, tier1: DataFrame | None = None,
                        tier2: DataFrame | None = None, scorers: dict | None = None) -> DataFrame:
    """(doc_id, risks, ccic, summary) from sentence rows, with score tables or with batch scorers for the model tiers."""
    totals = sents.groupBy("doc_id").agg(F.count("*").alias("total_sentences"))
    if scorers:
        risks = risk_records(score_by_models(sents, config, scorers), KEYS)
    else:
        risks = analyze_risks(sents, config, tier1, tier2)
    return assemble_report(docs, totals, risks, config)


def score_by_models(sents: DataFrame, config: CascadeConfig, scorers: dict) -> DataFrame:
    """Sentence rows to risk rows by batch scorers ("tier1", "tier2"), which abstain on sentences that they fail on.

    The second tier scores only what the first leaves open, and apart from the rest what the first failed on.
    """
    staged, tier2, asked = hold(sents.select(*KEYS, "sentence"), _blank=blank(F.col("sentence"))), None, {}
    if "tier1" in scorers and config.uses_transformer:
        scored = with_scores(staged, scorers["tier1"], "tier1", on_error="abstain", top=True)
        top = tier_top(F.col("tier1"), F.col("sentence"), blank=F.col("_blank"))
        decided = hold(scored, _t1=tier1_decision(top, config), _failed=F.col("tier1").isNull()).drop("tier1")
        staged, asked = decided.withColumn("_open", F.col("_t1.label").isNull()), {"where": "_open", "doubtful": "_failed"}
    if "tier2" in scorers and config.uses_ml:
        staged, tier2 = with_scores(staged, scorers["tier2"], "tier2", on_error="abstain", top=True, **asked), "tier2"
    return cascade(staged, config, tier1=None, tier2=tier2).drop("tier2", "_open", "_failed")


def write_report(report: DataFrame, path: str, fmt: str = "json", compression: str | None = None) -> None:
    """Nested analysis results, one object per document; every record repeats its field names, so JSON packs well."""
    writer = report.write.mode("overwrite").format(fmt)
    (writer.option("compression", compression) if compression else writer).save(path)
