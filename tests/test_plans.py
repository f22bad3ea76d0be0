"""Plans keep the shapes that scale: what is shuffled, joined and read."""

import re

import pytest
from pyspark.sql import functions as F

from pactlens.operators import corpus, mining, sampling
from pactlens.plans import analyze, build_corpus
from pactlens.sources import scratch
from workloads import derive, registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"\bExchange (?!SinglePartition)", text)) - text.count("REPARTITION_BY_NUM")


@pytest.mark.parametrize("name,shuffles", [
    ("segment_sentences", 0), ("cascade_keyword", 0), ("analyze_report", 0), ("detect_risk_types", 0),
    ("explanations", 0), ("wide_clause_unpivot", 0), ("map_titles", 0), ("map_provisions", 0),
    ("document_summary", 1), ("severity_distribution", 1), ("mine_negatives_qa", 1), ("dedup_first", 3),
    ("conflicts_prefer_non_none", 3), ("distinct_pairs", 1), ("label_counts", 1), ("reliability_bins", 1),
])
def test_number_of_shuffles(spark, sf, name, shuffles):
    text = plan(registry.registry()[name](spark, sf))
    if name == "label_counts":  # its ordering of the few classes
        shuffles += text.count("rangepartitioning")
    if name == "reliability_bins":  # its input joins two tables on the sentence key
        shuffles += 2
    assert exchanges(text) <= shuffles, text


@pytest.mark.parametrize("name", [
    "cascade_auto", "explain_with_fallback", "mine_negatives_qa", "mine_negatives_wide", "map_titles",
    "class_weights", "label_index", "classification_report", "cascade_summary", "balance_min", "stratified_split"])
def test_no_pairwise_joins(spark, sf, name):
    text = plan(registry.registry()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_needed_columns(spark, sf):
    text = plan(registry.registry()["cascade_keyword"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_filter_does_not_repeat_the_lowering(spark, sf):
    text = plan(registry.registry()["cascade_keyword"](spark, sf))
    assert text.count("lower(") == 1


def test_negatives_stay_in_their_row(spark, sf):
    text = plan(mining.qa_negatives(mining.qa_paragraphs(derive.qa_files(spark, sf))))
    assert "Join" not in text


def test_threshold_selection_needs_no_shuffle(spark, sf):
    rows = derive.clauses(spark, sf).withColumn("label", F.col("h") % 3)
    picked = sampling.balance_cap(rows, 100, ("doc_id", "sent_idx"))
    text = plan(picked)
    assert "Window" not in text and exchanges(text) == 0


@pytest.mark.parametrize("name", [
    "dedup_first", "conflicts_prefer_non_none", "conflicts_majority", "conflicts_majority_deduped"])
def test_first_seen_rows_need_no_sort_aggregate(spark, sf, name):
    assert "SortAggregate" not in plan(registry.registry()[name](spark, sf))


def test_cascade_joins_move_no_text(spark, sf):
    text = plan(registry.registry()["cascade_auto"](spark, sf))
    joins = [line for line in text.splitlines() if re.search(r"Project \[doc_id[^\]]*tier1", line)]
    assert joins and not any("sentence" in line for line in joins)


def test_majority_moves_texts_once(spark, sf):
    """Labels are chosen where their keys are, without dealing by counts; the corpora are cut and labelled once and read from there."""
    text = plan(corpus.resolve_conflicts(corpus.merge_corpora(list(derive.labelled_sources(spark, sf).items())), "majority"))
    assert not re.search(r"hashpartitioning\(_k1#\d+L?, _k2#\d+L?, _n", text)
    assert "Generate" not in text and "posexplode" not in text


def test_report_is_written_packed(spark, tmp_path):
    """A report written as packed JSON reads back as it was."""
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.array(F.lit("a clause")).alias("risks"))
    analyze.write_report(rows, str(tmp_path / "r"), compression="gzip")
    assert list((tmp_path / "r").glob("*.json.gz")) and not list((tmp_path / "r").glob("*.json"))
    assert sorted(spark.read.schema(rows.schema).json(str(tmp_path / "r")).collect()) == sorted(rows.collect())


@pytest.mark.parametrize("strategy", ["prefer_non_none", "majority"])
def test_distinct_pairs_move_twice_at_most(spark, sf, strategy):
    """Texts move to their pair and then to their key; no table of keys and no second copy of the pairs is dealt out."""
    merged = corpus.merge_corpora(list(derive.labelled_sources(spark, sf).items()))
    text = plan(corpus.resolve_conflicts(corpus.distinct_pairs(merged), strategy, distinct=True))
    assert exchanges(text) == 2 and "Join" not in text
    assert exchanges(plan(registry.registry()["conflicts_majority_deduped"](spark, sf))) == 2


def test_training_corpus_is_written_once(spark, sf, monkeypatch):
    """Of the merged texts only the ranked rows are written before the balance, and these packed."""
    written = []

    def recorded(df, name, *rest):
        out = scratch.store(df, name, *rest)
        written.extend([(name, *rest)] if "sentence" in df.columns else [])
        return out

    for module in (sampling, derive, build_corpus):
        monkeypatch.setattr(module, "store", recorded, raising=False)
    registry.registry()["merged_training_corpus"](spark, sf)
    assert written == [("labelled", "zstd"), ("ranked", "zstd")]
