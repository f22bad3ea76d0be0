"""Streams give the batch result; late rows are dropped."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from pactlens.config import CascadeConfig
from pactlens.functions.text import sentences
from pactlens.operators.report import keyword_report
from pactlens.operators.segment import segment_sentences
from pactlens.plans.analyze import report_of_sentences
from pactlens.streaming import score

KEYWORD = CascadeConfig(mode="keyword")


def test_stream_report_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, "You must pay a fine. Fine words. " * (i % 4)) for i in range(40)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = score.run_to_table(score.stream_report(stream, KEYWORD), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = keyword_report(docs, KEYWORD, sentences(F.col("text")))
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect()))


def test_windows_drop_late_rows(spark, tmp_path):
    def write(name, rows):
        spark.createDataFrame(rows, "ts timestamp, sentence string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    day = dt.datetime(2024, 1, 1)
    hours = [day + dt.timedelta(hours=h) for h in (1, 2, 30, 60)]
    write("a", [(t, "You must pay a fine.") for t in hours])
    source = spark.readStream.schema("ts timestamp, sentence string").option(
        "recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def run():
        return score.run_updates_to_table(
            score.stream_severity_windows(source, KEYWORD), str(tmp_path / "out"), str(tmp_path / "state"),
            ("window_start", "severity"), "n").collect()

    first = {(r["window_start"], r["n"]) for r in run()}
    assert first == {(day, 2), (day + dt.timedelta(days=1), 1), (day + dt.timedelta(days=2), 1)}
    # Day one is closed: a row for it is late and must not appear.
    write("b", [(day, "You must pay a fine."), (day + dt.timedelta(days=5), "You must pay a fine.")])
    second = {(r["window_start"], r["n"]) for r in run()}
    assert second - first == {(day + dt.timedelta(days=5), 1)}


def scorer(texts):
    """Penalty for texts with "pay", with a failure where one says "broken"."""
    if texts.str.contains("broken").any():
        raise RuntimeError("no score")
    pay = texts.str.contains("pay").astype(float)
    return pd.DataFrame({"Penalty": pay * 0.9, "None": 1.0 - pay})


def test_scored_stream_equals_batch(spark, tmp_path):
    auto = CascadeConfig(mode="auto")
    docs = spark.createDataFrame(
        [(i, "You must pay a fine. Fine words. A broken text. " * (i % 4)) for i in range(24)] + [(99, None)], "doc_id long, text string")
    sents = segment_sentences(docs)
    scores = sents.select("doc_id", "sent_idx", F.array(F.struct(F.lit("Liability").alias("label"), (F.col("doc_id") / 30.0).alias("score"))).alias("scores"))
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    ways = {"tables": {"tier1": scores.filter("doc_id % 2 = 0"), "tier2": scores.filter("doc_id % 3 = 0")},
            "models": {"scorers": {"tier1": scorer, "tier2": scorer}}}
    for name, way in ways.items():
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = score.run_scored_reports(stream, auto, str(tmp_path / name), str(tmp_path / f"{name}-state"), **way)
        batch = report_of_sentences(docs.select("doc_id"), sents, auto, **way)
        assert out.columns == batch.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect()))
        # Nothing arrives: nothing changes.
        again = score.run_scored_reports(stream, auto, str(tmp_path / name), str(tmp_path / f"{name}-state"), **way)
        assert again.count() == 25
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "none"))
    assert score.run_scored_reports(stream, auto, str(tmp_path / "empty"), str(tmp_path / "empty-state")).count() == 0
