"""Refused rows beside accepted ones, corpora written by label, and windows that lose no late row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pactlens.config import CascadeConfig
from pactlens.operators.cascade import cascade
from pactlens.sources import checked, documents, labeled
from pactlens.streaming import score

KEYWORD = CascadeConfig(mode="keyword")
SCHEMA = "sentence string, label string, seq long"


def test_rows_are_counted_while_they_are_written(spark, tmp_path):
    rows = [("a", "A", 1), (" ", "A", 2), (None, None, 3), ("b", "\t", 4), ("c ", " B", 5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    parts = checked.check_labelled(df.mapInArrow(counted, df.schema), str(tmp_path / "out"), least=2)
    assert parts.counts == {None: 2, "blank sentence": 2, "blank label": 1, "other": 0}
    assert sorted((r["sentence"], r["label"], r["seq"]) for r in parts.accepted.collect()) == [("a", "A", 1), ("c", "B", 5)]
    assert sorted((r["seq"], r["error"]) for r in parts.rejected.collect()) == [(2, "blank sentence"), (3, "blank sentence"), (4, "blank label")]
    assert runs.value == 5  # one pass for the rows, their counts and both parts
    assert sum(r["n"] for r in parts.report().collect()) == 5
    with pytest.raises(RuntimeError, match="blank label 1"):
        checked.check_labelled(df, least=3)
    none = checked.check_labelled(df.limit(0))
    assert none.accepted.count() == none.rejected.count() == 0 and set(none.counts.values()) == {0}


def test_unknown_errors_are_counted_together(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "i int, error string")
    parts = checked.split_checked(df, ("x",))
    assert parts.counts == {None: 1, "x": 1, "other": 2} and parts.accepted.columns == ["i"]


def test_accepted_inputs(spark):
    rows = [("a.txt", None), ("a.exe", "text"), ("", "text"), (None, " ")]
    parts = documents.accept_inputs(spark.createDataFrame(rows, "file_name string, text string"))
    assert parts.accepted.count() == 2 and parts.counts[documents.ERR_FILE_TYPE] == 1
    assert {r["error"] for r in parts.rejected.collect()} == {documents.ERR_FILE_TYPE, documents.ERR_NO_INPUT}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_one_label_is_written_again(spark, tmp_path, fmt):
    path = str(tmp_path / "corpus")

    def read():
        return sorted((r["sentence"], r["label"]) for r in spark.read.format(fmt).option("header", True).load(path).collect())

    first = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "None")], "sentence string, label string")
    labeled.write_corpus(first, path, fmt, by_label=True)
    assert read() == [("a", "A"), ("b", "B"), ("c", "None")]
    again = spark.createDataFrame([("bb", "B"), ("d", "D")], "sentence string, label string")
    for _ in range(2):
        labeled.write_corpus(again, path, fmt, by_label=True)
        assert read() == [("a", "A"), ("bb", "B"), ("c", "None"), ("d", "D")]


def test_late_rows_are_kept_apart(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, sentence string"
    fine = "You must pay a fine."

    def run(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        windows, late = score.run_final_windows(source, KEYWORD, str(tmp_path / "out"), str(tmp_path / "state"))
        return ({(r["window_start"], r["n"], r["closed"]) for r in windows.collect()}, sorted(r["ts"] for r in late.collect()))

    hours = [day + dt.timedelta(hours=h) for h in (1, 2, 30)]
    assert run("a", [(t, fine) for t in hours]) == ({(day, 2, True), (day + dt.timedelta(days=1), 1, False)}, [])
    # Day one has ended by the watermark; a text without risk still moves the watermark on.
    got = run("b", [(day, fine), (hours[2], fine), (day + dt.timedelta(days=9), "Nice words.")])
    assert got == ({(day, 2, True), (day + dt.timedelta(days=1), 2, True)}, [day])
    got = run("c", [(day + dt.timedelta(days=1), fine), (None, fine)])
    assert got[1] == [day, day + dt.timedelta(days=1)] and got[0] >= {(day, 2, True), (day + dt.timedelta(days=1), 2, True)}
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).filter("ts IS NOT NULL")
    risks = cascade(rows, KEYWORD, tier1=None, tier2=None).count()
    assert risks == sum(n for _, n, _ in got[0]) + len(got[1])
