"""Labelled CSV corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions.text import strip
from pactlens.operators.corpus import clean_rows
from pactlens.sources.headers import read_by_header

MIN_ROWS = 20


def read_labeled(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """(sentence, label, seq and the other columns), cleaned; every file's header must name both columns.

    Columns are found by name in each file. `multi_line=False` splits large files, for writers that quote
    no line breaks.
    """
    return clean_rows(read_by_header(spark, path, ("sentence", "label"), multi_line, order=True), "sentence", "label")


def load_training_data(spark: SparkSession, path, min_rows: int = MIN_ROWS, multi_line: bool = True) -> DataFrame:
    """(sentence, label, seq), stripped, blank rows dropped; refuses a tiny corpus.

    A file without one of the columns has blank values there, so none of its rows stay.
    """
    raw = read_by_header(spark, path, (), multi_line, order=True)
    cols = {c: strip(F.col(c)) if c in raw.columns else F.lit("") for c in ("sentence", "label")}
    rows = raw.withColumns(cols).filter("sentence != '' AND label != ''").select("sentence", "label", "seq")
    if rows.limit(min_rows).count() < min_rows:
        raise RuntimeError("Training data too small. Add more labeled examples.")
    return rows


def write_corpus(df: DataFrame, path: str, fmt: str = "csv", by_label: bool = False,
                 compression: str | None = None) -> None:
    """(sentence, label[, source]) as header CSV or parquet; parent folders are made.

    With `by_label` each label has a folder, and a later write replaces only the folders of the labels it
    holds, so one class can be built again, or a failed write repeated, without touching the others. Read such
    a folder with the format's reader: the label comes from the folders' names. Packed CSV files (`gzip`) are read back
    by every reader here, each file in one task, as files with line breaks inside fields are anyway.
    """
    cols = ["sentence", "label"] + (["source"] if "source" in df.columns else [])
    writer = df.select(*cols).write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if by_label:
        writer = writer.partitionBy("label").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    else:
        writer.format(fmt).save(path)
