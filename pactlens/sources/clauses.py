"""Wide clause tables and nested QA corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pactlens.sources.headers import read_by_header

_TEXT = T.StringType()
ANSWER = T.StructType([T.StructField("text", _TEXT)])
QA = T.StructType([T.StructField("question", _TEXT), T.StructField("answers", T.ArrayType(ANSWER))])
PARAGRAPH = T.StructType([T.StructField("context", _TEXT), T.StructField("qas", T.ArrayType(QA))])
QA_SCHEMA = T.StructType([T.StructField("data", T.ArrayType(
    T.StructType([T.StructField("paragraphs", T.ArrayType(PARAGRAPH))])))])


def read_wide_clauses(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """One row per contract, one text column per clause type, by the names in each file's header.

    `multi_line=False` splits large files, for writers that quote no line breaks.
    """
    return read_by_header(spark, path, (), multi_line)


def read_qa_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """All *.json files (any case) below a folder as (data ARRAY<...>).

    One object per file by default; `lines` reads one object per line, which splits
    large corpora over many tasks.
    """
    reader = (spark.read.schema(QA_SCHEMA).option("multiLine", not lines)
              .option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]"))
    df = reader.json(path)
    if not df.inputFiles():
        raise RuntimeError(f"No .json files found in: {path}")
    return df
