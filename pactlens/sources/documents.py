"""Document uploads and paged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions.validation import (
    ALLOWED_EXTENSIONS, ERR_FILE_TYPE, ERR_NO_INPUT, ERR_TOO_LARGE, MAX_UPLOAD_BYTES, extension, input_error, input_kind)
from pactlens.sources.checked import Checked, split_checked

REPLACEMENT = "\ufffd"
ASIDE = "\ufdd0\ufdd1\ufdd0"  # noncharacters, never part of interchanged text


def ingest_files(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """(path, length, text, error) of every file below a folder.

    Text is decoded as UTF-8 without undecodable bytes. Refused files keep their row
    with an error and no text. A .pdf arrives as page rows elsewhere (`concat_pages`),
    so its text is NULL here. Contents are only read for accepted text files: the size
    test is pushed to the source, and the listing of all others reads no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = files.load(path).select("path", "length")
    ext = extension(F.element_at(F.split("path", "/"), -1))
    error = (F.when(~F.coalesce(ext.isin(*ALLOWED_EXTENSIONS), F.lit(False)), F.lit(ERR_FILE_TYPE))
             .when(F.col("length") > max_bytes, F.lit(ERR_TOO_LARGE)))
    others = listed.withColumn("error", error).filter((F.coalesce(ext, F.lit("")) != "txt") | F.col("error").isNotNull())
    # Repair marks undecodable bytes with U+FFFD; those the file held step aside for it.
    raw = F.replace(F.col("content").cast("string"), F.lit(REPLACEMENT), F.lit(ASIDE))
    repaired = F.replace(F.make_valid_utf8(raw), F.lit(REPLACEMENT), F.lit(""))
    decoded = F.replace(repaired, F.lit(ASIDE), F.lit(REPLACEMENT))
    accepted = files.option("pathGlobFilter", "*.[tT][xX][tT]").load(path).filter(F.col("length") <= max_bytes)
    return accepted.select("path", "length", decoded.alias("text"), F.lit(None).cast("string").alias("error")).unionByName(
        others.select("path", "length", F.lit(None).cast("string").alias("text"), "error"))


def validate_inputs(inputs: DataFrame, file_name: str = "file_name", text: str = "text") -> DataFrame:
    """Add input_kind ('file', 'text' or NULL) and error (NULL if usable)."""
    return (inputs.withColumn("input_kind", input_kind(F.col(file_name), F.col(text)))
            .withColumn("error", input_error(F.col(file_name), F.col(text))))


def accept_inputs(inputs: DataFrame, path: str | None = None, file_name: str = "file_name", text: str = "text") -> Checked:
    """Usable inputs, refused ones with their error, and counts by error, in one pass."""
    return split_checked(validate_inputs(inputs, file_name, text), (ERR_FILE_TYPE, ERR_NO_INPUT, ERR_TOO_LARGE), path=path)


def concat_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """(doc, text): page texts joined in page order without a separator, one row per document.

    The result is one string value, so a document is limited to what one holds, 2 GB; a document's
    pages meet in one task, as its text does.
    """
    joined = pages.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(
        F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t")))).alias("_ps"))
    return joined.select(doc, F.array_join(F.transform("_ps", lambda x: x["t"]), "").alias("text"))
