"""Input checks that label bad rows instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.functions.text import strip

# Upload rules and messages.
ALLOWED_EXTENSIONS = ("txt", "pdf")
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_SENTENCE_CHARS = 8000
ERR_FILE_TYPE = "Invalid file type. Only .txt and .pdf are supported."
ERR_NO_INPUT = "No file or text provided."
ERR_TOO_LARGE = "File too large."
ERR_MISSING_FIELDS = "Missing required fields: sentence, risk_type, severity"
ERR_TOO_LONG = "Sentence too long"


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot, NULL without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))


def _has_file(file_name: Column) -> Column:
    return F.coalesce(file_name, F.lit("")) != ""


def _file_ok(file_name: Column) -> Column:
    return F.coalesce(extension(file_name).isin(*ALLOWED_EXTENSIONS), F.lit(False))


def input_kind(file_name: Column, text: Column) -> Column:
    """'file', 'text' or NULL; a file name wins over text."""
    return (F.when(_has_file(file_name), F.when(_file_ok(file_name), F.lit("file")))
            .when(F.length(strip(text)) > 0, F.lit("text")))


def input_error(file_name: Column, text: Column) -> Column:
    return (F.when(_has_file(file_name), F.when(~_file_ok(file_name), F.lit(ERR_FILE_TYPE)))
            .when(F.length(strip(text)) == 0, F.lit(ERR_NO_INPUT)))


def request_error(sentence: Column, risk_type: Column, severity: Column) -> Column:
    """Error of an explanation request, NULL when it is valid."""
    blank = ((F.length(strip(sentence)) == 0) | (F.length(strip(risk_type)) == 0)
             | (F.length(strip(severity)) == 0))
    return (F.when(blank, F.lit(ERR_MISSING_FIELDS))
            .when(F.length(strip(sentence)) > MAX_SENTENCE_CHARS, F.lit(ERR_TOO_LONG)))
