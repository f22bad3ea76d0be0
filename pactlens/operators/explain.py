"""Prompts for an external answer batch and the choice between answer and template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.functions import risk
from pactlens.functions.text import strip
from pactlens.functions.validation import request_error


def validate_requests(requests: DataFrame) -> DataFrame:
    """Strip the three request fields and add an `error` column (NULL if valid)."""
    fields = ("sentence", "risk_type", "severity")
    checked = requests.withColumn("error", request_error(*[F.col(f) for f in fields]))
    for f in fields:
        checked = checked.withColumn(f, strip(F.col(f)))
    return checked


def explain_prompts(risks: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Add `system` and `user`, the two messages of an explanation prompt."""
    p = risk.prompt(F.col(sentence), F.col("risk_type"), F.col("severity"))
    return risks.withColumn("_p", p).select(*risks.columns, "_p.system", "_p.user")


def explain_with_fallback(risks: DataFrame, answers: DataFrame, keys: tuple) -> DataFrame:
    """Attach external answers; rows without one get the template.

    `answers` holds `keys` and `answer`; a row with a blank or NULL answer counts as
    answered and gets the fixed fallback text.
    """
    found = answers.select(*keys, F.col("answer"), F.lit(True).alias("_answered"))
    joined = risks.join(found, list(keys), "left")
    text = strip(F.col("answer"))
    answer = F.when(F.length(text) > 0, text).otherwise(F.lit(risk.EMPTY_ANSWER))
    template = risk.explanation(F.col("risk_type"), F.col("severity"))
    return joined.select(
        *risks.columns,
        F.when(F.col("_answered"), answer).otherwise(template).alias("explanation"),
        F.when(F.col("_answered"), F.lit("llm")).otherwise(F.lit("template")).alias("source"),
    )
