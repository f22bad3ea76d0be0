"""Input rows with errors kept beside the accepted ones, counted in the pass that writes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.functions.text import strip
from pactlens.sources.scratch import scratch_dir

ERR_BLANK_SENTENCE = "blank sentence"
ERR_BLANK_LABEL = "blank label"
OTHER = "other"


@dataclass
class Checked:
    """Accepted rows, rejected rows with their error, and the number of rows by error (None: accepted)."""

    accepted: DataFrame
    rejected: DataFrame
    counts: dict

    def report(self) -> DataFrame:
        """(error, n), NULL for the accepted rows; errors that do not occur have 0."""
        return self.accepted.sparkSession.createDataFrame(list(self.counts.items()), "error string, n long")


def split_checked(rows: DataFrame, errors: tuple, error: str = "error", path: str | None = None, least: int = 0) -> Checked:
    """Write `rows` once, split by whether their `error` is NULL, and count them by error on the way.

    One pass: the counts come from an observation of the rows that are written, and both parts are partitions of one
    table, so reading one of them does not touch the other. `errors` lists the known errors, which bounds the
    counters; others are counted together as "other". Fewer accepted rows than `least` raise RuntimeError.
    """
    spark = rows.sparkSession
    path = path or scratch_dir(spark, "checked")
    seen = Observation()
    e = F.col(error)
    known = [F.count_if(e == name).alias(f"e{i}") for i, name in enumerate(errors)]
    watched = rows.observe(seen, F.count_if(e.isNull()).alias("ok"), F.count(e).alias("bad"), *known)
    watched.withColumn("accepted", e.isNull()).write.mode("overwrite").partitionBy("accepted").parquet(path)
    got = seen.get
    counts = {None: got["ok"], **{name: got[f"e{i}"] for i, name in enumerate(errors)}}
    counts[OTHER] = got["bad"] - sum(got[f"e{i}"] for i in range(len(errors)))
    if counts[None] < least:
        raise RuntimeError(f"{counts[None]} usable rows, {least} are needed; refused: " + ", ".join(f"{k} {v}" for k, v in counts.items() if k and v))
    schema = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())])
    table = spark.read.schema(schema).parquet(path)
    return Checked(table.filter("accepted").drop("accepted", error), table.filter("NOT accepted").drop("accepted"), counts)


def check_labelled(rows: DataFrame, path: str | None = None, least: int = 0) -> Checked:
    """Labelled rows split into usable ones, stripped, and those with a blank sentence or label."""
    cleaned = rows.withColumns({c: strip(F.col(c)) for c in ("sentence", "label")})
    error = F.when(F.col("sentence") == "", F.lit(ERR_BLANK_SENTENCE)).when(F.col("label") == "", F.lit(ERR_BLANK_LABEL))
    return split_checked(cleaned.withColumn("error", error), (ERR_BLANK_SENTENCE, ERR_BLANK_LABEL), path=path, least=least)
