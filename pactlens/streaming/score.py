"""Score documents and sentences as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.config import CascadeConfig
from pactlens.functions.text import sentences
from pactlens.operators.cascade import cascade
from pactlens.operators.report import keyword_report
from pactlens.operators.segment import segment_sentences
from pactlens.plans.analyze import report_of_sentences


def stream_report(docs: DataFrame, config: CascadeConfig, text: str = "text",
                  partitions: int | None = None) -> DataFrame:
    """Nested report per arriving document: row-local, without any state.

    `partitions` spreads each micro-batch first, for sources that deliver few large files.
    """
    if partitions:
        docs = docs.repartition(partitions)
    return keyword_report(docs, config, sentences(F.col(text)))


def run_scored_reports(docs: DataFrame, config: CascadeConfig, path: str, checkpoint: str, tier1: DataFrame | None = None,
                       tier2: DataFrame | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, text: str = "text",
                       scorers: dict[str, Callable] | None = None, partitions: int | None = None) -> DataFrame:
    """The full cascade over arriving documents: nested reports as a table, without any state.

    A document arrives whole, so its sentences meet the score tables (tier1, tier2) inside its micro-batch; the tables are
    read anew for each batch, so rows that a model has added since are seen. `scorers` ("tier1", "tier2") score the
    batch's sentences instead, the second tier only those that the first leaves open. `prepare` turns a batch into
    (doc_id, sent_idx, sentence) where segmentation of `text` is not what is wanted. Each batch overwrites a
    folder of its own, so a batch that is repeated after a failure leaves one copy. Without arrivals the
    table is empty.
    """
    def write(batch: DataFrame, number: int) -> None:
        given = batch.repartition(partitions) if partitions else batch
        sents = prepare(given) if prepare else segment_sentences(given, text)
        report = report_of_sentences(given.select("doc_id"), sents, config, tier1, tier2, scorers)
        report.write.mode("overwrite").parquet(f"{path}/batch={number}")

    write(docs.sparkSession.createDataFrame([], docs.schema), -1)
    query = (docs.writeStream.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    return docs.sparkSession.read.option("basePath", path).parquet(path).drop("batch")


def stream_severity_windows(rows: DataFrame, config: CascadeConfig, ts: str = "ts", window: str = "1 day",
                            delay: str = "1 hour") -> DataFrame:
    """(window_start, severity, n): risks per event-time window, late rows dropped.

    State holds one counter per open window and severity, however many rows arrive. Write it
    with `run_updates_to_table`, which also has the windows that are still open.
    """
    risks = cascade(rows.withWatermark(ts, delay), config, tier1=None, tier2=None)
    counts = risks.groupBy(F.window(ts, window), "severity").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "severity", "n")


def run_final_windows(rows: DataFrame, config: CascadeConfig, path: str, checkpoint: str, ts: str = "ts", window: str = "1 day",
                      delay: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """((window_start, severity, n, closed), (ts, severity, window_start) of late rows): no risk is lost.

    Each micro-batch writes its risks once. A batch's watermark is the latest time of the batches before it, less
    `delay`, and is the same when a batch is repeated; a risk whose window has ended by then is late and goes to
    the second table instead. A window is closed, and its counts are final, once the watermark has passed its end. Rows with
    a NULL time have no window and are left out. What is
    kept are the written risks, two columns each, so there is no state to hold in memory.
    """
    spark = rows.sparkSession
    risks_path, marks_path = f"{path}/risks", f"{path}/marks"
    kinds = f"`{ts}` timestamp, severity string, window_start timestamp, window_end timestamp, late boolean, batch long"
    no_marks = spark.createDataFrame([], "latest timestamp, batch long")

    def watermark(before: int | None) -> Column:
        marks = spark.read.schema(no_marks.schema).parquet(marks_path)
        marks = marks if before is None else marks.filter(F.col("batch") < before)
        latest = marks.agg(F.max("latest")).first()[0]
        return F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}")

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        limit = watermark(number)
        scored = cascade(batch.observe(seen, F.max(ts).alias("latest")), config, tier1=None, tier2=None)
        held = scored.select(F.col(ts), "severity", F.window(ts, window).alias("w"))
        late = F.coalesce(F.col("w.end") <= limit, F.lit(False))
        out = held.select(ts, "severity", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), late.alias("late"))
        out.write.mode("overwrite").parquet(f"{risks_path}/batch={number}")
        mark = spark.range(1).select(F.lit(seen.get["latest"]).cast("timestamp").alias("latest"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{marks_path}/batch={number}")

    no_marks.drop("batch").write.mode("overwrite").parquet(f"{marks_path}/batch=-1")
    nothing = T.StructType([f for f in spark.createDataFrame([], kinds).schema.fields if f.name != "batch"])
    spark.createDataFrame([], nothing).write.mode("overwrite").parquet(f"{risks_path}/batch=-1")
    query = (rows.writeStream.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    risks = spark.read.schema(kinds).parquet(risks_path)
    counts = risks.filter("NOT late").groupBy("window_start", "window_end", "severity").agg(F.count("*").alias("n"))
    closed = F.coalesce(F.col("window_end") <= watermark(None), F.lit(False))
    return counts.select("window_start", "severity", "n", closed.alias("closed")), risks.filter("late").select(ts, "severity", "window_start")


def run_updates_to_table(stream: DataFrame, path: str, checkpoint: str, keys: tuple, count: str) -> DataFrame:
    """Process everything available in update mode; the newest count of every key, open windows included.

    Each micro-batch overwrites its own folder, so a repeated batch leaves one copy. Counts only
    grow, so the largest one of a key is the newest.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.schema(stream.schema).option("basePath", path).parquet(path).select(*stream.columns)
    return rows.groupBy(*keys).agg(F.max(count).alias(count))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available into a parquet folder and return it as a table."""
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
