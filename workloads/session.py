"""Local session used by tests, the benchmark and ad-hoc runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from pactlens.sources.scratch import ensure_scratch


def local_session(cpus: int | None = None, app: str = "pactlens") -> SparkSession:
    cpus = cpus or os.cpu_count()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_scratch(spark)
    return spark
