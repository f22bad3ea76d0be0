"""Parallelism and broadcast decisions that depend on measured sizes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000
SPLITS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows when the input has few partitions for the cores of the cluster.

    A large corpus arrives in many splits and passes through untouched; a small file
    may have one row group in several splits, all but one empty, and would keep all work in one
    task. Round-robin, so that no key decides the balance. Only plans without a shuffle are
    looked at: a shuffled input has its partitions already, and asking an adaptive plan
    for them would run it.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan" or re.search(r"(?<!Broadcast)Exchange", plan.toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.execute().getNumPartitions() >= SPLITS_PER_CORE * cores else df.repartition(cores * 2)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow lookup table only after counting its rows.

    The table is fetched up to `max_rows + 1` rows. Within the bound it comes back
    as a local table with a broadcast hint, beyond it as is, so that the join
    shuffles under adaptive execution.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
