"""Places of rows in a global order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.operators.sizing import broadcast_if_small
from pactlens.sources.scratch import store


def numbered(rows: DataFrame, order: tuple[str, ...], by: str | None = None, name: str = "numbered") -> DataFrame:
    """Add `pos`, the place from 0 by `order` (NULLs first), and `n`, the rows counted; both anew for each value of `by`.

    Rows are dealt by ranges of (by, order), so no value of `by` or of an order column alone
    fills a task: rows that agree in all of them are told apart by where they came from. Each
    range counts its own rows, and a small table of counts tells where it begins. `by` has no NULL.
    """
    cols = [*([by] if by else []), *order]
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*cols, "_salt")
    kept = store(dealt.withColumn("_part", F.spark_partition_id()), name)
    keys = ["_part", *([by] if by else [])]
    counts = kept.groupBy(*keys).agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = broadcast_if_small(counts.select(
        *[F.col(k).alias(f"_at{k}") for k in keys], F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_from"),
        F.sum("_rows").over(whole).alias("n")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "_salt"))
    met = kept.withColumn("_nth", place).join(starts, [F.col(k) == F.col(f"_at{k}") for k in keys])
    return met.select(*rows.columns, (F.col("_from") + F.col("_nth") - 1).alias("pos"), "n")
