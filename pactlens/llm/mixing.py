"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is every document's expected number of copies. Whole copies are
taken at once; the fractions are rounded in pairs: words of probability move from one document
to the other, in a random direction, until one fraction is 0 or 1, so the expected words of the
source are kept exactly in each step. Runs of documents are rounded on their own; what each
leaves, one fractional document, meets the others in the next level of a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.words import words
from pactlens.sources.scratch import store

RUN_ROWS = 2_000     # documents of a source that one run rounds
FAN_IN = 500         # residuals that one run of the next level takes
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """Add `_rank` from 0 by value, NULL last, for distinct values.

    Sorted ranges are numbered on their own and shifted by the rows before them, so no task sees
    all values; the per-range counts are as many as there are shuffle partitions.
    """
    sorted_rows = store(rows.withColumn("_null", F.col(column).isNull().cast("int"))
                        .repartitionByRange("_null", column).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted_rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_null", column)) - 1
    return (sorted_rows.withColumn("_i", inside).join(starts, "_part")
            .withColumn("_rank", F.col("_from") + F.col("_i")).drop("_part", "_from", "_i", "_null"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size), one row per source.

    Targets split share * total by weight; a target above cap * size stops there and the excess
    goes to the others by weight, until none is above.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = store(ranked(sizes, "source").withColumn("_w", F.get(cycle, (F.col("_rank") % len(weights)).cast("int")))
                  .withColumn("_cap", F.lit(float(cap)) * F.col("source_size")), "sources")
    budget = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.col("_w") * F.lit(level)
        row = table.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w"))), F.count_if(full)).first()
        if row[2] == stopped or not row[1]:
            break
        stopped, level = row[2], (budget - (row[0] or 0.0)) / row[1]
    return table.select("source", "n", "source_size", F.least("_cap", F.col("_w") * F.lit(level)).alias("target"))


def _pivot(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Round runs of rows sorted by (source, run): all but the last row of a run become whole.

    Columns used: source, run, size, whole, part, u. Only the open row is held over batches.
    """
    at = {c: names.index(c) for c in ("source", "run", "size", "whole", "part", "u")}
    held = None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(len(names))]
        out: list[list] = []
        for row in map(list, zip(*columns)):
            if row[at["size"]] == 0 or not 0 < row[at["part"]] < 1:
                out.append(row)
                continue
            if held is None or (held[at["source"]], held[at["run"]]) != (row[at["source"]], row[at["run"]]):
                if held is not None:
                    out.append(held)
                held = row
                continue
            a, b = held, row
            wa, wb, pa_, pb = a[at["size"]], b[at["size"]], a[at["part"]], b[at["part"]]
            up = min((1 - pa_) * wa, pb * wb)        # words that may move from b to a
            down = min(pa_ * wa, (1 - pb) * wb)      # and from a to b
            moved = up if row[at["u"]] * (up + down) < down else -down
            pa_, pb = pa_ + moved / wa, pb - moved / wb
            a[at["part"]] = 0.0 if pa_ < 1e-9 else 1.0 if pa_ > 1 - 1e-9 else pa_
            b[at["part"]] = 0.0 if pb < 1e-9 else 1.0 if pb > 1 - 1e-9 else pb
            whole_a, whole_b = a[at["part"]] in (0.0, 1.0), b[at["part"]] in (0.0, 1.0)
            held = None
            for r, whole in ((a, whole_a), (b, whole_b)):
                if whole:
                    out.append(r)
                else:
                    held = r
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, batch.schema.field(i).type) for i, c in enumerate(map(list, zip(*out)))], names)
        last = batch.schema
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], last.field(i).type) for i, v in enumerate(held)], names)


def _level(rows: DataFrame) -> DataFrame:
    names = rows.columns
    parts = F.xxhash64("source", "run")
    return (rows.repartition(parts).sortWithinPartitions("source", "run", "u", "id", "size", "crc")
            .mapInArrow(lambda batches: _pivot(batches, names), rows.schema))


def copies(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES,
           key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42,
           run_rows: int = RUN_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(id, size, source, crc, source_size, target, whole, part): copies of every row.

    `whole + part` copies of a row are taken; part is 0 or 1 but for one row of each source.
    A NULL or empty text has size 0, is taken once or twice or not at all, and counts no word;
    NULL is a source of its own, the last; rows that are equal are rounded one by one; the same
    rows give the same copies in every run.
    """
    t = F.col(text)
    rows = store(docs.select(F.col(key).alias("id"), F.size(words(t)).cast("bigint").alias("size"),
                             F.col(source).alias("source"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("crc")), "sizes")
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    goal = targets(sums, weights, share, cap).withColumnRenamed("source", "_source")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = F.shiftrightunsigned(F.xxhash64("id", "source", "size", "crc", F.lit(seed)), 11) / F.lit(float(1 << 53))
    rows = (rows.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("_x", x).withColumn("u", u)
            .withColumn("whole", F.least(F.floor("_x"), F.lit(cap)).cast("bigint"))
            .withColumn("part", F.when(F.col("whole") >= cap, 0.0).otherwise(F.col("_x") - F.col("whole")))
            .withColumn("run", F.pmod(F.xxhash64("id", "crc", F.lit("run")), F.floor(F.col("n") / run_rows) + 1))
            .drop("_x", "n"))
    zero = (F.col("size") == 0) & (F.col("part") > 0)
    rows = rows.withColumn("part", F.when(zero, (F.col("u") < F.col("part")).cast("double")).otherwise(F.col("part")))
    settled, level = [], 0
    while True:
        done = store(_level(rows), "pivot")
        open_rows = done.filter("part > 0 AND part < 1")
        if not open_rows.agg(F.max("run")).first()[0]:
            settled.append(done)
            break
        settled.append(done.filter("part = 0 OR part = 1"))
        level += 1
        u = F.shiftrightunsigned(F.xxhash64("id", "source", "size", "crc", F.lit(seed + level)), 11) / F.lit(float(1 << 53))
        rows = open_rows.withColumn("run", F.floor(F.col("run") / fan_in).cast("bigint")).withColumn("u", u)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.drop("run", "u")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; see `copies`.

    Of the one document of a source whose fraction stays open, that share of its words is taken.
    """
    taken = F.col("whole") * F.col("size") + F.round(F.col("part") * F.col("size"))
    return copies(docs, **how).select(
        F.col("id").alias("doc_id"), "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), "target",
        taken.cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    An open fraction is rounded to the nearer; rows of one key, source and text share their copies evenly,
    the first of them taking what is left.
    """
    key, text, source = how.get("key", "doc_id"), how.get("text", "text"), how.get("source", "source")
    n = (F.col("whole") + (F.col("part") >= 0.5).cast("bigint")).cast("int")
    chosen = (copies(docs, **how).select("id", "source", "crc", "size", n.alias("n"))
              .groupBy("id", "source", "crc", "size").agg(F.sum("n").alias("n"), F.count("*").alias("rows")))
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    on = (F.col(f"d.{key}").eqNullSafe(F.col("c.id")) & F.col(f"d.{source}").eqNullSafe(F.col("c.source"))
          & (F.col("d._crc") == F.col("c.crc")))
    picked = docs.withColumn("_crc", crc).alias("d").join(chosen.alias("c"), on)
    # Of equal rows the first n mod rows take one copy more; only groups with such a rest are numbered.
    rest = F.col("c.n") % F.col("c.rows")
    picked = picked.select("d.*", F.floor(F.col("c.n") / F.col("c.rows")).cast("int").alias("_times"), rest.alias("_rest"))
    nth = F.row_number().over(Window.partitionBy(key, source, "_crc").orderBy(text))
    more = (picked.filter("_rest > 0").withColumn("_times", F.col("_times") + (nth <= F.col("_rest")).cast("int")))
    return (picked.filter("_rest = 0").unionByName(more).filter("_times > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns))
