"""Shards by weighted rendezvous hashing of stable keys.

Each shard scores a key with -ln(u) / weight, u a hash of (key, shard) in (0, 1), and the lowest
score wins. A further shard takes only the keys whose score it beats; nothing else moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096  # slots are counted in so many cells of each shard


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard number by weight; a shard of weight 0 takes nothing."""
    if not weights or min(weights) < 0 or not any(weights):
        raise ValueError("weights must be non-negative with a positive one")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(i: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(f"shard {i}")), 11) + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.ln(u) / F.lit(float(weights[i]))).alias("s"), F.lit(i).alias("i"))

    scores = [score(i) for i, w in enumerate(weights) if w > 0]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["i"]


def cell(order: tuple[str, ...], cells: int = CELLS) -> Column:
    """Cell of a row by all its order columns."""
    return F.pmod(F.xxhash64(F.lit("cell"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]), F.lit(cells)).cast("int")


def with_slots(rows: DataFrame, shard: str, order: tuple[str, ...], cells: int = CELLS) -> DataFrame:
    """Add `slot`, gapless from 0 in each shard.

    A shard is cut into cells by a hash of the order columns; counts per cell give each
    cell's first slot and only a cell is sorted. Rows of one key, NULL too, spread over the cells by their
    other order columns; rows equal in all of them are interchangeable and share a cell.
    """
    celled = rows.withColumn("_cell", cell(order, cells))
    counts = celled.groupBy(shard, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_s"), F.col("_cell").alias("_c"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    ranked = celled.withColumn("_r", F.row_number().over(Window.partitionBy(shard, "_cell").orderBy(*order)))
    joined = ranked.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_cell") == F.col("_c")))
    return joined.withColumn("slot", (F.col("_from") + F.col("_r") - 1).cast("bigint")).drop("_s", "_c", "_cell", "_from", "_r")


def shard_rows(docs: DataFrame, shards: int = 24, weights: list[float] | None = None,
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row.

    Size is the text's UTF-8 bytes plus 8. NULL and empty texts have 0 bytes; a NULL key hashes
    as an empty one; rows with one key share the shard and get slots of their own.
    """
    weights = weights or [1.0] * shards
    grown = [*weights, sum(weights) / len(weights)]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(t) + F.lit(8)).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"))
    out = with_slots(rows, "shard", (key, "text_crc32", "size"))
    return out.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
