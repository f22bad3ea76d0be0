"""Which rows may meet a table of hashes, told from a bitmap of bounded size before any row moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.sources.scratch import store

BITS = 27     # the bitmap has 2 ** BITS bits, 16 MB, whatever the number of hashes
_BUCKET = 15  # bits of a bucket's number of places, the size of the built-in bitmaps


def _slot(h: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), h), F.lit(1 << BITS))


def bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """(bucket, bits): at most 2 ** (BITS - 15) rows of 4 KB. More hashes make it fuller, never larger."""
    slots = hashes.select(_slot(F.col(column)).alias("slot"))
    rows = slots.select(F.shiftright("slot", _BUCKET).alias("bucket"), F.col("slot").bitwiseAND(F.lit((1 << _BUCKET) - 1)).alias("bit"))
    return store(rows.distinct().groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmap")


def marked(rows: DataFrame, h: Column, table: DataFrame, name: str = "_likely") -> DataFrame:
    """Add `name`: false where the hash `h` is certainly not in the bitmap's table, by a broadcast of that bounded table."""
    lookup = F.broadcast(table.withColumnRenamed("bucket", "_bucket").withColumnRenamed("bits", "_bits"))
    met = rows.join(lookup, F.shiftright(_slot(h), _BUCKET) == F.col("_bucket"), "left")
    place = _slot(h).bitwiseAND(F.lit((1 << _BUCKET) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2.0), place.bitwiseAND(F.lit(7)))) % 2
    return met.select(*rows.columns, F.coalesce(bit == 1, F.lit(False)).alias(name))
