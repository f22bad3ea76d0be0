"""Header CSV files read by the names of their columns, each file by its own header."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.operators.sizing import broadcast_if_small

FILE = "_metadata.file_path"
_CSV = {"escape": '"', "inferSchema": False}


def header_rows(spark: SparkSession, path) -> DataFrame:
    """(file, header): the first line that is not blank of every file that has one.

    Only the lines of each file's first block are looked at, without parsing; one row per file and
    task is shuffled. A header has no line break inside a quoted name.
    """
    lines = spark.read.text(path).select(
        F.col(FILE).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    named = lines.filter((F.col("block") == 0) & (F.trim("value") != ""))
    return named.groupBy("file").agg(F.min_by("value", "row").alias("header"))


def names_of(header: str) -> tuple:
    """Column names of a header line; of equal names the last one counts, the others get a number."""
    names = next(csv.reader([header.removeprefix("﻿")]))
    return tuple(n if n not in names[i + 1:] else f"{n}#{i}" for i, n in enumerate(names))


def read_by_header(spark: SparkSession, path, required: tuple = (), multi_line: bool = True, order: bool = False) -> DataFrame:
    """All rows of quoted header CSV files, every column as text, under the names in each file's own header.

    Files with equal headers are read together, so columns may stand in another order in another file, be
    missing (NULL there) or come in addition. A file whose header lacks a name of `required` raises ValueError;
    a file without any line is skipped. With `multi_line`, fields may hold line breaks and a file is one task; give
    False where the writer quotes none, and large files are split over many tasks.

    With `order`, `seq` grows with the position in the input: files count in the order of their paths, then blocks
    and rows as they lie in the file, whatever the sizes of files and splits and the number of cores. It packs
    (file, block start, row) into one number; only its order has a meaning.
    """
    files = {r["file"]: names_of(r["header"]) for r in header_rows(spark, path).collect()}
    groups: dict[tuple, list] = {}
    for file, names in sorted(files.items()):
        lacking = [c for c in required if c not in names]
        if lacking:
            raise ValueError(f"{unquote(file)}: expected columns {', '.join(map(repr, required))}")
        groups.setdefault(names, []).append(file)
    if not groups:
        names = required or ("value",)
        groups = {names: []}
    parts = [_read(spark, path, names, own, len(groups) > 1, multi_line, order) for names, own in groups.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if not order:
        return out
    ranks = spark.createDataFrame(list(enumerate(sorted(map(_plain, files)))), "_rank long, _path string")
    numbered = out.join(broadcast_if_small(ranks), _plain_column("_file") == F.col("_path"))
    # 8 digits for the file, 12 for the block's first byte, 10 for the row.
    seq = F.col("_rank").cast("decimal(8,0)") * F.lit(10 ** 12).cast("decimal(13,0)") + F.col("_block")
    seq = seq.cast("decimal(20,0)") * F.lit(10 ** 10).cast("decimal(11,0)") + F.col("_row")
    return numbered.withColumn("seq", seq.cast("decimal(30,0)")).drop("_file", "_block", "_row", "_rank", "_path")


def _read(spark: SparkSession, path, names: tuple, files: list, several: bool, multi_line: bool, order: bool) -> DataFrame:
    """The files of one header; their names prune the listing, so each file is read by one group."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=multi_line, **_CSV)
    if several or not files:
        raw = raw.filter(F.col(FILE).isin(files) if files else F.lit(False))
    if not order:
        return raw
    # Row numbers of a task grow along each block; the task's own number, in the high bits, is cut off.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select("*", F.col(FILE).alias("_file"), F.col("_metadata.file_block_start").alias("_block"), row.alias("_row"))


def _plain(path: str) -> str:
    """A path without scheme slashes and escapes, which listings and metadata write differently."""
    return re.sub(r"^([a-z0-9]+):/+", r"\1:/", unquote(path))


def _plain_column(name: str) -> Column:
    return F.regexp_replace(F.try_url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):/+", "$1:/")
