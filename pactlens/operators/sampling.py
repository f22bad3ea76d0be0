"""Exact seeded selection of the first rows per group in hash order.

Caps, down-sampling, sampled negatives, splits and seeded limits are all "the first
q rows of each group in the order of md5(seed | row key)". The q-th hash of every group is found
from counts per hash prefix: whole groups, prefixes of the bin that holds it, and the full hashes
of the finer bin. The selection is then a comparison per row, so a class with a third of all rows
is never one task, and every input goes this one way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.operators.sizing import broadcast_if_small
from pactlens.sources.scratch import store

DIGITS = (3, 6, 32)  # hash prefixes; the last is the whole hash

Quota = int | Callable[[Column], Column]


def order_hash(keys: tuple, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def row_hash(columns: list, seed: int) -> Column:
    """Hash of a whole row, NULLs told from texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def ranked_take(df: DataFrame, keys: tuple, quota: Quota, groups: tuple = (), seed: int = 42,
                smallest: bool = False) -> DataFrame:
    """Add `taken`: whether the row is among its group's first `quota` rows in hash order.

    `quota` is a number or a function of the group size; with `smallest`, of the size of
    the smallest group. Rows with equal keys follow each other by the hash of the whole row,
    and of equal rows as many are taken as the quota leaves, so it is always met exactly.
    """
    rows = store(df.withColumn("_h", order_hash(keys, seed)), "ranked", "zstd")
    counts = rows.groupBy(*groups).agg(F.count("*").alias("total"))
    if not callable(quota):
        q = F.lit(int(quota))
    elif smallest:
        q = quota(F.lit(counts.agg(F.min("total")).first()[0]))
    else:
        q = quota(F.col("total"))
    quotas = store(counts.withColumn("q", q.cast("bigint")), "quotas")
    return _taken_flags(rows, quotas, groups, df.columns, seed).select(*df.columns, "taken")


def _match(left: DataFrame, right: DataFrame, groups: tuple) -> DataFrame:
    """Add each group's row of `right`; without groups its single row comes in as literals."""
    if not groups:
        row = right.first()
        if row is None:
            return left.filter(F.lit(False)).withColumns(
                {f.name: F.lit(None).cast(f.dataType) for f in right.schema.fields})
        return left.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in right.schema.fields})
    renamed = right.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    return left.join(broadcast_if_small(renamed), on, "inner").drop(*[f"_g_{g}" for g in groups])


def _cuts(rows: DataFrame, quotas: DataFrame, groups: tuple) -> DataFrame:
    """(groups..., cut, before, n) of groups that are taken in part: the hash of the q-th row, the rows
    before that hash and the rows with it.

    The running sum sees at most 16^3 bins of a group, and at last the hashes that share six digits.
    """
    edges = quotas.filter("q > 0 AND q < total").select(*groups, "q", F.lit("").alias("edge"), F.lit(0).cast("bigint").alias("before"))
    known = 0
    for digits in DIGITS:
        inside = _match(rows.select(*groups, "_h"), edges, groups)
        inside = inside.filter(F.substring("_h", 1, known) == F.col("edge"))
        bins = inside.groupBy(*groups, "q", "before", F.substring("_h", 1, digits).alias("bin")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*groups).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        placed = bins.withColumn("_upto", F.col("before") + upto)
        edges = store(placed.filter((F.col("_upto") >= F.col("q")) & (F.col("_upto") - F.col("n") < F.col("q"))).select(
            *groups, "q", F.col("bin").alias("edge"), (F.col("_upto") - F.col("n")).alias("before"), "n"), "edges")
        known = digits
    return edges.select(*groups, F.col("edge").alias("cut"), "before", "n")


def _taken_flags(rows: DataFrame, quotas: DataFrame, groups: tuple, columns: list, seed: int, level: int = 0) -> DataFrame:
    """(columns..., taken) for rows with `_h`."""
    cuts = _cuts(rows, quotas, groups)
    names = [f"_c_{g}" for g in groups]
    plan = quotas.withColumnsRenamed(dict(zip(groups, names)))
    if groups:
        plan = plan.join(cuts, [F.col(n).eqNullSafe(F.col(g)) for n, g in zip(names, groups)], "left").drop(*groups)
    else:
        plan = plan.join(cuts, F.lit(True), "left")  # one row each
    plan = store(plan.withColumnsRenamed(dict(zip(names, groups))), "cuts")
    taken = (F.when(F.col("q") >= F.col("total"), True).when(F.col("q") <= 0, False)
             .when(F.col("_h") < F.col("cut"), True).when(F.col("_h") > F.col("cut"), False)
             .when(F.col("before") + F.col("n") <= F.col("q"), True))
    flagged = _match(rows, plan, groups).withColumn("taken", taken)
    tied = plan.filter("cut IS NOT NULL AND before + n > q")
    if tied.isEmpty():
        return flagged.select(*columns, "taken")

    clear = flagged.filter("taken IS NOT NULL").select(*columns, "taken")
    ties = flagged.filter("taken IS NULL")
    if level == 0:
        again = store(ties.select(*columns).withColumn("_h", row_hash(columns, seed)), "ties")
        left = store(tied.select(*groups, F.col("n").alias("total"), (F.col("q") - F.col("before")).alias("q")), "quotas")
        return clear.unionByName(_taken_flags(again, left, groups, columns, seed, 1))
    same = ties.groupBy(*columns, (F.col("q") - F.col("before")).alias("_left")).agg(F.count("*").cast("int").alias("_n"))
    copies = same.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return clear.unionByName(copies.select(*columns, (F.col("_i") <= F.col("_left")).alias("taken")))


# --- selections --------------------------------------------------------------------------


def _taken(df: DataFrame) -> DataFrame:
    return df.filter("taken").drop("taken")


def balance_cap(df: DataFrame, cap: int, keys: tuple, label: str = "label", seed: int = 42) -> DataFrame:
    """At most `cap` rows per class."""
    return _taken(ranked_take(df, keys, cap, (label,), seed))


def balance(df: DataFrame, mode: str, keys: tuple, label: str = "label", seed: int = 42) -> DataFrame:
    """Modes none, downsample_max (smallest class) and downsample_to=N."""
    if mode == "none":
        return df
    if mode == "downsample_max":
        return _taken(ranked_take(df, keys, lambda n: n, (label,), seed, smallest=True))
    if mode.startswith("downsample_to="):
        return balance_cap(df, int(mode.split("=", 1)[1]), keys, label, seed)
    raise ValueError("balance must be one of: none, downsample_max, downsample_to=N")


def seeded_limit(df: DataFrame, n: int, keys: tuple, seed: int = 42) -> DataFrame:
    """N rows of the seeded order."""
    return _taken(ranked_take(df, keys, n, (), seed))


def sample_negatives(negatives: DataFrame, n_positive: int, ratio: float, keys: tuple,
                     seed: int = 42) -> DataFrame:
    """int(n_positive * ratio) negatives of the seeded order."""
    return seeded_limit(negatives, int(n_positive * ratio), keys, seed)


def stratified_split(df: DataFrame, test_fraction: float, keys: tuple, label: str = "label",
                     seed: int = 42) -> DataFrame:
    """Add `is_test`: floor(n_c * fraction + 0.5) rows of each class."""
    def quota(n):
        return F.floor(n * F.lit(float(test_fraction)) + F.lit(0.5))

    return ranked_take(df, keys, quota, (label,), seed).withColumnRenamed("taken", "is_test")


def random_split(df: DataFrame, train_fraction: float, keys: tuple, seed: int = 42) -> DataFrame:
    """Add `is_train`: the first floor(n * fraction) rows of the seeded order."""
    def quota(n):
        return F.floor(n * F.lit(float(train_fraction)))

    return ranked_take(df, keys, quota, (), seed).withColumnRenamed("taken", "is_train")
