"""Exact seeded selection agrees with a plain Python ranking."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pactlens.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    # One label holds most rows, and many rows are copies of one text.
    return spark.range(3000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "mid").otherwise("rare").alias("label"),
        F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("sentence"))


def ranking(rows, groups):
    out = {}
    for r in rows.collect():
        out.setdefault(tuple(r[g] for g in groups), []).append(r["seq"])
    return {g: sorted(v, key=lambda s: (hashlib.md5(f"42|{s}".encode()).hexdigest(), s)) for g, v in out.items()}


@pytest.mark.parametrize("cap", [0, 1, 37, 600, 5000])
def test_cap(rows, cap):
    expected = {s for seqs in ranking(rows, ("label",)).values() for s in seqs[:cap]}
    got = {r["seq"] for r in sampling.balance_cap(rows, cap, ("seq",)).collect()}
    assert got == expected


def test_global_limit(rows):
    expected = set(ranking(rows, ())[()][:123])
    assert {r["seq"] for r in sampling.seeded_limit(rows, 123, ("seq",)).collect()} == expected


def test_downsample_max(rows):
    got = sampling.balance(rows, "downsample_max", ("seq",)).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"hot": 300, "mid": 300, "rare": 300}


def test_splits_partition_the_rows(rows):
    ranked = ranking(rows, ("label",))
    expected = {s for seqs in ranked.values() for s in seqs[:int(len(seqs) * 0.25 + 0.5)]}
    split = sampling.stratified_split(rows, 0.25, ("seq",)).collect()
    assert len(split) == 3000 and {r["seq"] for r in split if r["is_test"]} == expected
    split = sampling.random_split(rows, 0.9, ("seq",)).collect()
    assert len(split) == 3000 and sum(r["is_train"] for r in split) == 2700


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(sampling, "broadcast_if_small", lambda df: df)
    rows = spark.range(400).select(F.col("id").alias("seq"), (F.col("id") % 40).alias("label"))
    got = sampling.balance_cap(rows, 3, ("seq",)).groupBy("label").count().collect()
    assert len(got) == 40 and all(r["count"] == 3 for r in got)


def test_duplicate_keys_meet_the_quota(spark):
    rows = spark.range(100).select(
        (F.col("id") % 5).alias("key"), (F.col("id") % 10).cast("string").alias("text"), F.lit("a").alias("label"))
    for cap in (1, 10, 25, 99):
        assert sampling.balance_cap(rows, cap, ("key",)).count() == cap
    split = sampling.random_split(rows, 0.33, ("key",))
    assert split.count() == 100 and split.filter("is_train").count() == 33


def test_null_groups_are_a_group(spark):
    rows = spark.range(20).select(F.col("id").alias("seq"), F.when(F.col("id") < 8, "a").alias("label"))
    assert sampling.balance_cap(rows, 5, ("seq",)).count() == 10


def test_empty_input(spark):
    empty = spark.createDataFrame([], "seq long, label string")
    assert sampling.balance(empty, "downsample_max", ("seq",)).count() == 0
    assert sampling.seeded_limit(empty, 5, ("seq",)).count() == 0


def test_balance_modes(rows):
    assert sampling.balance(rows, "none", ("seq",)) is rows
    assert sampling.balance(rows, "downsample_to=10", ("seq",)).count() == 30
    with pytest.raises(ValueError):
        sampling.balance(rows, "upsample", ("seq",))
