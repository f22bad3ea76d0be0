"""Decisions that depend on sizes, and the shared scratch folder."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pactlens.operators import sizing
from pactlens.operators.hold import hold
from pactlens.sources.scratch import scratch_dir, store


def test_spread_only_touches_narrow_small_inputs(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    small = spark.read.parquet(str(tmp_path / "one"))
    assert "RoundRobinPartitioning" in sizing.spread(small)._jdf.queryExecution().executedPlan().toString()
    wide = spark.range(0, 1000, 1, 64)
    assert sizing.spread(wide) is wide
    grouped = small.groupBy("id").count()
    assert sizing.spread(grouped) is grouped


def test_spread_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    group = "spread-test"
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    spark.sparkContext.setJobGroup(group, group)
    try:
        sizing.spread(grouped)
        sizing.spread(spark.range(10).coalesce(1))
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_broadcast_only_within_the_bound(spark):
    table = spark.range(20).withColumn("v", F.col("id") * 2)
    assert sizing.broadcast_if_small(table, 19) is table
    small = sizing.broadcast_if_small(table, 20)
    assert sorted(map(tuple, small.collect())) == [(i, 2 * i) for i in range(20)]


def test_hold_keeps_filters_above(spark):
    held = hold(spark.range(10), x=F.md5(F.col("id").cast("string"))).filter("x > '5' AND x < 'f'")
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    assert held.count() == spark.range(10).filter("md5(cast(id as string)) > '5' AND md5(cast(id as string)) < 'f'").count()


def fake_session(settings, chosen=None):
    """The parts of a session that choose the scratch folder; the real setting is static."""
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default))
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: chosen)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_scratch_follows_the_session():
    cluster = fake_session({"spark.checkpoint.dir": "hdfs:///shared/"})
    path = scratch_dir(cluster, "x")
    assert path.startswith("hdfs:///shared/x-") and scratch_dir(cluster, "x") != path
    with pytest.raises(RuntimeError):
        scratch_dir(fake_session({}), "x")
    assert scratch_dir(fake_session({}, "hdfs:///chosen/abc"), "x").startswith("hdfs:///chosen/abc/x-")


def test_store_keeps_rows_and_types(spark):
    rows = spark.range(3).select("id", F.array(F.lit(1.5)).alias("a"), F.lit(None).cast("string").alias("s"))
    stored = store(rows, "rows")
    assert stored.dtypes == rows.dtypes and sorted(map(str, stored.collect())) == sorted(map(str, rows.collect()))
