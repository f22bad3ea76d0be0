"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.sources.scratch import store


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of edges (a long, b long); component is the smallest node.

    Alternating large-star and small-star rounds: every round hooks the neighbours of a node to
    the smallest of them, so chains shorten geometrically. Rounds are written to the shared
    folder, and a node's neighbours are only ever reduced to their minimum.
    """
    current = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = current.union(current.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours of a hook to a's smallest.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Small star: smaller neighbours of a, and a itself, hook to the smallest of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        current = store(hooked.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
