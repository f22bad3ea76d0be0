"""Hard negatives, document fingerprints and the Merkle manifest against brute force, and on awkward rows."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlens.llm import fingerprint, merkle, negatives, order, queries
from tests.llm import brute
from tests.llm.test_llm import AWKWARD, awkward, empty, plain, repeated, table  # noqa: F401

EMBEDDINGS = "vec_id long, embedding array<float>, label int, `q` string, score string"


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_numbered(spark):
    rows = [(random.Random(i).choice("ab"), i % 3, i % 2) for i in range(500)] + [("c", None, 0)] * 40
    df = spark.createDataFrame(rows, "t string, a int, b int").repartition(7)
    got = plain(order.numbered(df, ("a", "b"), "t"), "t", "pos", "n", "a", "b")
    for tree in "abc":
        own = sorted(r[1:] for r in got if r[0] == tree)
        assert [r[0] for r in own] == list(range(len(own))) and {r[1] for r in own} == {len(own)}
        keys = [(-1 if a is None else a, b) for _, _, a, b in own]
        assert keys == sorted(keys) and collections.Counter(keys) == collections.Counter(
            (-1 if a is None else a, b) for t, a, b in rows if t == tree)


# --- 11: hard negatives ---------------------------------------------------------------------------------------


def mined(df, **how):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(df.withColumn("label", label), F.col("vec_id") % 50 == 0, **how)


def test_hard_negatives(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = collections.Counter(brute.hard_negatives([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]))
    assert want and rows_of(queries.op11_hard_negatives(spark, sf)) == want
    # Several blocks of both kinds.
    assert rows_of(mined(df, anchor_block=3, row_block=40)) == want


def test_hard_negatives_of_awkward_rows(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-2, 3)) for _ in range(5)], rng.randint(0, 2)) for i in range(160)]  # many ties
    rows += [(None, [1.0] * 5, 1), (1000, None, 1), (1001, [1.0, None, 0.0, 0.0, 0.0], 1), (1002, [float("nan")] * 5, 2),
             (1003, [float("inf")] * 5, 2), (1004, [1.0] * 5, None), (1050, [], 1), (1051, [2.0, 1.0], 0), (1100, [-1.0] * 5, 9)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], EMBEDDINGS).repartition(3)
    want = collections.Counter(brute.hard_negatives([(k, v if v is None else v + [0.0] * (5 - len(v)), y) for k, v, y in rows]))
    for got in (mined(df), mined(df.union(df)), mined(df, anchor_block=1, row_block=30)):
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert rows_of(got) == want
    assert mined(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    assert mined(df.filter("vec_id % 50 <> 0")).count() == 0
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(50, [1e30], 1, "", "")], EMBEDDINGS))


def test_bounds_hold_and_get_tighter():
    rng = np.random.default_rng(5)
    a, b = (np.floor(256 * (rng.normal(size=(40, 64)) + rng.normal(size=(40, 4)).repeat(16, axis=1))) for _ in range(2))
    exact, last = a @ b.T, np.inf
    fine = negatives.summaries(a, 16), negatives.summaries(b, 16)
    for segments in (1, 4, 16):
        (m, d), (n, e) = ((x[0], x[1]) for x in (negatives.coarser(*f, segments, 4) for f in fine))
        for got, own in (((m, d), negatives.summaries(a, segments)), ((n, e), negatives.summaries(b, segments))):
            assert np.allclose(got[0], own[0]) and np.allclose(got[1], own[1])
        middle, spread = m @ n.T * segments / 64, d @ e.T
        assert (np.abs(exact - middle) <= spread + 1e-3).all()
        assert spread.mean() < last
        last = spread.mean()


def test_summaries_keep_pairs_from_exact_scores(spark, monkeypatch):
    """Where vectors have a coarse shape, few pairs are left to score, with the same result."""
    rng = np.random.default_rng(6)
    shapes = np.repeat(rng.normal(size=(12, 4)), 16, axis=1)
    rows = [(i, [float(x) for x in shapes[i % 12] + 0.02 * rng.normal(size=64)], i % 12 % 4) for i in range(240)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], EMBEDDINGS)
    index, width = negatives.segment_index(df, "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0)
    batch = index.toArrow().combine_chunks().to_batches()[0]
    every = negatives.Rows(batch, width)
    wanted = every.labels[:, None] != every.labels
    best = np.sort(np.where(wanted, every.q @ every.q.T, -np.inf), axis=1)[:, -3]
    alive = negatives.allowed(every, slice(None), every, wanted, best, np.full(len(best), np.inf))
    assert (every.q @ every.q.T >= best[:, None])[wanted & ~alive].sum() == 0
    assert alive.sum() < 0.5 * wanted.sum()
    assert rows_of(mined(df)) == collections.Counter(brute.hard_negatives([(k, [np.float32(x).item() for x in v], y) for k, v, y in rows]))


# --- 12: fingerprints -------------------------------------------------------------------------------------------


def test_fingerprints(table):  # noqa: F811
    want = brute.fingerprints([(r["doc_id"], r["text"]) for r in table.collect()])
    got = fingerprint.fingerprints(table)
    assert rows_of(got) == collections.Counter(want)


def test_fingerprints_of_awkward_rows(awkward, repeated, empty):  # noqa: F811
    docs = [(k, t) for k, t, *_ in AWKWARD]
    for df, rows in ((awkward, docs), (repeated, docs + docs)):
        assert rows_of(fingerprint.fingerprints(df, every=2)) == collections.Counter(brute.fingerprints(rows, every=2))
    assert fingerprint.fingerprints(empty).count() == 0
    one = awkward.filter("doc_id = 6")
    assert rows_of(fingerprint.fingerprints(one)) == collections.Counter(brute.fingerprints([docs[5]]))


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(20)} | {0, (1 << 64) - 1}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in sorted(prints)], "fp long")
    for radius, blocks in ((3, 6), (1, 2), (6, 8), (0, 4)):
        got = plain(fingerprint.within(df, df, radius, blocks), "query", "fp", "bits")
        want = [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= radius]
        assert len(got) == len(want) and {(a % (1 << 64), b % (1 << 64)) for a, b, _ in got} == set(want)
        assert all(((a ^ b) % (1 << 64)).bit_count() == n for a, b, n in got)
    with pytest.raises(ValueError):
        fingerprint.within(df, df, 4, 4)


def test_fingerprints_run_no_python(spark, sf):
    text = queries.op12_fingerprints(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


# --- 13: manifest ------------------------------------------------------------------------------------------------


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def test_manifest(table):  # noqa: F811
    want = collections.Counter(brute.manifest([tuple(r) for r in table.select(*FIELDS).collect()]))
    # One block a tree, or several levels of small ones.
    for height in (merkle.HEIGHT, 2):
        assert rows_of(merkle.manifest(table, height=height)) == want


def test_manifest_of_awkward_rows(spark, awkward, repeated, empty):  # noqa: F811
    for df in (awkward, repeated, awkward.withColumn("n_chars", F.lit(None).cast("long"))):
        want = collections.Counter(brute.manifest([tuple(r) for r in df.select(*FIELDS).collect()]))
        assert rows_of(merkle.manifest(df, height=1)) == want
    assert merkle.manifest(empty).count() == 0
    one = awkward.filter("doc_id = 4")
    assert rows_of(merkle.manifest(one)) == collections.Counter(brute.manifest([tuple(one.select(*FIELDS).first())]))


def test_witnesses_grow_with_each_append():
    """After each append a leaf's partial witness leads to the open subtree that holds it."""
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 8, 21):
        leaves = [rng.randbytes(32) for _ in range(n)]
        block = merkle.Block()
        for leaf in leaves:
            block.append(leaf)
            starts = [at for _, at, _ in block.open] + [len(block.witnesses)]
            for (height, at, node), end in zip(block.open, starts[1:]):
                assert end - at == 1 << height
                assert all(merkle.fold(leaves[i], bytes(block.witnesses[i])) == node for i in range(at, end))
        root = block.root()
        assert all(merkle.fold(x, bytes(w)) == root for x, w in zip(leaves, block.witnesses))


# --- helper: the bitmap before joins ----------------------------------------------------------------------------


def test_bitmap_never_loses_a_hash(spark, monkeypatch):
    from pactlens.llm import prefilter
    rng = random.Random(1)
    every = [rng.getrandbits(63) for _ in range(4000)]
    rows = spark.createDataFrame([(h,) for h in every] + [(None,)], "h long")
    wanted = spark.createDataFrame([(h,) for h in every[:500]] * 2, "w long")
    for bits in (27, 16):  # a small one is full of other hashes, and still has all of its own
        monkeypatch.setattr(prefilter, "BITS", bits)
        got = {r["h"]: r["_likely"] for r in prefilter.marked(rows, F.col("h"), prefilter.bitmap(wanted, "w")).collect()}
        assert len(got) == 4001 and all(got[h] for h in every[:500])
        assert sum(got.values()) <= (560 if bits == 27 else 1000)
    assert not any(r["_likely"] for r in prefilter.marked(rows, F.col("h"), prefilter.bitmap(wanted.limit(0), "w")).collect())
