"""Batch scorers that fail, and models that are loaded once and published whole."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.config import CascadeConfig
from pactlens.functions.calibration import top1
from pactlens.functions.text import blank, strip
from pactlens.operators import cascade, classify, models
from pactlens.plans import analyze


def lengths(texts):
    if texts.str.contains("bad").any():
        raise RuntimeError("no score")
    return pd.DataFrame({"A": texts.str.len().astype(float), "B": 0.0}, index=texts.index)


def test_only_the_sentences_at_fault_abstain(spark):
    texts = ["good", "bad", "fine", "bad too", "x" * 40, "worse", "bad"] + [f"text {i}" for i in range(50)]
    df = spark.createDataFrame([(i, t, i % 5 != 4) for i, t in enumerate(texts)], "i int, sentence string, asked boolean").coalesce(1)
    got = {r["i"]: r["scores"] for r in cascade.with_scores(df, lengths, on_error="abstain").collect()}
    for i, t in enumerate(texts):
        assert got[i] is None if "bad" in t else [(s["label"], s["score"]) for s in got[i]] == [("A", len(t)), ("B", 0.0)]
    got = {r["i"]: r["scores"] for r in cascade.with_scores(df, lengths, where="asked", on_error="abstain").collect()}
    assert all((got[i] is None) == ("bad" in t or i % 5 == 4) for i, t in enumerate(texts))
    with pytest.raises(Exception, match="no score"):
        cascade.with_scores(df, lengths).collect()
    # All fail, or the scorer drops rows.
    assert {str(r["scores"]) for r in cascade.with_scores(df.filter("sentence like 'bad%'"), lengths, on_error="abstain").collect()} == {"None"}
    short = cascade.with_scores(df, lambda t: lengths(t[:-1]) if len(t) > 1 else lengths(t), on_error="abstain").collect()
    assert all((r["scores"] is None) == ("bad" in r["sentence"]) for r in short)


def test_failures_cost_few_calls():
    texts = pd.Series([f"text {i}" for i in range(4096)])
    texts[[17, 3000]] = "bad"
    calls = []

    def counted(part):
        calls.append(len(part))
        return lengths(part)

    parts = list(cascade.scored_parts(counted, texts, np.arange(len(texts)), True))
    rows = np.concatenate([p for p, _ in parts])
    assert sorted(rows.tolist()) == [i for i in range(4096) if i not in (17, 3000)] and (np.diff(rows) > 0).all()
    assert len(calls) <= 2 * 2 * 12 + 1


def test_a_process_loads_a_model_once():
    calls = []

    def load(path):
        calls.append(path)
        return object()

    first = models.loaded(load, "/m", "1")
    assert models.loaded(load, "/m", "1") is first and calls == ["/m"]
    assert models.loaded(load, "/m", "2") is not first
    for i in range(models.KEPT):
        models.loaded(load, f"/other{i}")
    assert models.loaded(load, "/m", "1") is not first


def test_published_classifier(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    rows = [(f"pay the fine {i}", "Penalty") for i in range(12)] + [(f"nice words {i}", "None") for i in range(12)]
    train = spark.createDataFrame(rows, "sentence string, label string")
    model = classify.fit_classifier(train, str(tmp_path / "work"), max_iter=5)
    with pytest.raises(Exception):
        classify.TextClassifier.current(spark, path)
    model.publish(path, {"model_type": "first"})
    first = classify.TextClassifier.current(spark, path)
    assert first.labels == model.labels
    # A second load reads the pointer alone.
    monkeypatch.setattr(classify.TextClassifier, "load", classmethod(lambda *a: pytest.fail("loaded again")))
    assert classify.TextClassifier.current(spark, path) is first
    monkeypatch.undo()

    def half(folder):
        model.model.write().overwrite().save(f"{folder}/model")
        raise RuntimeError("writer lost")

    with pytest.raises(RuntimeError):
        models.publish(spark, path, half)
    assert classify.TextClassifier.current(spark, path) is first
    model.publish(path, {"model_type": "second"})
    second = classify.TextClassifier.current(spark, path)
    assert second is not first and second.labels == first.labels


def test_failing_scorer_is_called_little_more_than_needed():
    """103 sentences at fault of 10,000: all others are scored, in fewer calls than halving takes."""
    bad, calls = set(range(50, 10_000, 97)), []

    def scorer(texts):
        calls.append(len(texts))
        if not bad.isdisjoint(texts):
            raise RuntimeError("no score")
        return pd.DataFrame({"a": texts.to_numpy(dtype="float64")})

    got = [i for rows, frame in cascade.scored_parts(scorer, pd.Series(range(10_000)), np.arange(10_000), True) for i in rows]
    assert got == [i for i in range(10_000) if i not in bad]
    assert len(calls) < 1_100


class Picked(pd.Series):
    """A Series that counts how often sentences are picked from it, or from what was, by their places."""

    picks = 0

    @property
    def _constructor(self):
        return Picked

    def take(self, *args, **kwargs):
        Picked.picks += 1
        return super().take(*args, **kwargs)

    def _take_with_is_copy(self, *args, **kwargs):
        Picked.picks += 1
        return super()._take_with_is_copy(*args, **kwargs)


def test_sentences_are_picked_once_whatever_the_faults(monkeypatch):
    monkeypatch.setattr(Picked, "picks", 0)
    texts = Picked([f"bad {i}" if i % 50 == 7 else f"text {i}" for i in range(1000)])
    parts = list(cascade.scored_parts(lengths, texts, np.arange(1, 1000), True))
    assert np.concatenate([rows for rows, _ in parts]).tolist() == [i for i in range(1, 1000) if i % 50 != 7]
    assert Picked.picks <= 2


def test_a_scorer_may_change_what_it_is_given():
    def spoiling(texts):
        seen = texts.tolist()
        texts.iloc[:] = "bad"
        if "bad" in seen:
            raise RuntimeError("no score")
        return pd.DataFrame({"n": [float(len(t)) for t in seen]})

    texts = pd.Series([f"text {i}" for i in range(64)])
    texts[9] = "bad"
    parts = list(cascade.scored_parts(spoiling, texts, np.arange(64), True))
    assert np.concatenate([rows for rows, _ in parts]).tolist() == [i for i in range(64) if i != 9]
    assert texts.tolist().count("bad") == 1


def test_labels_are_held_once_for_each_list_of_columns():
    frames = [pd.DataFrame({"A": [0.1, 0.2], 7: [0.3, 0.4]}), pd.DataFrame({"B": [0.5]}), pd.DataFrame({"A": [0.6], 7: [0.7]})]
    lists = cascade._score_lists(list(zip((np.array([4, 0]), np.array([1]), np.array([3])), frames)), 5)
    pairs = [row and [(s["label"], s["score"]) for s in row] for row in lists.to_pylist()]
    assert pairs == [[("A", 0.2), ("7", 0.4)], [("B", 0.5)], None, [("A", 0.6), ("7", 0.7)], [("A", 0.1), ("7", 0.3)]]
    assert cascade._score_lists([], 2).to_pylist() == [None, None]


def test_labels_make_no_object_for_each_score(monkeypatch):
    made = []
    monkeypatch.setattr(cascade.np, "tile", lambda a, n, tile=np.tile: made.append(np.asarray(a).dtype) or tile(a, n))
    cascade._score_lists([(np.arange(3), pd.DataFrame({"A": [0.1, 0.2, 0.3], "B": 0.0}))], 3)
    assert made and object not in made


def test_tops_are_those_of_the_scores(spark):
    """Equal scores, NaN, unnamed classes, other columns in other parts, no columns, and rows without scores."""
    frames = [pd.DataFrame({"A": [0.5, np.nan, -0.0], "LABEL_1": [0.5, 0.9, 0.0]}), pd.DataFrame({"LABEL_7": [0.7], 3: [0.1]}),
              pd.DataFrame(index=[0]), pd.DataFrame({"A": [0.1], "B": [np.nan], "C": [np.nan]})]
    parts = list(zip((np.array([5, 0, 3]), np.array([1]), np.array([6]), np.array([4])), frames))
    scores = pa.RecordBatch.from_arrays([pa.array(range(8)), cascade._score_lists(parts, 8)], ["i", "scores"])
    df = spark.createDataFrame([(i,) for i in range(8)], "i long").coalesce(1)
    lists = df.mapInArrow(lambda it: (scores for _ in it), T.StructType([*df.schema.fields, T.StructField("scores", cascade.SCORES_TYPE)]))
    want = {r["i"]: r["t"] and tuple(r["t"]) for r in lists.select("i", top1(F.col("scores")).alias("t")).collect()}
    got = cascade._score_tops(parts, 8).to_pylist()
    assert [str(t and (t["label"], t["confidence"])) for t in got] == [str(want[i]) for i in range(8)]
    assert cascade._score_tops([], 2).to_pylist() == [None, None]


def calls_of(spark, scorers, texts):
    """(rows by text, runs of sentences by tier) of `score_by_models` in one batch."""
    counts = {tier: spark.sparkContext.accumulator(0) for tier in scorers}

    def counted(tier):
        def run(part):
            counts[tier].add(1)
            return scorers[tier](part)
        return run

    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, sent_idx int, sentence string").coalesce(1)
    rows = analyze.score_by_models(df, CascadeConfig(mode="auto"), {tier: counted(tier) for tier in scorers}).collect()
    return {r["sentence"]: r for r in rows}, {tier: c.value for tier, c in counts.items()}


def test_second_tier_does_not_search_again_for_what_failed(spark):
    def scorer(score):
        def run(texts):
            if texts.str.contains("bad").any():
                raise RuntimeError("no score")
            return pd.DataFrame({"None": 0.1, "Penalty": np.full(len(texts), score)})
        return run

    texts = [f"bad, and it shall be {i}" if i % 100 == 37 else f"text {i}" for i in range(2000)]
    rows, calls = calls_of(spark, {"tier1": scorer(0.2), "tier2": scorer(0.9)}, texts)
    assert len(rows) == 2000
    for t, r in rows.items():
        assert (r["risk_type"], r["detector"], r["confidence"]) == (("Obligation", "keyword", 0.0) if "bad" in t else ("Penalty", "ml", 0.9))
    assert calls["tier1"] > 100 and calls["tier2"] <= 20 + 8


def test_what_fails_once_may_still_be_scored(spark):
    """Doubtful sentences that the second tier takes are scored, and those that only it fails on abstain."""
    def scorer(word):
        def run(texts):
            if texts.str.contains(word).any():
                raise RuntimeError("no score")
            return pd.DataFrame({"None": 0.1, "Penalty": np.full(len(texts), 0.55)})
        return run

    rows, _ = calls_of(spark, {"tier1": scorer("one"), "tier2": scorer("two")}, ["one", "two", "one two", "two: shall", "plain", " "])
    assert {t: r["detector"] for t, r in rows.items()} == {"one": "ml", "plain": "ml", "two: shall": "keyword"}


def test_blank_is_what_strip_empties(spark):
    texts = [None, "", " ", " \x1c\t", "a", " a", "a ", "​", "\x00", "\xa0.\xa0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(blank(F.col("t")).alias("b"), (F.length(strip(F.col("t"))) == 0).alias("s")).collect()
    assert [r["b"] for r in rows] == [r["s"] for r in rows] == [True] * 4 + [False] * 6
