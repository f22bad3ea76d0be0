"""TF-IDF against brute force, the fitted regression against its optimality condition."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Row
from pyspark.sql import functions as F

from pactlens.config import CascadeConfig
from pactlens.functions import calibration
from pactlens.operators import cascade, classify, evaluate, features
from tests.test_goldens import golden_rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, r[0], r[1]) for i, r in enumerate(golden_rows())]
    return spark.createDataFrame(rows, "id long, sentence string, label string")


def brute_tfidf(texts, max_features):
    grams = []
    for t in texts:
        words = re.findall(r"\b\w\w+\b", t.lower())
        grams.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    total = Counter()
    for g in grams:
        total.update(g)
    vocab = sorted(sorted(total, key=lambda t: (-total[t], t))[:max_features])
    df = {t: sum(t in g for g in grams) for t in vocab}
    out = []
    for g in grams:
        w = {t: (1 + math.log(g[t])) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in vocab if t in g}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.append({t: v / norm for t, v in w.items()})
    return vocab, out


@pytest.mark.parametrize("max_features", [10, 500])
def test_tfidf_matches_brute_force(spark, labelled, max_features):
    texts = [r["sentence"] for r in labelled.orderBy("id").collect()] + ["the the the term", "", "?"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, sentence string")
    vocab, want = brute_tfidf(texts, max_features)
    got = {}
    for r in features.tfidf(df, ("id",), max_features=max_features).collect():
        got.setdefault(r["id"], {})[r["term"]] = r["weight"]
    assert set(t for g in got.values() for t in g) == set(vocab)
    for i, row in enumerate(want):
        assert got.get(i, {}) == pytest.approx(row)


def test_empty_vocabulary(spark):
    df = spark.createDataFrame([(1, "?")], "id long, sentence string")
    assert features.tfidf(df, ("id",)).count() == 0


def test_regression_reaches_the_optimum(spark, labelled, tmp_path):
    """At the optimum of 0.5 |w|^2 + C * sum(weight * log loss) the gradient is zero."""
    model = classify.fit_classifier(labelled, str(tmp_path), tol=1e-10)
    rows = spark.read.schema(classify.VECTOR_SCHEMA).parquet(f"{tmp_path}/vectors").select(
        vector_to_array("features").alias("x"), "label_idx", "weight").collect()
    x = np.array([r["x"] for r in rows])
    y = np.array([int(r["label_idx"]) for r in rows])
    c = np.array([r["weight"] for r in rows])
    w, b = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    residual = (p - np.eye(len(b))[y]) * c[:, None]
    assert np.abs(residual.T @ x + w).max() < 1e-3
    assert np.abs(residual.sum(axis=0)).max() < 1e-3


def test_classifier_saved_and_loaded(spark, labelled, tmp_path):
    model = classify.fit_classifier(labelled, str(tmp_path / "w"), max_iter=50)
    model.save(str(tmp_path / "m"), {"model_type": "tfidf_logreg"})
    loaded = classify.TextClassifier.load(spark, str(tmp_path / "m"))
    a = model.predict(labelled).orderBy("id").collect()
    b = loaded.predict(labelled).orderBy("id").collect()
    assert [r["label"] for r in a] == [r["label"] for r in b]
    assert [r["confidence"] for r in a] == pytest.approx([r["confidence"] for r in b])
    per_class, summary = classify.evaluate_classifier(loaded, labelled)
    assert summary.first()["macro_f1"] > 0.9
    assert sum(r["support"] for r in per_class.collect()) == 33
    probe = spark.createDataFrame([(1, "  "), (2, "zzz qqq")], "id long, sentence string")
    got = {r["id"]: (r["label"], r["confidence"]) for r in loaded.predict(probe).collect()}
    assert got[1] == ("None", 0.0) and 0 < got[2][1] < 1
    scores = loaded.score(probe).filter("id = 2").first()["scores"]
    assert sum(s["score"] for s in scores) == pytest.approx(1.0)
    bad = tmp_path / "bad" / "meta"
    spark.range(1).select(F.lit("{}").alias("value")).write.text(str(bad))
    with pytest.raises(ValueError):
        classify.TextClassifier.load(spark, str(tmp_path / "bad"))


def test_class_weights(spark, labelled):
    got = {r["label"]: r["weight"] for r in evaluate.class_weights(labelled).collect()}
    counts = Counter(r["label"] for r in labelled.collect())
    assert got == pytest.approx({k: 33 / (len(counts) * n) for k, n in counts.items()})


def test_scorer_sees_only_open_rows(spark):
    df = spark.createDataFrame([(i, f"s{i}", i % 3 == 0 if i else None) for i in range(10)],
                               "doc_id long, sentence string, open boolean")

    def scorer(texts):
        assert not any(t in ("s0", "s1", "s2") for t in texts)
        return pd.DataFrame({"A": [0.25] * len(texts), "B": [float(len(t)) for t in texts]})

    rows = cascade.with_scores(df, scorer, where="open").orderBy("doc_id").collect()
    assert [r["scores"] is not None for r in rows] == [i in (3, 6, 9) for i in range(10)]
    assert [tuple(s) for s in rows[3]["scores"]] == [("A", 0.25), ("B", 2.0)]
    every = cascade.with_scores(df.filter("doc_id > 2"), scorer).select(calibration.top1(F.col("scores")).alias("t"))
    assert {tuple(r["t"]) for r in every.collect()} == {("B", 2.0)}


def test_scorer_in_the_cascade(spark):
    df = spark.createDataFrame([(1, 0, "hello"), (1, 1, "a fine")], "doc_id long, sent_idx int, sentence string")
    scored = cascade.with_scores(df, lambda t: pd.DataFrame({"None": [0.1] * len(t), "Penalty": [0.95] * len(t)}), "s1")
    rows = cascade.cascade(scored, CascadeConfig(mode="transformer"), tier1="s1", tier2=None).collect()
    assert {(r["risk_type"], r["detector"], r["confidence"]) for r in rows} == {("Penalty", "transformer", 0.8769)}


def test_failing_scorer(spark):
    df = spark.createDataFrame([(1, 0, "hello")], "doc_id long, sent_idx int, sentence string")

    def broken(texts):
        raise RuntimeError("no model")

    assert cascade.with_scores(df, broken, on_error="abstain").first()["scores"] is None
    with pytest.raises(Exception):
        cascade.with_scores(df, broken).collect()


def test_batches_count_terms_once():
    """A batch gives each term once, with its counts, and a NULL term with the number of rows."""
    lists = [["a", "b", "a", "b"], [], ["b"], ["a", "b"], ["b", "a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["_tokens"])
    (out,) = features.term_batches(3)(iter([batch, ]))
    want = {None: (5, 5)}
    for row in lists:
        grams = [" ".join(row[i:i + n]) for n in (1, 2, 3) for i in range(len(row) - n + 1)]
        for g in grams:
            cf, df = want.get(g, (0, 0))
            want[g] = (cf + 1, df)
        for g in set(grams):
            want[g] = (want[g][0], want[g][1] + 1)
    rows = out.to_pylist()
    assert len(rows) == len(want) and {r["term"]: (r["cf"], r["df"]) for r in rows} == want


def test_weights_of_texts_without_known_terms(spark):
    df = spark.createDataFrame([(1, "fee cap fee"), (2, None), (3, "unknown words"), (4, "")], "id int, sentence string")
    vocab = [Row(term_idx=0, term="cap", idf=2.0), Row(term_idx=1, term="fee cap", idf=1.0)]
    got = {r["id"]: [tuple(x) for x in r["weights"]] for r in features.with_weights(df, vocab).collect()}
    assert got[2] == got[3] == got[4] == []
    assert got[1] == [(0, pytest.approx(2 / 5 ** 0.5)), (1, pytest.approx(1 / 5 ** 0.5))]


def test_training_scores_its_rows_once_each(spark, sf, monkeypatch):
    """The result of train_ml comes from a written row per class; scoring is not part of its plan. The merged rows are written once, with their split."""
    from workloads import registry

    written, store = [], registry.store
    monkeypatch.setattr(registry, "store", lambda df, name, *rest: written.append(name) or store(df, name, *rest))
    text = registry.registry()["train_ml"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in text and written == ["split", "per_class"]
