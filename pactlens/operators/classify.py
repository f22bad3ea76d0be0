"""TF-IDF and logistic regression classifier: fit, score, save and load."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.config import NONE_LABEL
from pactlens.functions.calibration import softmax, top1
from pactlens.functions.text import strip
from pactlens.operators import models
from pactlens.operators.evaluate import class_weights, classification_report, f1_summary
from pactlens.operators.features import (
    MAX_FEATURES, Weigher, idf_rows, vector_struct, vocabulary, with_batches, with_weights)
from pactlens.operators.hold import hold

VOCAB_SCHEMA = "term_idx int, term string, idf double"
VECTOR_SCHEMA = T.StructType([
    T.StructField("features", VectorUDT()), T.StructField("label_idx", T.DoubleType()), T.StructField("weight", T.DoubleType())])
MAX_LABELS = 10_000


@dataclass
class TextClassifier:
    """Vocabulary rows (term, idf), label list and fitted regression.

    Scoring adds columns row by row: no join and no shuffle.
    """

    vocab: list
    labels: list
    model: LogisticRegressionModel
    n_max: int = 2

    def score(self, df: DataFrame, text: str = "sentence", name: str = "scores") -> DataFrame:
        """Add all class probabilities as ARRAY<STRUCT<label, score>>.

        A row's few weights meet the coefficients of their terms, class by class, a batch at a time.
        """
        weigh = Weigher(self.vocab, self.n_max)
        lines, offsets = self.model.coefficientMatrix.toArray(), self.model.interceptVector.toArray()

        def margins(batch: pa.RecordBatch) -> pa.Array:
            n = batch.num_rows
            row, at, weight = weigh(batch.column("_tokens"))
            sums = [offset + np.bincount(row, weight * line[at], n) for line, offset in zip(lines, offsets)]
            return pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * len(sums)), pa.array(np.stack(sums, axis=1).ravel()))

        weighted = with_batches(df, text, margins, "_m", T.ArrayType(T.DoubleType()))
        scored = hold(weighted, _p=softmax(F.col("_m"), 1.0))
        pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.get("_p", i).alias("score"))
                          for i, label in enumerate(self.labels)])
        return scored.select(*df.columns, pairs.alias(name))

    def predict(self, df: DataFrame, text: str = "sentence", label: str = "label",
                confidence: str = "confidence") -> DataFrame:
        """Add the most probable class and its probability; a blank text is ("None", 0.0)."""
        kept = df.drop(label, confidence)
        blank = F.length(strip(F.col(text))) == 0
        best = hold(self.score(kept, text, "_scores"), _b=F.when(~blank, top1(F.col("_scores"))))
        return best.select(
            *kept.columns, F.coalesce("_b.label", F.lit(NONE_LABEL)).alias(label),
            F.coalesce("_b.confidence", F.lit(0.0)).alias(confidence))

    def save(self, path: str, meta: dict) -> None:
        """Model, vocabulary and one-row metadata under one folder; `meta` takes metrics and paths too."""
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        rows = [(r["term_idx"], r["term"], r["idf"]) for r in self.vocab]
        spark.createDataFrame(rows, VOCAB_SCHEMA).write.mode("overwrite").parquet(f"{path}/vocab")
        text = json.dumps({"labels": self.labels, "n_max": self.n_max, "max_features": len(self.vocab), **meta})
        spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextClassifier":
        """Load a saved classifier; a folder without the expected metadata is refused."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if "labels" not in meta:
            raise ValueError("Invalid model file format")
        vocab = spark.read.schema(VOCAB_SCHEMA).parquet(f"{path}/vocab")
        vocab = idf_rows(vocab, meta.get("max_features", MAX_FEATURES))
        return cls(vocab, meta["labels"], LogisticRegressionModel.load(f"{path}/model"), meta["n_max"])

    def publish(self, path: str, meta: dict) -> str:
        """Save as a new version below `path` and make it the one that `current` gives."""
        return models.publish(SparkSession.active(), path, lambda folder: self.save(folder, meta))

    @classmethod
    def current(cls, spark: SparkSession, path: str) -> "TextClassifier":
        """The published classifier; a process reads each version once."""
        folder, version = models.published(spark, path)
        return models.loaded(lambda at: cls.load(spark, at), folder, version)


def fit_classifier(
    train: DataFrame,
    work_dir: str,
    text: str = "sentence",
    label: str = "label",
    n_max: int = 2,
    max_features: int = MAX_FEATURES,
    reg_c: float = 1.0,
    max_iter: int = 2000,
    tol: float = 1e-4,
) -> TextClassifier:
    """Fit balanced multinomial logistic regression on TF-IDF rows.

    The penalty C weights a sum of losses; here the mean is minimised, so it becomes
    1 / (C * n). The training vectors are written under `work_dir`: the optimizer passes
    over them many times and must not recompute them, not even when an executor is lost.
    """
    spark = train.sparkSession
    rows = class_weights(train, label).orderBy(label).limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"a classifier has at most {MAX_LABELS} classes")
    labels = [r[label] for r in rows]
    n = sum(r["n"] for r in rows)
    classes = F.broadcast(spark.createDataFrame(
        [(r[label], float(i), r["weight"]) for i, r in enumerate(rows)],
        f"`{label}` string, label_idx double, weight double"))

    vocab = idf_rows(vocabulary(train, text, n_max, max_features), max_features)
    weighted = with_weights(train.select(text, label).join(classes, label), vocab, text, n_max)
    weighted.select(vector_struct(F.col("weights"), len(vocab)).alias("features"), "label_idx", "weight").write.mode(
        "overwrite").parquet(f"{work_dir}/vectors")
    vectors = spark.read.schema(VECTOR_SCHEMA).parquet(f"{work_dir}/vectors")
    lr = LogisticRegression(
        featuresCol="features", labelCol="label_idx", weightCol="weight", family="multinomial",
        regParam=1.0 / (reg_c * n), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=tol)
    model = lr.fit(vectors)
    return TextClassifier(vocab, labels, model, n_max)


def evaluate_classifier(classifier: TextClassifier, test: DataFrame, text: str = "sentence",
                        label: str = "label") -> tuple:
    """(per-class report, F1 summary) on labelled rows."""
    pairs = classifier.predict(test.withColumnRenamed(label, "y_true"), text, "y_pred")
    return classification_report(pairs), f1_summary(pairs)
