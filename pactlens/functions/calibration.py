"""Temperature scaling, top-1 choice and calibration bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.config import NONE_LABEL


def _check_temperature(temperature: float) -> float:
    if temperature <= 0:
        raise ValueError(f"temperature must be positive, got {temperature}")
    return float(temperature)


def calibrate(p: Column, temperature: float = 1.5) -> Column:
    """sigmoid(logit(p) / T) to four decimals inside (0, 1), p itself elsewhere."""
    t = _check_temperature(temperature)
    scaled = F.log(p / (F.lit(1.0) - p)) / F.lit(t)
    return F.when(
        (p > 0.0) & (p < 1.0),
        F.bround(F.lit(1.0) / (F.lit(1.0) + F.exp(-scaled)), 4),
    ).otherwise(p)


def softmax(logits: Column, temperature: float = 1.5) -> Column:
    """Temperature-scaled softmax of ARRAY<DOUBLE>, shifted by its maximum."""
    t = _check_temperature(temperature)
    scaled = F.transform(logits, lambda x: x.cast("double") / F.lit(t))
    # One-element wrapper arrays bind the maximum and the total once per row.
    powers = F.transform(F.array(F.array_max(scaled)),
                         lambda top: F.transform(scaled, lambda v: F.exp(v - top)))
    shares = F.transform(powers, lambda es: F.transform(
        F.array(F.aggregate(es, F.lit(0.0), lambda acc, e: acc + e)),
        lambda total: F.transform(es, lambda e: e / total)))
    return F.get(F.get(shares, 0), 0)


def top1(scores: Column) -> Column:
    """STRUCT<label, confidence> of ARRAY<STRUCT<label, score>>.

    The first maximum wins, an empty array gives ("None", 0.0), unnamed
    LABEL_n classes count as "None", and a NULL array (no score row) stays NULL.
    """
    best = F.array_max(F.transform(
        scores,
        lambda s, i: F.struct(F.coalesce(s["score"], F.lit(0.0)).alias("score"), (-i).alias("neg"),
                              F.coalesce(s["label"], F.lit(NONE_LABEL)).alias("label")),
    ))
    label = F.when(F.startswith(best["label"], F.lit("LABEL_")), F.lit(NONE_LABEL)).otherwise(best["label"])
    return F.when(
        F.size(scores) > 0,
        F.struct(label.alias("label"), best["score"].alias("confidence")),
    ).when(
        scores.isNotNull(),
        F.struct(F.lit(NONE_LABEL).alias("label"), F.lit(0.0).alias("confidence")),
    )


def bin_index(confidence: Column, n_bins: int) -> Column:
    """Equal-width bin of a confidence, the last bin closed on the right."""
    return F.least((confidence * F.lit(float(n_bins))).cast("int"), F.lit(n_bins - 1))
