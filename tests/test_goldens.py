"""Golden values: the labelled sample of FIXTURES.md and the rows that are easy to get wrong."""

import os
import re

import pytest
from pyspark.sql import functions as F

from pactlens.config import CascadeConfig, Lexicon
from pactlens.functions import calibration, risk, text
from pactlens.operators import cascade
from pactlens.plans import analyze

FIXTURES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "FIXTURES.md")
KEYWORD = CascadeConfig(mode="keyword")
AUTO = CascadeConfig(mode="auto")


def golden_rows():
    body = open(FIXTURES, encoding="utf-8").read()
    section = body[body.index("### 2.2"):body.index("### 2.3")]
    rows = [[c.strip() for c in line.strip("| \n").split("|")] for line in section.splitlines()
            if line.startswith("| ") and not line.startswith(("| Sentence", "|---"))]
    return [r for r in rows if len(r) == 7]


def value(spark, column, **inputs):
    """Evaluate a column over one row of inputs."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]).select(column.alias("v")).first()["v"]


def sentence_rows(spark, sentences):
    return spark.createDataFrame([(1, i, s) for i, s in enumerate(sentences)], "doc_id long, sent_idx int, sentence string")


def test_labelled_sample(spark):
    rows = golden_rows()
    assert len(rows) == 33
    low = F.lower("sentence")
    df = sentence_rows(spark, [r[0] for r in rows])
    signals = {r["sent_idx"]: r for r in df.select(
        "sent_idx", risk.detect_risk_types(low).alias("types"), risk.modal_score(low).alias("modal"),
        risk.amplifier_delta(low).alias("delta")).collect()}
    scored = {r["sent_idx"]: r for r in analyze.score_sentences(df, KEYWORD).collect()}
    for i, (_, _, types, modal, delta, score, severity) in enumerate(rows):
        assert signals[i]["types"] == ([] if types == "—" else types.split(", "))
        assert signals[i]["modal"] == float(modal)
        assert signals[i]["delta"] == pytest.approx(float(delta))
        if score == "—":
            assert i not in scored
        else:
            assert (scored[i]["severity_score"], scored[i]["severity"]) == (float(score), severity)
            assert scored[i]["risk_type"] == types.split(", ")[0]
            assert scored[i]["confidence"] is None


def test_smoke_values(spark):
    assert value(spark, calibration.calibrate(F.col("p")), p=0.95) == 0.8769
    df = sentence_rows(spark, ["The contractor shall indemnify and hold harmless all parties."]).withColumns(
        {"risk_type": F.lit("Liability"), "confidence": F.lit(0.91)})
    row = cascade.score_severity(df, KEYWORD).first()
    assert (row["severity_score"], row["severity"]) == (0.777, "High")
    docs = spark.createDataFrame([(1, "The contractor shall indemnify all parties. Late payments are subject to a "
                                      "1.5% monthly surcharge. This is a purely administrative clause.")],
                                 "doc_id long, text string")
    row = analyze.analyze_report(docs, KEYWORD).first()
    assert [(r["risk_type"], r["severity_score"], r["severity"]) for r in row["risks"]] == [
        ("Liability", 0.76, "High"), ("Penalty", 0.38, "Medium")]
    assert row["summary"]["risk_percentage"] == 66.67


@pytest.mark.parametrize("sentence,types", [
    ("We define the terms.", ["Penalty"]),
    ("Revenue is shared.", ["Arbitration"]),
    ("Nothing here.", []),
])
def test_substring_categories(spark, sentence, types):
    assert value(spark, risk.detect_risk_types(F.lower("s")), s=sentence) == types


@pytest.mark.parametrize("sentence,modal,delta", [
    ("Willis signs.", 0.0, 0.0),
    ("The party waives claims.", 0.0, 0.30),
    ("The buyer shall not pay.", 0.9, -0.10),
    ("must", 1.0, 0.0),
    ("trust_must 2must müst", 0.0, 0.0),
    ("x (must)", 1.0, 0.0),
])
def test_modal_and_delta(spark, sentence, modal, delta):
    assert value(spark, risk.modal_score(F.lower("s")), s=sentence) == modal
    assert value(spark, risk.amplifier_delta(F.lower("s")), s=sentence) == pytest.approx(delta)


@pytest.mark.parametrize("p,expected", [(0.0, 0.0), (1.0, 1.0), (0.3, 0.3624), (0.95, 0.8769)])
def test_calibration(spark, p, expected):
    assert value(spark, calibration.calibrate(F.col("p")), p=p) == expected


def test_temperature_must_be_positive():
    for bad in (0, -1.0):
        with pytest.raises(ValueError):
            calibration.calibrate(F.lit(0.5), bad)
        with pytest.raises(ValueError):
            CascadeConfig(temperature=bad)


@pytest.mark.parametrize("modal,delta,base,score,label", [
    (0.85, -0.2, 0.70, 0.65, "Medium"),  # 0.6499999999999999 before rounding
    (0.80, -0.2, 0.75, 0.65, "High"),  # 0.6500000000000001 before rounding
])
def test_float_boundaries(spark, modal, delta, base, score, label):
    x = risk.composite(F.col("m"), F.col("d"), F.col("b"), F.lit(None).cast("double"))
    got = value(spark, F.struct(risk.severity_score(x).alias("s"), risk.severity_label(x).alias("l")),
                m=modal, d=delta, b=base)
    assert tuple(got) == (score, label)


def test_boundary_sentence(spark):
    row = analyze.score_sentences(sentence_rows(spark, ["A fine is not required and the buyer is exempt."]), KEYWORD).first()
    assert (row["risk_type"], row["severity_score"], row["severity"]) == ("Penalty", 0.65, "Medium")


def test_half_even_percentage(spark):
    from pactlens.operators.report import percentage
    assert value(spark, percentage(F.col("k"), F.col("n")), k=1, n=32) == 3.12
    assert value(spark, percentage(F.col("k"), F.col("n")), k=0, n=0) == 0.0


def test_top1(spark):
    def pick(pairs):
        df = spark.createDataFrame([(pairs,)], "scores array<struct<label:string,score:double>>")
        return df.select(calibration.top1(F.col("scores")).alias("t")).first()["t"]

    assert tuple(pick([("A", 0.2), ("B", 0.5), ("C", 0.5)])) == ("B", 0.5)
    assert tuple(pick([("LABEL_3", 0.9)])) == ("None", 0.9)
    assert tuple(pick([])) == ("None", 0.0)
    assert pick(None) is None


def auto_row(spark, sentence, t1=None, t2=None, config=AUTO):
    """One sentence through the cascade with optional (label, score) of each tier."""
    df = sentence_rows(spark, [sentence])
    schema = "doc_id long, sent_idx int, scores array<struct<label:string,score:double>>"

    def table(pair):
        return spark.createDataFrame([(1, 0, [pair])] if pair else [], schema)

    rows = analyze.score_sentences(df, config, table(t1), table(t2)).collect()
    return rows[0] if rows else None


def test_tier_confidence_rules(spark):
    fine, plain = "A fine applies.", "Hello there."
    row = auto_row(spark, plain, t2=("Penalty", 0.0))
    assert (row["detector"], row["risk_type"], row["confidence"]) == ("ml", "Penalty", 0.0)
    row = auto_row(spark, fine, t2=("Penalty", 0.31))
    assert (row["detector"], row["confidence"]) == ("keyword", 0.31)
    row = auto_row(spark, fine)
    assert (row["detector"], row["confidence"]) == ("keyword", 0.0)
    row = auto_row(spark, fine, t1=("LABEL_3", 0.9), t2=("None", 0.7))
    assert (row["detector"], row["confidence"]) == ("keyword", 0.7)
    row = auto_row(spark, plain, t1=("Liability", 0.95), t2=("Penalty", 0.9))
    assert (row["detector"], row["risk_type"], row["confidence"]) == ("transformer", "Liability", 0.8769)
    row = auto_row(spark, plain, t1=("Liability", 0.6), t2=("Penalty", 0.9))
    assert (row["detector"], row["confidence"]) == ("ml", 0.9)
    assert auto_row(spark, plain, t1=("None", 0.99), t2=("None", 0.99)) is None
    row = auto_row(spark, fine, t1=("None", 0.99), config=CascadeConfig(mode="transformer"))
    assert (row["detector"], row["confidence"]) == ("keyword", None)
    row = auto_row(spark, plain, t2=("Penalty", 0.1), config=CascadeConfig(mode="ml"))
    assert (row["detector"], row["confidence"]) == ("ml", 0.1)
    row = auto_row(spark, " ", t1=("Penalty", 0.99), t2=("Penalty", 0.99))
    assert row is None


def test_config_modes():
    assert CascadeConfig(mode="  AUTO ").mode == "auto"
    assert CascadeConfig(mode="").mode == "auto"
    odd = CascadeConfig(mode="other")
    assert not odd.uses_ml and not odd.uses_transformer
    config = CascadeConfig.from_settings({"transformer_threshold": "abc", "ml_threshold": "0.7"})
    assert (config.transformer_threshold, config.ml_threshold) == (0.6, 0.7)


def test_default_weight_and_explanation(spark):
    assert value(spark, risk.base_weight(F.col("t"), Lexicon()), t="Other") == 0.5
    assert value(spark, risk.explanation(F.col("t"), F.col("s")), t="Other", s="High") == risk.DEFAULT_EXPLANATION


@pytest.mark.parametrize("raw", [
    "", "  ", "One.", "One. Two!  Three?\nFour", " A.B. C ", "No end", "x. y.　z. ", "a.\x1cb", "...  ...",
])
def test_sentences_match_regex_split(spark, raw):
    expected = [s.strip() for s in re.split(r"(?<=[.!?])\s+", raw) if s.strip()]
    assert value(spark, text.sentences(F.col("t")), t=raw) == expected


@pytest.mark.parametrize("raw", ["", " a  b\t\nc ", " x y　", "\x1ca\x1fb", "plain"])
def test_clean_matches_split_join(spark, raw):
    assert value(spark, text.clean(F.col("t")), t=raw) == " ".join(raw.split())


@pytest.mark.parametrize("raw", ["The IT dept. owns 3 PCs a b", "Größe_x 12 é éà", "", "-- ?"])
def test_tokens_match_default_pattern(spark, raw):
    expected = re.findall(r"\b\w\w+\b", raw.lower())
    assert value(spark, text.tokens(F.col("t")), t=raw) == expected
