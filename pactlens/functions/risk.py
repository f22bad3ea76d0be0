"""Keyword tier, severity score, explanations and prompts as Column expressions.

All arithmetic is DOUBLE and keeps one fixed left-to-right order, because some
scores sit exactly on a threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.config import Lexicon
from pactlens.functions.text import has_word

DEFAULT_LEXICON = Lexicon()


def contains_any(lowered: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(n)) for n in needles])


def detect_risk_types(lowered: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """ARRAY<STRING> of all matching categories in lexicon order."""
    hits = [F.when(contains_any(lowered, words), F.lit(name)) for name, words in lexicon.categories]
    return F.array_compact(F.array(*hits))


def keyword_risk(lowered: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """First matching category, or NULL; stops at the first hit."""
    picks = [F.when(contains_any(lowered, words), F.lit(name)) for name, words in lexicon.categories]
    return F.coalesce(*picks)


def modal_score(lowered: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Largest weight among the whole-word modals present, 0.0 if none."""
    strongest_first = sorted(lexicon.modals, key=lambda m: -m[1])
    picks = [F.when(has_word(lowered, word), F.lit(float(weight)))
             for word, weight in strongest_first if weight > 0]
    return F.coalesce(*picks, F.lit(0.0))


def amplifier_delta(lowered: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Sum of the phrase steps in list order, clamped."""
    steps = [(p, lexicon.amplifier_step) for p in lexicon.amplifiers]
    steps += [(p, -lexicon.suppressor_step) for p in lexicon.suppressors]
    total = F.lit(0.0)
    for phrase, step in steps:
        total = total + F.when(F.contains(lowered, F.lit(phrase)), F.lit(float(step))).otherwise(F.lit(0.0))
    return F.greatest(F.lit(lexicon.delta_floor), F.least(F.lit(lexicon.delta_ceiling), total))


def base_weight(risk_type: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    picks = [F.when(risk_type == name, F.lit(float(weight))) for name, weight in lexicon.base_weights]
    return F.coalesce(*picks, F.lit(float(lexicon.default_base_weight)))


def composite(modal: Column, delta: Column, base: Column, confidence: Column) -> Column:
    """Unrounded severity in [0, 1]; a NULL confidence re-weights the other signals."""
    lift = F.lit(0.20) * F.greatest(F.lit(0.0), delta + F.lit(0.5))
    with_conf = F.lit(0.30) * modal + lift + F.lit(0.30) * base + F.lit(0.20) * confidence
    without = F.lit(0.40) * modal + lift + F.lit(0.40) * base
    raw = F.when(confidence.isNull(), without).otherwise(with_conf)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw + delta * F.lit(0.15)))


def severity_label(score: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Label of the unrounded score."""
    return (F.when(score >= F.lit(lexicon.high_threshold), F.lit("High"))
            .when(score >= F.lit(lexicon.medium_threshold), F.lit("Medium"))
            .otherwise(F.lit("Low")))


def severity_score(score: Column) -> Column:
    """Stored score: four decimals, half-even."""
    return F.bround(score, 4)


# Explanation texts as (before severity, after severity, ending if High, ending otherwise).
EXPLANATIONS = {
    "Liability": (
        "This clause defines financial responsibility. Severity is '", "' because it ",
        "broadly exposes you to damages or indemnification obligations.",
        "contains bounded liability language."),
    "Penalty": (
        "This clause imposes financial penalties for non-compliance. '", "' severity ",
        "suggests unlimited or disproportionate charges.",
        "indicates capped or conditional charges."),
    "Termination": (
        "This clause governs contract termination. '", "' severity indicates ",
        "immediate or unilateral termination rights exist.",
        "standard notice-based termination terms."),
    "Obligation": (
        "This clause creates a mandatory obligation (note modal verb strength). '",
        "' severity means this is ",
        "a non-negotiable, absolute requirement.",
        "a conditional or soft obligation."),
    "Arbitration": (
        "This clause mandates dispute resolution outside of regular courts. '", "' severity ",
        "indicates binding arbitration with limited appeal rights.",
        "suggests standard arbitration procedures apply."),
}
DEFAULT_EXPLANATION = "This sentence contains legal terms that may affect your rights or responsibilities."
EMPTY_ANSWER = "Unable to generate an explanation for this clause."

# The two messages of an explanation prompt.
PROMPT_SYSTEM = (
    "You explain legal contract clauses to non-lawyers in plain English. "
    "Be concise and specific, avoid legal jargon, and do not add extra sections."
)
PROMPT_TASK = (
    "Explain the following sentence in 1-2 short sentences for a non-lawyer. "
    "Also briefly say why it is categorized as the given risk type and severity."
)


def explanation(risk_type: Column, severity: Column) -> Column:
    """Template explanation of a risk."""
    picks = [
        F.when(risk_type == name,
               F.concat(F.lit(lead), severity, F.lit(middle),
                        F.when(severity == "High", F.lit(if_high)).otherwise(F.lit(otherwise))))
        for name, (lead, middle, if_high, otherwise) in EXPLANATIONS.items()
    ]
    return F.coalesce(*picks, F.lit(DEFAULT_EXPLANATION))


def prompt(sentence: Column, risk_type: Column, severity: Column) -> Column:
    """STRUCT<system, user> for an external answer batch."""
    user = F.concat(
        F.lit(PROMPT_TASK + "\n\nRisk type: "), risk_type,
        F.lit("\nSeverity: "), severity,
        F.lit("\nSentence: "), sentence,
    )
    return F.struct(F.lit(PROMPT_SYSTEM).alias("system"), user.alias("user"))
