"""Quality rules as a short-circuit cascade, with built-in expressions only.

Each rule's cost and rejection rate are measured on a sample; the rules run in the order of
rejections per cost and a rejected text skips the rest. The order changes the work, never the
verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.words import SPACE_CLASS, WORD_CLASS, words
from pactlens.operators.hold import hold

SAMPLE_ROWS = 500
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_MEAN_LENGTH = 15


class Rule(NamedTuple):
    name: str
    needs: tuple[str, ...]      # metrics
    rejects: Callable[..., Column]


RULES = (
    Rule("short", ("n_words",), lambda n: n < MIN_WORDS),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > MAX_REPEAT_PERCENT * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 100 * s > MAX_SYMBOL_PERCENT * n),
    Rule("long_words", ("n_words", "word_chars"), lambda n, c: c > MAX_MEAN_LENGTH * n),
)


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `_w`, the words, and `_g`, the hash of each window of five words."""
    held = hold(docs, _w=words(F.col(text)))
    w = F.col("_w")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - F.lit(5)),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    return hold(held, _g=F.when(F.size(w) >= 5, windows).otherwise(F.array().cast("array<bigint>")))


def _repeat_words() -> Column:
    """Words covered by five-word windows found twice or more.

    Only a text whose windows are not all distinct is sorted: equal neighbours in the sorted
    (hash, place) list are the repeats, and each covers its words up to the next repeat.
    """
    z = F.array_sort(F.transform(F.col("_g"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(F.col("_g"))) < F.size(F.col("_g")), z)


def with_repeats(prepared: DataFrame) -> DataFrame:
    """Add n_repeat_words to rows of `with_words`."""
    held = hold(prepared, _z=_repeat_words())
    z = F.col("_z")
    places = F.array_sort(F.transform(
        F.filter(z, lambda x, k: (x["h"] == F.get(z, k - 1)["h"]) | (x["h"] == F.get(z, k + 1)["h"])),
        lambda x: x["i"]))
    held = hold(held.withColumn("_z", F.coalesce(z, F.array().cast("array<struct<h:bigint,i:int>>"))), _p=places)
    p = F.col("_p")
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("bigint"),
        lambda acc, k: acc + F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(5))))
    return held.withColumn("n_repeat_words", F.when(F.size(p) > 0, covered).otherwise(F.lit(0).cast("bigint"))).drop("_z", "_p")


def metric(name: str, text: str = "text") -> Column:
    """A metric of a row of `with_words` as BIGINT; n_repeat_words comes from `with_repeats`."""
    t = F.coalesce(F.col(text), F.lit(""))
    if name == "n_words":
        out = F.size("_w")
    elif name == "word_chars":
        out = F.length(t) - F.regexp_count(t, F.lit(SPACE_CLASS))
    elif name == "n_symbols":
        out = F.regexp_count(t, F.lit(SYMBOLS))
    elif name == "n_dup_lines":
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS))
        out = F.size(lines) - F.size(F.array_distinct(lines))
    else:
        out = F.col(name)
    return out.cast("bigint")


def _rejects(rule: Rule, text: str) -> Column:
    return rule.rejects(*[metric(m, text) for m in rule.needs])


def rank_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text",
               sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on at most `sample_rows` texts, best first.

    The sample decides the order of evaluation alone. Texts over 100,000 characters are left
    out of the timing.
    """
    sample = docs.select(text).filter(F.length(text) <= 100_000).limit(sample_rows)
    rows = docs.sparkSession.createDataFrame(sample.collect(), sample.schema).coalesce(1)
    base = with_words(rows, text)
    rated = []
    for rule in rules:
        frame = with_repeats(base) if "n_repeat_words" in rule.needs else base
        begun = time.perf_counter()
        hits = frame.agg(F.count_if(_rejects(rule, text))).first()[0]
        cost = time.perf_counter() - begun
        rated.append((-(hits + 0.5) / cost, rule.name, rule))
    return [r for _, _, r in sorted(rated, key=lambda x: x[:2])]


def failed_rule(order: list[Rule], text: str = "text") -> Column:
    """First rule that rejects the row, else NULL; CASE stops at the first hit."""
    chain = None
    for rule in order:
        hit = _rejects(rule, text)
        chain = F.when(hit, F.lit(rule.name)) if chain is None else chain.when(hit, F.lit(rule.name))
    return chain


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text",
                   order: list[Rule] | None = None) -> DataFrame:
    """The rows no rule rejects, with their own columns.

    Cheap rules are settled before the windows are built, as the order has it: rules ranked
    before the repeats filter first, on the words alone. NULL and empty texts have no words and
    are rejected as short; repeated rows are judged alike; an empty table stays empty. Names
    that begin with `_` or equal a metric are reserved.
    """
    order = order or rank_rules(docs, rules, text)
    cut = next((i for i, r in enumerate(order) if "n_repeat_words" in r.needs), len(order))
    early, late = order[:cut], order[cut:]
    rows = hold(docs, _w=words(F.col(text)))
    if early:
        rows = rows.filter(failed_rule(early, text).isNull())
    rows = rows.drop("_w")
    if late:
        rows = with_repeats(with_words(rows, text)).filter(failed_rule(late, text).isNull())
    return rows.select(*docs.columns)


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Metrics and verdict of every row: key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    The verdict is the cascade's: after the base rules the others run by their rank.
    A NULL text counts as empty and fails; a NULL key is passed on; no row is lost or merged.
    """
    source = docs.select(key, text)
    order = rank_rules(source, RULES, text)
    rows = with_repeats(with_words(source, text))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    rows = hold(rows.drop("_g"), **{m: metric(m, text) for m in names}).drop("_w")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    chain = None
    for rule in order:
        hit = rule.rejects(*[F.col(m) for m in rule.needs])
        chain = F.when(hit, False) if chain is None else chain.when(hit, False)
    return rows.select(key, *names, "n_repeat_words", base.alias("base_failed"),
                       (~base & chain.otherwise(True)).alias("kept"))
