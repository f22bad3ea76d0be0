"""Cleaning, sentence segmentation, tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip()/split() treat as whitespace.
WHITESPACE = r"(?U:[\s\x1c-\x1f])"
WHITESPACE_CHARS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# The characters Python's \w matches.
WORD = r"[\p{L}\p{N}_]"

# A whitespace run that is not already one plain space.
UNTIDY_SPACE = rf"{WHITESPACE}{{2,}}|(?! ){WHITESPACE}"
SENTENCE_BREAK = rf"(?<=[.!?]){WHITESPACE}+"
OMITTED = "<omitted>"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends; NULL becomes ''."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE_CHARS))


def blank(text: Column) -> Column:
    """Whether `strip` leaves nothing, seen from the first other character on."""
    return F.ltrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE_CHARS)) == ""


def clean(text: Column) -> Column:
    """Strip, then collapse inner whitespace runs to one space."""
    return F.regexp_replace(strip(text), UNTIDY_SPACE, " ")


def clean_clause(text: Column) -> Column:
    """`clean` after turning the omission marker into a space."""
    return clean(F.replace(F.coalesce(text, F.lit("")), F.lit(OMITTED), F.lit(" ")))


def sentences(text: Column) -> Column:
    """ARRAY<STRING> of the non-blank sentences of a text, in order.

    A break swallows its whole whitespace run, so once the text itself is stripped
    no piece has space at its ends and only an all-blank text gives a blank piece.
    """
    return F.filter(F.split(strip(text), SENTENCE_BREAK), lambda s: s != "")


def has_word(lowered: Column, word: str) -> Column:
    """Whole-word test; the cheap substring test guards the regular expression.

    The pattern starts with the literal, so the matcher skips along the text fast.
    """
    literal = _quote(word)
    pattern = f"{literal}(?!{WORD})(?<!{WORD}{literal})"
    return F.contains(lowered, F.lit(word)) & F.rlike(lowered, F.lit(pattern))


def _quote(literal: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in literal)


def tokens(text: Column) -> Column:
    """Lower-cased word tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{WORD}{{2,}}"), F.lit(0))


def ngrams(token_array: Column, n_max: int = 2) -> Column:
    """All 1..n_max-grams of a token array, unigrams first."""
    parts = [token_array]
    for n in range(2, n_max + 1):
        count = F.greatest(F.size(token_array) - F.lit(n - 1), F.lit(0))
        parts.append(F.zip_with(F.slice(parts[-1], 1, count), F.slice(token_array, n, count),
                                lambda head, last: F.concat_ws(" ", head, last)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def term_counts(terms: Column) -> Column:
    """ARRAY<STRUCT<term, tf>> of a term array, counted inside the row.

    Sorting puts equal terms side by side, so a run's length is the distance to
    the next run start: no explode and no shuffle.
    """
    runs = F.transform(F.array(F.sort_array(terms)), lambda a: F.struct(
        a.alias("a"),
        F.filter(
            F.transform(a, lambda t, i: F.when((i == 0) | (t != F.get(a, i - 1)), i)),
            lambda i: i.isNotNull(),
        ).alias("s"),
    ))
    counted = F.transform(runs, lambda r: F.transform(
        r["s"],
        lambda start, j: F.struct(
            F.get(r["a"], start).alias("term"),
            (F.coalesce(F.get(r["s"], j + 1), F.size(r["a"])) - start).cast("bigint").alias("tf"),
        ),
    ))
    return F.get(counted, 0)
