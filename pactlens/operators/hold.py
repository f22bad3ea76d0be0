"""Keep expensive expressions from being evaluated again by later filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    The optimizer moves a filter below a projection by copying the projected
    expressions into it, so a filter on a value built from `lower(sentence)` would
    lower the sentence once per keyword and then again for the output. A filter
    cannot move below the generator that makes its input, and generated columns are
    never copied, so a one-element `inline` fixes the values at this point. It stays
    a narrow, code-generated step.
    """
    fixed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(fixed))
