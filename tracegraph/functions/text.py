"""Text column functions; all stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entropy(text) -> Column:
    """Shannon entropy (bits per character) of a string."""
    s = _col(text)
    n = F.length(s)
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    bits = F.aggregate(
        chars,
        F.lit(0.0),
        lambda acc, c: acc - ((n - F.length(F.replace(s, c, F.lit("")))) / n)
        * F.log2((n - F.length(F.replace(s, c, F.lit("")))) / n),
    )
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(bits)


def count_char(text, ch: str) -> Column:
    s = _col(text)
    return (F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))) / F.lit(len(ch)).cast("int")


def count_digits(text) -> Column:
    return F.length(F.regexp_replace(_col(text), r"[^0-9]", ""))


def any_word(text, words: Sequence[str]) -> Column:
    """True when one of the words occurs anywhere in the text."""
    return _col(text).rlike("|".join(re.escape(w).replace("\\-", "-").replace("\\ ", " ") for w in words))


def word_hits(text, words: Sequence[str]) -> Column:
    """How many of the words occur in the text, each counted once."""
    s = _col(text)
    hit = [F.contains(s, F.lit(w)).cast("int") for w in words]
    total = hit[0]
    for h in hit[1:]:
        total = total + h
    return total


def ends_with_any(text, suffixes: Sequence[str]) -> Column:
    return _col(text).rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")


def first_pattern(text, patterns: Sequence[str]) -> Column:
    """Index (from 0) of the first pattern found in the text, -1 when none is."""
    s = _col(text)
    expr = None
    for i, p in enumerate(patterns):
        cond = s.rlike("(?iu)" + p)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(-1))


def any_pattern(text, patterns: Sequence[str]) -> Column:
    return _col(text).rlike("(?iu)(?:" + "|".join(patterns) + ")")


def short_md5(text, n: int = 12) -> Column:
    return F.substring(F.md5(_col(text)), 1, n)


def clean_number(c) -> Column:
    """NaN, infinities and nulls become 0."""
    if isinstance(c, str):
        return F.expr(f"CASE WHEN abs(`{c}`) < double('Infinity') THEN double(`{c}`) ELSE 0.0D END")
    v = c.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def div(num, den) -> Column:
    """Double division, 0 where the denominator is 0."""
    n, d = _col(num).cast("double"), _col(den).cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row explode.

    Later filters and projections then refer to the finished values; without it
    the optimizer copies the long expressions into every place that uses them.
    """
    row = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
