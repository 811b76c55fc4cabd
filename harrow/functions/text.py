"""Tokens and review-field normalisation as Column expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a maximal run of these characters in the text as stored; lower-casing comes after the cut, since
#: some non-ASCII letters have ASCII lower-case forms.
TOKEN_PATTERN = "[A-Za-z0-9]+"


def raw_tokens(text: Column) -> Column:
    """Tokens in their order, case as stored; null text gives null."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN_PATTERN})"), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased tokens in their order; null text gives null, a text without tokens an empty array."""
    return F.transform(raw_tokens(text), F.lower)


def product_key(product_id: Column) -> Column:
    """Product ids compare trimmed and upper-cased; null and blank are no product (null)."""
    key = F.upper(F.trim(product_id))
    return F.when(key != "", key)


def strict_int(text: Column) -> Column:
    """An optional sign and digits, nothing else; anything else, or more than an int holds, is null."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def helpfulness(text: Column) -> Column:
    """struct(num, den) of 'a/b'.

    Parts that are no integers keep the defaults 0 and 1 (a bad first part discards the second one too). Then, in this
    order: a numerator above the denominator is swapped with it, a negative numerator becomes 0, a negative
    denominator becomes the numerator. Null text counts as ''.
    """
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), "/")
    first = strict_int(F.get(parts, F.lit(0)))
    second = strict_int(F.get(parts, F.lit(1)))
    return ordered_votes(F.coalesce(first, F.lit(0)), F.when(first.isNotNull(), F.coalesce(second, F.lit(1))).otherwise(1))


def ordered_votes(num: Column, den: Column) -> Column:
    """The last three rules of helpfulness() for numbers; null counts as 0 and 1."""
    num, den = F.coalesce(num, F.lit(0)), F.coalesce(den, F.lit(1))
    low = F.greatest(F.least(num, den), F.lit(0))
    high = F.greatest(num, den)
    return F.struct(low.cast("int").alias("num"), F.when(high < 0, low).otherwise(high).cast("int").alias("den"))


def score(text: Column) -> Column:
    """Whole part of a number from 1 to 5; 1 for anything else, null and NaN included."""
    value = F.trim(text).try_cast("double")
    return F.when((value >= 1) & (value < 6), F.floor(value).cast("int")).otherwise(1)


def helpfulness_weight(num: Column, den: Column) -> Column:
    """num / den, one half where den is 0."""
    return F.when(den == 0, F.lit(0.5)).otherwise(num.cast("double") / den)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two strings share from the start; 0 where either is null."""
    upto = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), upto), lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))
    return F.when(upto > 0, F.size(same)).otherwise(0)
