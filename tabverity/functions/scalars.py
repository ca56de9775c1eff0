"""Scalar expressions with the null, rounding and division rules of the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def decimals(c: Column) -> Column:
    """Digits after the point of a number as text: 5.0 has 1; exponents don't count."""
    return F.length(F.regexp_replace(F.split_part(c.cast("string"), F.lit("."), F.lit(2)), "E.*$", ""))


def format_value(x: Column) -> Column:
    """Whole numbers without a point, others with 5 decimals."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(F.format_string("%.5f", x))


def format_interval(low: Column, high: Column) -> Column:
    return F.concat(F.lit("("), F.bround(low, 6).cast("string"), F.lit(", "), F.bround(high, 6).cast("string"), F.lit(")"))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(x, high), low)


def positive_zero(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0..bins-1 of the range; values beyond it go to the outer bins, a constant range has bin 0."""
    place = F.floor(F.try_divide(x - low, (high - low) / bins))
    return F.coalesce(clip(place, F.lit(0), F.lit(bins - 1)), F.when(x.isNotNull(), 0)).cast("int")


def word_length(n: Column) -> Column:
    """Letters that words over A-Z need so that n values and one more have distinct words."""
    # the smallest L with 26**L >= n + 1, by comparison: logarithms round
    return sum((F.when(n + 1 > 26**k, 1).otherwise(0) for k in range(1, 12)), F.lit(1)).cast("int")


def word(rank: Column, length: Column) -> Column:
    """Word of a rank: its digits to base 26 as letters A-Z, of the given length."""
    digits = F.transform(F.sequence(length - 1, F.lit(0), F.lit(-1)), lambda k: F.char(F.lit(65) + F.floor(rank / F.pow(F.lit(26), k)) % 26))
    return F.array_join(digits, "")
