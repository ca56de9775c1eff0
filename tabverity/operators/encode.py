"""Encoders: mappings are small tables, encoding is a join with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio, word, word_length
from . import prefix
from .profile import exact_quantiles


def label_codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """Rows (value, code): values by first appearance in ``order``; null has the code after the last."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("at"))
    return prefix.numbered(first, [F.col("at"), F.col("value")], "code")[0].select("value", "code")


def encode_labels(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``column`` replaced by codes; nulls get the number of levels, values without a code stay null."""
    known = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    n = codes.agg(F.count("*").alias("_n"))
    joined = df.join(known, F.col(column) == F.col("_value"), "left").crossJoin(F.broadcast(n))
    return joined.withColumn(column, F.when(F.col(column).isNull(), F.col("_n")).otherwise(F.col("_code"))).select(*df.columns)


def extend_codes(codes: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Codes with those of values that ``df`` has besides, from the largest (the null code too) on, in order of value."""
    top = codes.count()
    new = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().join(codes, "value", "left_anti")
    more = prefix.numbered(new, [F.col("value")], "r")[0].select("value", (F.col("r") + (top + 1)).alias("code"))
    return codes.unionByName(more)


def decode_labels(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    known = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return df.join(known, F.col(column) == F.col("_code"), "left").withColumn(column, F.col("_value")).select(*df.columns)


def word_codes(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, word): distinct words of A-Z, of the least length that has one to spare."""
    values = df.select(F.col(column).alias("value")).distinct()
    ranked, n = prefix.numbered(values, [F.col("value")], "r")
    return ranked.select("value", word(F.col("r"), word_length(F.lit(n))).alias("word"))


def uniform_intervals(df: DataFrame, column: str, null_as: str = "NaN_Category") -> DataFrame:
    """Rows (value, frequency, lo, hi): a partition of 0..1 by frequency, values in order, the last edge exactly 1."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(null_as))
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    sums, totals = prefix.running(counts, [F.col("value")], {"upto": F.col("n")})
    every = F.lit(totals["upto"])
    return sums.select("value", ratio(F.col("n"), every).alias("frequency"), ratio(F.col("upto") - F.col("n"), every).alias("lo"), ratio(F.col("upto"), every).alias("hi"))


def uniform_encode(df: DataFrame, column: str, intervals: DataFrame, draw: Column) -> DataFrame:
    """``column`` replaced by a point of its interval; ``draw`` is in 0..1, for example F.rand(seed)."""
    known = intervals.select(F.col("value").alias("_value"), "lo", "hi")
    joined = df.withColumn("_draw", draw).join(known, F.coalesce(F.col(column).cast("string"), F.lit("NaN_Category")) == F.col("_value"), "left")
    return joined.withColumn(column, F.col("lo") + F.col("_draw") * (F.col("hi") - F.col("lo"))).select(*df.columns)


def uniform_decode(df: DataFrame, column: str, intervals: DataFrame) -> DataFrame:
    """Points back to values: intervals are closed at the right, the first one at the left too; beyond 0..1 is clipped."""
    known = intervals.select(F.col("value").alias("_value"), "lo", "hi")
    found = prefix.in_interval(df, F.col(column), known, ["_value"], intervals.count())
    return found.withColumn(column, F.col("_value")).select(*df.columns)


def _with_stats(df: DataFrame, column: str, *stats: Column) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*stats)))  # one row


def minmax_scale(df: DataFrame, column: str) -> DataFrame:
    """0..1 by the range; a constant column is 0."""
    joined = _with_stats(df, column, F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    scaled = F.when(F.col(column).isNotNull(), F.coalesce(ratio(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)))
    return joined.withColumn(column, scaled).select(*df.columns)


def standard_scale(df: DataFrame, column: str) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column is 0."""
    joined = _with_stats(df, column, F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd"))
    scaled = F.when(F.col(column).isNotNull(), F.coalesce(ratio(F.col(column) - F.col("_mean"), F.col("_sd")), F.lit(0.0)))
    return joined.withColumn(column, scaled).select(*df.columns)


def quantile_scale(df: DataFrame, column: str, quantiles: int = 10) -> DataFrame:
    """Place between exact quantiles, linear in between: 0 at the minimum, 1 at the maximum."""
    points = exact_quantiles(df, [column], [k / quantiles for k in range(quantiles + 1)])[column] or [0.0] * (quantiles + 1)
    x = F.col(column)
    step = lambda k: F.when(x >= points[k + 1], 1.0).when(x <= points[k], 0.0).otherwise(ratio(x - points[k], F.lit(points[k + 1] - points[k])))
    return df.withColumn(column, F.when(x.isNotNull(), sum((step(k) for k in range(quantiles)), F.lit(0.0)) / quantiles)).select(*df.columns)
