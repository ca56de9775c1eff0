"""Divergences of joint and marginal frequencies."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .quality import binned, pair_cells, tagged

#: Added to the frequency of every cell that either table has.
SMOOTHING = 1e-5


def kl_scores(real: DataFrame, synthetic: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows (a, b, score): 1 / (1 + KL(synthetic, real)) of smoothed joint frequencies."""
    counts = pair_cells(real, synthetic, pairs).groupBy("a", "b", "x", "y").agg(F.count_if("is_real").alias("p"), F.count_if(~F.col("is_real")).alias("q"))
    totals = counts.groupBy("a", "b").agg(F.sum("p").alias("n_p"), F.sum("q").alias("n_q"), F.count("*").alias("cells"))
    joined = counts.join(F.broadcast(totals), ["a", "b"])  # one row a pair
    whole = 1 + F.col("cells") * SMOOTHING
    p, q = (ratio(F.col("p"), F.col("n_p")) + SMOOTHING) / whole, (ratio(F.col("q"), F.col("n_q")) + SMOOTHING) / whole
    return joined.groupBy("a", "b").agg((1 / (1 + F.sum(q * F.ln(q / p)))).alias("score"))


def discrete_kl(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    return kl_scores(real, synthetic, list(combinations(columns, 2)))


def continuous_kl(real: DataFrame, synthetic: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    return kl_scores(binned(real, real, columns, bins), binned(real, synthetic, columns, bins), list(combinations(columns, 2)))


def chi_square(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, statistic, freedom): the sum of (q - p)^2 / p on shares over the real levels."""
    counts = tagged(real, synthetic, columns, "string").groupBy("column", "value").agg(F.count_if("is_real").alias("p"), F.count_if(~F.col("is_real")).alias("q"))
    totals = counts.groupBy("column").agg(F.sum("p").alias("n_p"), F.sum("q").alias("n_q"))
    joined = counts.join(F.broadcast(totals), "column").where("p > 0")  # one row a column
    p, q = ratio(F.col("p"), F.col("n_p")), ratio(F.col("q"), F.col("n_q"))
    return joined.groupBy("column").agg(F.sum(ratio((q - p) * (q - p), p)).alias("statistic"), (F.count("*") - 1).alias("freedom"))


def chi_square_tail(statistic: float, freedom: int, steps: int = 500) -> float:
    """P(X > statistic) of the chi-square distribution: the regularised upper incomplete gamma function.

    By its series below the mean and by its continued fraction above.
    """
    a, x = freedom / 2, statistic / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, steps):
            term *= x / (a + k)
            total += term
        return max(0.0, 1 - front * total)
    fraction = 0.0
    for k in range(steps, 0, -1):
        fraction = k * (k - a) / (x + 2 * k + 1 - a - fraction)
    return front / (x + 1 - a - fraction)


def chi_square_p(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, p_value); a column of one level has 1."""
    found = chi_square(real, synthetic, columns).collect()  # one row a column
    rows = [(r["column"], chi_square_tail(r["statistic"], r["freedom"]) if r["freedom"] else 1.0) for r in found]
    return real.sparkSession.createDataFrame(rows, "column string, p_value double")
