"""Profiles of columns, one aggregation for all of them."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decimals, ratio


def _long(df: DataFrame, columns: list[str], value: str, name: str = "column") -> DataFrame:
    return df.unpivot([], columns, name, value)


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    return _long(df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns)), columns, "null_rate")


#: Parts that an interval is cut into, values that are collected for a rank at most, accuracy of the sketch that gives the
#: first bounds, and cells of a table whose values are all counted at once.
PARTS, FEW, ACCURACY, SMALL = 1024, 1000, 10_000, 50_000


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float]]:
    """Exact quantiles of numeric columns, linear between two ranks, without all values of a column in one task.

    A sketch gives bounds on both sides of each quantile. Rows are counted between bounds; an interval that holds a wanted
    rank is cut into parts, of which those with a wanted rank are cut again between their least and largest value, until
    few values are left or all are equal. Null and NaN don't count; a column without values has no quantiles (an empty
    list).
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    eps = 2 / ACCURACY
    asked = sorted({min(max(s + e, 0.0), 1.0) for s in shares for e in (-eps, eps)})
    row = df.agg(F.lit(0), *(F.struct(F.count(number(c)).alias("n"), F.min(number(c)).alias("lo"), F.max(number(c)).alias("hi"), F.percentile_approx(number(c), asked, ACCURACY).alias("q")).alias(c) for c in columns)).first()
    full = [c for c in columns if row[c]["n"]]
    if not full:
        return {c: [] for c in columns}
    wanted = {c: sorted({k for s in shares for k in (int(s * (row[c]["n"] - 1)), min(int(s * (row[c]["n"] - 1)) + 1, row[c]["n"] - 1))}) for c in full}
    long = df.select(*(number(c).alias(c) for c in full)).unpivot([], full, "column", "x").where("x is not null")
    at_rank: dict[tuple[str, int], float] = {}
    #: (column, least, largest) of open intervals: ranks within them
    open_: dict[tuple[str, float, float], dict[int, int]] = {}

    def settle(column: str, groups: list[tuple[float, float, int]], ranks: dict[int, int]) -> None:
        """Ranks go to the group that holds them; groups of one value are done."""
        ends = [*accumulate(n for _, _, n in groups)]
        for rank, local in ranks.items():
            low, high, n = groups[bisect_left(ends, local + 1)]
            if low == high:
                at_rank[column, rank] = low
            else:
                open_.setdefault((column, low, high), {"n": n})[rank] = local - (ends[bisect_left(ends, local + 1)] - n)

    if sum(row[c]["n"] for c in full) <= SMALL:
        cuts = None
        counts = long.groupBy("column", F.col("x").alias("low"), F.col("x").alias("high")).agg(F.count("*").alias("n"))
    else:
        cuts = F.create_map(*(x for c in full for x in (F.lit(c), F.array(*map(F.lit, sorted({row[c]["lo"], *row[c]["q"]}))))))[F.col("column")]
        placed = long.withColumn("at", F.size(F.filter(cuts, lambda cut: cut <= F.col("x"))))
        counts = placed.groupBy("column", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    groups: dict[str, list[tuple]] = {}
    for r in counts.collect():  # a row for each interval, or each value of a small table
        groups.setdefault(r["column"], []).append((r["low"], r["high"], r["n"]))
    for c in full:
        settle(c, sorted(groups[c]), {r: r for r in wanted[c]})
    while open_:
        now, open_ = open_, {}
        by_column: dict[str, list[tuple]] = {}
        for c, low, high in sorted(now):
            by_column.setdefault(c, []).append((low, high, now[c, low, high]["n"] <= FEW))
        held = F.create_map(*(x for c, v in by_column.items() for x in (F.lit(c), F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(few).alias("few")) for a, b, few in v)))))[F.col("column")]
        inside = long.withColumn("of", F.get(F.filter(held, lambda i: (i["low"] <= F.col("x")) & (F.col("x") <= i["high"])), F.lit(0))).where("of is not null")
        # halves first: the width of the largest doubles has no double
        part = F.least(F.floor((F.col("x") / 2 - F.col("of.low") / 2) / (F.col("of.high") / 2 - F.col("of.low") / 2) * PARTS), F.lit(PARTS - 1))
        key = F.when(F.col("of.few"), F.col("x")).otherwise(part.cast("double"))
        counts = inside.groupBy("column", F.col("of.low").alias("of_low"), F.col("of.high").alias("of_high"), key.alias("key")).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
        found: dict[tuple, list[tuple]] = {}
        for r in counts.collect():  # PARTS or FEW rows for an interval
            found.setdefault((r["column"], r["of_low"], r["of_high"]), []).append((r["low"], r["high"], r["n"]))
        for (c, low, high), ranks in now.items():
            settle(c, sorted(found[c, low, high]), {k: v for k, v in ranks.items() if k != "n"})

    def between(c: str, s: float) -> float:
        place = s * (row[c]["n"] - 1)
        k = int(place)
        a, b = at_rank[c, k], at_rank[c, min(k + 1, row[c]["n"] - 1)]
        return a + (place - k) * (b - a)

    return {c: [between(c, s) for s in shares] if c in full else [] for c in columns}


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, low, high, median) of numeric columns."""
    medians = exact_quantiles(df, columns, [0.5])
    middle = lambda c: F.lit(medians[c][0] if medians[c] else None).cast("double")
    stats = df.agg(*(F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), middle(c).alias("median")).alias(c) for c in columns))
    return _long(stats, columns, "s").select("column", "s.low", "s.high", "s.median")


def fill_values(df: DataFrame, numeric: list[str], other: list[str]) -> dict[str, object]:
    """Median of numeric columns, mode (ties: the smallest) of the others."""
    medians = exact_quantiles(df, numeric, [0.5]) if numeric else {}
    return {c: q[0] if q else None for c, q in medians.items()} | {c: _mode(df, c) for c in other}


def _mode(df: DataFrame, column: str) -> object:
    """The most frequent value; counted by value before the largest count is taken."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    top = counts.agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("mode")).first()
    return top["mode"]


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Nulls replaced by values that were learned, on this or another table."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def decimal_places(df: DataFrame, columns: list[str]) -> DataFrame:
    return _long(df.agg(*(F.max(decimals(F.col(c))).cast("long").alias(c) for c in columns)), columns, "places")


def continuous(df: DataFrame, columns: list[str]) -> DataFrame:
    """A column is continuous if any value that reads as a number isn't whole."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    return _long(df.agg(*(F.coalesce(F.bool_or(F.when(~F.isnan(number(c)), number(c) % 1 != 0)), F.lit(False)).alias(c) for c in columns)), columns, "is_continuous")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, n, frequency); null is a value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", ratio(F.col("n"), F.col("total")).alias("frequency"))  # total: one row


def class_quota(df: DataFrame, label: str, rows: int) -> DataFrame:
    """Rows to generate for each class so that shares stay as they are."""
    return frequencies(df, label).select(F.col("value").alias("class"), "n", F.round(F.col("frequency") * rows).cast("long").alias("num_rows"))
