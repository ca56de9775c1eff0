"""Fidelity: shapes of columns, trends of pairs, validity, structure, and new rows."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import equal_width_bin, ratio

#: Parts of a column's range by which a cumulative distribution is summed up.
PARTS = 4096


def tagged(real: DataFrame, synthetic: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """Rows (column, value, is_real) of both tables, values cast to one type: one pass for all columns."""

    def long(df: DataFrame, is_real: bool) -> DataFrame:
        return df.select(*(F.col(c).cast(kind).alias(c) for c in columns)).unpivot([], columns, "column", "value").withColumn("is_real", F.lit(is_real))

    return long(real, True).unionByName(long(synthetic, False))


def ks_complement(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, score): 1 - the largest distance of the two distribution functions; nulls don't count.

    Counts by distinct value are summed up within parts of each column's range and over the parts, so that no task
    sorts a whole column.
    """
    values = tagged(real, synthetic, columns, "double").where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = values.groupBy("column", "value").agg(F.count_if("is_real").alias("p"), F.count_if(~F.col("is_real")).alias("q"))
    range_ = values.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if("is_real").alias("n_p"), F.count_if(~F.col("is_real")).alias("n_q"))
    placed = counts.join(F.broadcast(range_), "column").withColumn("part", equal_width_bin(F.col("value"), F.col("low"), F.col("high"), PARTS))  # one row a column
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("column", "part").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    parts = parts.select("column", "part", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("sq").over(before), F.lit(0)).alias("bq"))
    within = Window.partitionBy("column", "part").orderBy("value")
    summed = placed.join(parts, ["column", "part"]).withColumn("gap", F.abs(ratio(F.col("bp") + F.sum("p").over(within), F.col("n_p")) - ratio(F.col("bq") + F.sum("q").over(within), F.col("n_q"))))
    return summed.groupBy("column").agg((1 - F.max("gap")).alias("score"))


def tv_complement(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, score): 1 - half the sum of the distances of frequencies; null is a category."""
    return _tv(tagged(real, synthetic, columns, "string"), ["column"], ["value"])


def _tv(values: DataFrame, by: list[str], cells: list[str]) -> DataFrame:
    counts = values.groupBy(*by, *cells).agg(F.count_if("is_real").alias("p"), F.count_if(~F.col("is_real")).alias("q"))
    totals = counts.groupBy(*by).agg(F.sum("p").alias("n_p"), F.sum("q").alias("n_q"))
    joined = counts.join(F.broadcast(totals), by)  # one row a column or pair
    return joined.groupBy(*by).agg((1 - 0.5 * F.sum(F.abs(ratio(F.col("p"), F.col("n_p")) - ratio(F.col("q"), F.col("n_q"))))).alias("score"))


def column_shapes(real: DataFrame, synthetic: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    parts = ([ks_complement(real, synthetic, numeric)] if numeric else []) + ([tv_complement(real, synthetic, categorical)] if categorical else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def correlation_similarity(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, score): 1 - half the distance of the correlations; null if one has none."""
    pairs = list(combinations(columns, 2))

    def corr(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
        return one.unpivot([], [f"r{k}" for k in range(len(pairs))], "pair", name)

    names = F.create_map(*(F.lit(x) for k, (a, b) in enumerate(pairs) for x in (f"r{k}", f"{a}|{b}")))
    both = corr(real, "p").join(corr(synthetic, "q"), "pair").withColumn("names", F.split(names[F.col("pair")], r"\|"))
    return both.select(F.col("names")[0].alias("a"), F.col("names")[1].alias("b"), (1 - F.abs(F.col("p") - F.col("q")) / 2).alias("score"))


def binned(real: DataFrame, df: DataFrame, numeric: list[str], bins: int = 10) -> DataFrame:
    """Numeric columns of ``df`` as the equal-width bins of ``real``'s ranges."""
    if not numeric:
        return df
    limits = real.agg(*(x for c in numeric for x in (F.min(c).cast("double").alias(f"_lo_{c}"), F.max(c).cast("double").alias(f"_hi_{c}"))))
    joined = df.crossJoin(F.broadcast(limits))  # one row
    return joined.withColumns({c: equal_width_bin(F.col(c).cast("double"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), bins) for c in numeric}).select(*df.columns)


def pair_cells(real: DataFrame, synthetic: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows (a, b, x, y, is_real) for all pairs of columns, in one pass."""

    def long(df: DataFrame, is_real: bool) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs))
        return df.select(F.inline(cells)).withColumn("is_real", F.lit(is_real))

    return long(real, True).unionByName(long(synthetic, False))


def contingency_similarity(real: DataFrame, synthetic: DataFrame, pairs: list[tuple[str, str]], numeric: list[str] | None = None) -> DataFrame:
    """Rows (a, b, score): 1 - half the sum of the distances of joint frequencies, numeric columns in bins."""
    numeric = [c for c in numeric or [] if any(c in p for p in pairs)]
    return _tv(pair_cells(binned(real, real, numeric), binned(real, synthetic, numeric), pairs), ["a", "b"], ["x", "y"])


def pair_trends(real: DataFrame, synthetic: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    mixed = [p for p in combinations([*numeric, *categorical], 2) if not (p[0] in numeric and p[1] in numeric)]
    parts = ([correlation_similarity(real, synthetic, numeric)] if len(numeric) > 1 else []) + ([contingency_similarity(real, synthetic, mixed, numeric)] if mixed else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def overall_quality(real: DataFrame, synthetic: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    shapes = column_shapes(real, synthetic, numeric, categorical).agg(F.avg("score").alias("score")).withColumn("metric", F.lit("Column Shapes"))
    trends = pair_trends(real, synthetic, numeric, categorical).agg(F.avg("score").alias("score")).withColumn("metric", F.lit("Column Pair Trends"))
    both = shapes.unionByName(trends)
    return both.unionByName(both.agg(F.avg("score").alias("score")).withColumn("metric", F.lit("Overall Quality"))).select("metric", "score")


def boundary_adherence(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, score): share of synthetic values within the real range."""
    limits = real.agg(*(x for c in columns for x in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))))
    inside = synthetic.crossJoin(F.broadcast(limits)).agg(*(F.avg(F.col(c).between(F.col(f"_lo_{c}"), F.col(f"_hi_{c}")).cast("int")).alias(c) for c in columns))  # one row
    return inside.unpivot([], columns, "column", "score")


def category_adherence(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, score): share of synthetic values that the real column has."""
    counts = tagged(real, synthetic, columns, "string").groupBy("column", "value").agg(F.count_if("is_real").alias("p"), F.count_if(~F.col("is_real")).alias("q"))
    return counts.groupBy("column").agg(ratio(F.sum(F.when(F.col("p") > 0, F.col("q")).otherwise(0)), F.sum("q")).alias("score"))


def key_uniqueness(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.lit(column).alias("column"), F.count_distinct(column).alias("d"), F.count(column).alias("n")).select("column", ratio(F.col("d"), F.col("n")).alias("score"))


def data_validity(real: DataFrame, synthetic: DataFrame, numeric: list[str], categorical: list[str], key: str | None = None) -> DataFrame:
    parts = boundary_adherence(real, synthetic, numeric).unionByName(category_adherence(real, synthetic, categorical))
    return parts.unionByName(key_uniqueness(synthetic, key)) if key else parts


def data_structure(real: DataFrame, synthetic: DataFrame) -> float:
    """Shared share of (column, type)."""
    a, b = set(real.dtypes), set(synthetic.dtypes)
    return len(a & b) / len(a | b) if a | b else 1.0


def _close(x: Column, y: Column, tolerance: float) -> Column:
    return F.abs(x - y) <= F.abs(x) * tolerance


def _new_row_match(categorical: list[str], numeric: list[str], tolerance: float) -> Column:
    same = F.lit(True)
    for c in categorical:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}"))
    for c in numeric:
        same = same & (_close(F.col(f"s.{c}"), F.col(f"r.{c}"), tolerance) | (F.col(f"s.{c}").isNull() & F.col(f"r.{c}").isNull()))
    return same


def _new_share(synthetic: DataFrame, new: DataFrame) -> DataFrame:
    return new.agg(F.count("*").alias("new_rows")).crossJoin(synthetic.agg(F.count("*").alias("rows"))).select("new_rows", "rows", ratio(F.col("new_rows"), F.col("rows")).alias("score"))  # two rows of counts


def new_row_synthesis(real: DataFrame, synthetic: DataFrame, categorical: list[str], numeric: list[str], tolerance: float = 0.01) -> DataFrame:
    """Share of synthetic rows without a real row of equal categories and numbers within a share of their size.

    The match is an anti join on the categories; without any, on bands of the first number.
    """
    if not categorical:
        return new_row_bands(real, synthetic, numeric, tolerance)
    new = synthetic.alias("s").join(real.dropDuplicates([*categorical, *numeric]).alias("r"), _new_row_match(categorical, numeric, tolerance), "left_anti")
    return _new_share(synthetic, new)


def _band(x: Column, width: float) -> Column:
    size = F.when(x != 0, F.floor(F.ln(F.abs(x)) / width)).otherwise(0)
    return F.struct(F.signum(x).cast("int").alias("sign"), size.cast("long").alias("band"))


def new_row_bands(real: DataFrame, synthetic: DataFrame, numeric: list[str], tolerance: float = 0.01) -> DataFrame:
    """The same for numbers only: logarithmic bands so wide that a match lies in the same band or the next.

    Real rows are filed in one band, synthetic rows look in three: an equi join, where a comparison of all would be
    quadratic. Zero only matches zero.
    """
    width = -math.log1p(-tolerance) * 1.0001
    first = F.col(numeric[0]).cast("double")
    filed = real.select(*numeric).distinct().withColumn("_band", _band(first, width))
    keyed = synthetic.withColumn("_row", F.monotonically_increasing_id())
    steps = F.when(first != 0, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    b = _band(first, width)
    look = keyed.withColumn("_step", F.explode(steps)).select("_row", *numeric, F.struct(b["sign"].alias("sign"), (b["band"] + F.col("_step")).alias("band")).alias("_band"))
    found = look.alias("s").join(filed.alias("r"), (F.col("s._band") == F.col("r._band")) & _new_row_match([], numeric, tolerance), "left_semi").select("_row").distinct()
    return found.agg(F.count("*").alias("old")).crossJoin(synthetic.agg(F.count("*").alias("rows"))).select((F.col("rows") - F.col("old")).alias("new_rows"), "rows", ratio(F.col("rows") - F.col("old"), F.col("rows")).alias("score"))  # two rows of counts
