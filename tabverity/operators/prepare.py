"""Fitted transforms of whole tables: fit once, transform any table, and go back.

What a fit learns is small (a row for each level, one row of numbers), so that transforms are joins and expressions.
Draws are columns that the caller may give, for example by the hash of a key; by default they are random with a seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from ..functions import draws
from ..functions.scalars import positive_zero, ratio
from ..sources.tables import load_mapping, nan_as_null, require_complete, save_mapping
from . import encode, prefix, profile, split

#: The level that stands for null in encoders by frequency.
NULL_LEVEL = "NaN_Category"
#: Ranks that normal scores are cut at.
CUT = 1e-7
Draw = Callable[[str], Column]


def random_draw(seed: int) -> Draw:
    return lambda column: F.rand(seed + sum(column.encode()))


def to_type(value: Column, kind: T.DataType) -> Column:
    """Values back in a column's type; whole numbers are rounded half to even first, what can't be cast is null."""
    if isinstance(kind, T.IntegralType):
        return F.rint(value.try_cast("double")).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.rint(value.try_cast("double")).cast("int").cast("boolean"), value.cast("string").try_cast("boolean"))
    return value.cast("string").try_cast(kind) if not isinstance(kind, T.StringType) else value.cast("string")


def keep_types_or_as_is(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in the types of ``schema`` where every value can be cast; others stay as they are."""
    wanted = {f.name: f.dataType for f in schema if f.name in df.columns and df.schema[f.name].dataType != f.dataType}
    if not wanted:
        return df
    lost = df.agg(*(F.count_if(F.col(c).isNotNull() & to_type(F.col(c), k).isNull()).alias(c) for c, k in wanted.items())).first()
    return df.withColumns({c: to_type(F.col(c), k) for c, k in wanted.items() if not lost[c]})


@dataclass
class LabelCodec:
    """Codes of values by first appearance in ``order``, column by column; null has the code after the last."""

    columns: list[str]
    order: str
    codes: dict[str, DataFrame] = field(default_factory=dict)
    types: dict[str, T.DataType] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> LabelCodec:
        self.types = {c: df.schema[c].dataType for c in self.columns}
        self.codes = {c: encode.label_codes(df.withColumn(c, F.col(c).cast("string")), c, self.order) for c in self.columns}
        return self

    def extend(self, df: DataFrame) -> LabelCodec:
        """Codes for the values that another table has besides."""
        self.codes = {c: encode.extend_codes(codes, df.withColumn(c, F.col(c).cast("string")), c) for c, codes in self.codes.items()}
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        for c, codes in self.codes.items():
            df = encode.encode_labels(df.withColumn(c, F.col(c).cast("string")), c, codes)
        return df

    def decode(self, df: DataFrame) -> DataFrame:
        for c, codes in self.codes.items():
            df = encode.decode_labels(df.withColumn(c, F.rint(F.col(c).cast("double")).cast("long")), c, codes)
            df = df.withColumn(c, F.col(c).cast(self.types[c]) if c in self.types else F.col(c))
        return df

    def mapping(self) -> DataFrame:
        """Rows (column, value, code) of all columns."""
        parts = [codes.select(F.lit(c).alias("column"), "value", "code") for c, codes in self.codes.items()]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every

    def save(self, path: str) -> None:
        save_mapping(self.mapping(), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, order: str = "") -> LabelCodec:
        rows = load_mapping(spark, path)
        columns = [r["column"] for r in rows.select("column").distinct().orderBy("column").collect()]  # one a column
        return cls(columns, order, {c: rows.where(F.col("column") == c).select("value", "code") for c in columns})


@dataclass
class WordCodec:
    """A word of A-Z for each distinct value of every column but the label; null has one too."""

    label: str | None = None
    words: dict[str, DataFrame] = field(default_factory=dict)
    types: dict[str, T.DataType] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> WordCodec:
        columns = [c for c in df.columns if c != self.label]
        self.types = {c: df.schema[c].dataType for c in columns}
        self.words = {c: encode.word_codes(df.withColumn(c, F.col(c).cast("string")), c) for c in columns}
        return self

    def _swap(self, df: DataFrame, source: str, target: str) -> DataFrame:
        for c, words in self.words.items():
            known = words.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
            df = df.join(known, F.col(c).cast("string").eqNullSafe(F.col("_from")), "left").withColumn(c, F.col("_to")).drop("_from", "_to")
        return df

    def encode(self, df: DataFrame) -> DataFrame:
        return self._swap(df, "value", "word").select(*df.columns)

    def decode(self, df: DataFrame) -> DataFrame:
        return self._swap(df, "word", "value").select(*(F.col(c).cast(self.types[c]).alias(c) if c in self.types else F.col(c) for c in df.columns))


def _ordered_levels(df: DataFrame, column: str, ordinal: bool) -> DataFrame:
    """Rows (value, frequency, lo, hi, number) of one column; numbers in their own order, other values by text, null last."""
    numeric = ordinal and isinstance(df.schema[column].dataType, T.NumericType)
    place = F.col(column).cast("double") if numeric else F.lit(0.0)
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(NULL_LEVEL)).alias("value"), F.col(column).isNull().alias("_null"), place.alias("_at")).agg(F.count("*").alias("n"))
    sums, totals = prefix.running(counts, [F.col("_null"), F.col("_at"), F.col("value")], {"upto": F.col("n"), "number": F.lit(1)})
    every = F.lit(totals["upto"])
    return sums.select("value", ratio(F.col("n"), every).alias("frequency"), ratio(F.col("upto") - F.col("n"), every).alias("lo"), ratio(F.col("upto"), every).alias("hi"), (F.col("number") - 1).alias("number"))


def null_neighbours(levels: DataFrame) -> DataFrame:
    """One row (lower, upper): the levels that stand in for null, by frequency.

    Two levels as frequent as null are the two, in order of value; one is the upper one; else the nearest less frequent
    and the nearest more frequent level are taken. Null where there is none.
    """
    null = levels.where(F.col("value") == NULL_LEVEL).select(F.col("frequency").alias("_f"))
    known = levels.where(F.col("value") != NULL_LEVEL).crossJoin(F.broadcast(null))  # one row
    f, own = F.col("frequency"), F.col("_f")
    same = F.sort_array(F.collect_list(F.when(f == own, F.col("value"))))  # levels of one frequency
    below = F.max_by("value", F.when(f < own, F.struct("frequency", "value")))
    above = F.min_by("value", F.when(f > own, F.struct("frequency", "value")))
    found = known.agg(same.alias("same"), below.alias("below"), above.alias("above"))
    two, one = F.size("same") > 1, F.size("same") == 1
    lower = F.when(two, F.get("same", F.lit(0))).otherwise(F.col("below"))
    upper = F.when(two, F.get("same", F.lit(1))).when(one, F.get("same", F.lit(0))).otherwise(F.col("above"))
    return found.select(lower.alias("lower"), upper.alias("upper"))


@dataclass
class UniformCodec:
    """Values as random points of an interval as wide as their frequency, and back."""

    columns: list[str]
    ordinal: bool = True
    levels: dict[str, DataFrame] = field(default_factory=dict)
    types: dict[str, T.DataType] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> UniformCodec:
        self.types = {c: df.schema[c].dataType for c in self.columns}
        self.levels = {c: _ordered_levels(nan_as_null(df), c, self.ordinal).persist() for c in self.columns}
        return self

    def frequencies(self, column: str) -> DataFrame:
        return self.levels[column].select("value", "frequency")

    def intervals(self, column: str) -> DataFrame:
        return self.levels[column].select("value", "lo", "hi")

    def unseen(self, df: DataFrame) -> DataFrame:
        """Rows (column, value) of levels that the fit hasn't seen."""
        parts = [df.select(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(NULL_LEVEL)).alias("value")).distinct().join(levels.select("value"), "value", "left_anti").select("column", "value") for c, levels in self.levels.items()]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every

    def transform(self, df: DataFrame, draw: Draw | None = None, choose: Draw | None = None) -> DataFrame:
        """Points of the values' intervals; an unseen value has the interval of a random level, each level as likely."""
        draw, choose = draw or random_draw(1), choose or random_draw(1001)
        for c, levels in self.levels.items():
            known = levels.select(F.col("value").alias("_value"), "lo", "hi")
            n = levels.count()
            other = levels.select(F.col("number").alias("_number"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
            value = F.coalesce(F.col(c).cast("string"), F.lit(NULL_LEVEL))
            joined = df.withColumns({"_draw": draw(c), "_choose": choose(c)}).join(known, value == F.col("_value"), "left")
            # rows of known values ask for numbers that no level has, each for another one
            asked = F.when(F.col("lo").isNull(), F.least(F.floor(F.col("_choose") * n), F.lit(n - 1))).otherwise(-1 - F.floor(F.col("_draw") * 1000))
            joined = joined.withColumn("_asked", asked.cast("long")).join(other, F.col("_asked") == F.col("_number"), "left")
            lo, hi = F.coalesce("lo", "_lo"), F.coalesce("hi", "_hi")
            df = joined.withColumn(c, lo + F.col("_draw") * (hi - lo)).select(*df.columns)
        return df

    def inverse(self, df: DataFrame, fill_nulls: bool = False) -> DataFrame:
        """Values of points, in the columns' types. With ``fill_nulls`` the null interval's lower half has the nearest
        less frequent level and its upper half the nearest more frequent one."""
        df = require_complete(df, list(self.levels))
        for c, levels in self.levels.items():
            instead = null_neighbours(levels).select(F.col("lower").alias("_lower"), F.col("upper").alias("_upper"))
            x = F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0))
            known = levels.select(F.col("value").alias("_value"), F.col("lo").alias("_from"), F.col("hi").alias("_upto"), "lo", "hi")
            found = prefix.in_interval(df, F.col(c), known, ["_value", "_from", "_upto"], levels.count()).crossJoin(F.broadcast(instead))  # one row
            is_null = F.col("_value") == NULL_LEVEL
            filled = F.when(x < (F.col("_from") + F.col("_upto")) / 2, F.col("_lower")).otherwise(F.col("_upper")) if fill_nulls else F.lit(None)
            df = found.withColumn(c, F.when(is_null, filled).otherwise(F.col("_value"))).select(*df.columns)
            df = df.withColumn(c, to_type(F.col(c), self.types[c]))
        return df


@dataclass
class ContinuousTransformer:
    """Numbers with fractions imputed by the median; all other columns as codes plus a draw in 0..1."""

    id_col: str
    seed: int = 42

    def fit(self, df: DataFrame) -> ContinuousTransformer:
        self.columns = [c for c in df.columns if c != self.id_col]
        found = {r["column"]: r["is_continuous"] for r in profile.continuous(df, self.columns).collect()}  # one row a column
        self.continuous = [c for c in self.columns if found[c]]
        nulls = df.agg(F.lit(0), *(F.count_if(F.col(c).isNull()).alias(c) for c in self.continuous)).first()
        self.nulls = {c: nulls[c] for c in self.continuous}
        self.places = {r["column"]: r["places"] for r in profile.decimal_places(df, self.continuous).collect()} if self.continuous else {}
        self.fills = profile.fill_values(df, self.continuous, [])
        self.codec = LabelCodec([c for c in self.columns if not found[c]], self.id_col).fit(df)
        return self

    def transform(self, df: DataFrame, draw: Draw | None = None) -> DataFrame:
        draw = draw or random_draw(self.seed)
        coded = self.codec.encode(profile.fill(df, self.fills))
        return coded.withColumns({c: F.col(c) + draw(c) for c in self.codec.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        """Codes below the draw, numbers rounded, and as many fill values null again as the fitted table had nulls, or,
        if there are fewer, the share of them that there is of those."""
        back = self.codec.decode(df.withColumns({c: F.floor(F.col(c)).cast("long") for c in self.codec.columns}))
        filled = {c: v for c, v in self.fills.items() if self.nulls[c]}
        counts = back.agg(F.lit(0), *(F.count_if(F.col(c) == F.lit(v)).alias(c) for c, v in filled.items())).first()
        for c, value in self.fills.items():
            wanted, have = self.nulls[c], counts[c] if c in filled else 0
            n = wanted if have >= wanted else have * have // max(wanted, 1)
            if n:
                back = split.exact_renull(back, c, value, n, self.id_col, self.seed)
            back = back.withColumn(c, positive_zero(F.round(F.col(c), int(self.places[c] or 0))))
        return back


@dataclass
class Imputer:
    """Median and mode for nulls, numbers as exact ranks in 0..1, levels as codes in 0..1, and back.

    ``as_codes`` leaves levels as whole codes. Numbers are ranked between ``quantiles`` points of the fitted column; with
    ``normal`` ranks become normal scores, cut at the ranks CUT and 1 - CUT.
    """

    id_col: str | None = None
    quantiles: int = 100
    as_codes: bool = False
    normal: bool = False
    seed: int = 42

    def fit(self, df: DataFrame) -> Imputer:
        self.schema = df.schema
        self.columns = [c for c in df.columns if c != self.id_col]
        kind = {f.name: f.dataType for f in df.schema}
        self.booleans = [c for c in self.columns if isinstance(kind[c], T.BooleanType)]
        self.numbers = [c for c in self.columns if isinstance(kind[c], T.NumericType)]
        self.levels = [c for c in self.columns if c not in self.booleans and c not in self.numbers]
        plain = self._plain(df)
        self.rates = {r["column"]: r["null_rate"] for r in profile.null_rates(plain, self.columns).collect()}  # one row a column
        self.fills = profile.fill_values(plain, [*self.numbers, *self.booleans], self.levels)
        floats = [c for c in self.numbers if not isinstance(kind[c], T.IntegralType)]
        self.places = {r["column"]: r["places"] for r in profile.decimal_places(df, floats).collect()} if floats else {}
        filled = profile.fill(plain, self.fills)
        self.points = profile.exact_quantiles(filled, self.numbers, [k / self.quantiles for k in range(self.quantiles + 1)]) if self.numbers else {}
        self.codes = {c: _sorted_codes(filled, c).persist() for c in self.levels}
        return self

    def _plain(self, df: DataFrame) -> DataFrame:
        return nan_as_null(df).select(*(F.col(c).cast("int").alias(c) if c in self.booleans else F.col(c) for c in self.columns))

    def transform(self, df: DataFrame) -> DataFrame:
        out = profile.fill(self._plain(df), self.fills)
        for c, codes in self.codes.items():
            known = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"), F.col("top").alias("_top"))
            scaled = F.col("_code") if self.as_codes else F.coalesce(ratio(F.col("_code"), F.col("_top")), F.lit(0.0))
            out = out.join(known, F.col(c) == F.col("_value"), "left").withColumn(c, scaled).select(*self.columns)
        ranked = out.withColumns({c: _rank(F.col(c), points) for c, points in self.points.items()})
        if not self.normal:
            return ranked
        cut = lambda u: F.greatest(F.least(u, F.lit(1 - CUT)), F.lit(CUT))
        return ranked.withColumns({c: draws.normal_quantile(cut(F.col(c))) for c in self.points})

    def inverse(self, df: DataFrame, draw: Draw | None = None, ids: Column | None = None) -> DataFrame:
        """Values in the fitted types and order of columns; cells equal to the fill value are null again with the
        column's share of nulls; the id column has ``ids`` or random ones."""
        draw = draw or random_draw(self.seed)
        # scores at the cuts are the ends
        share = lambda z: (draws.normal_cdf(z) - CUT) / (1 - 2 * CUT)
        out = df.withColumns({c: _from_rank(share(F.col(c)) if self.normal else F.col(c), points) for c, points in self.points.items()})
        for c, codes in self.codes.items():
            known = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            top = codes.agg(F.max("top").alias("_top"))
            code = F.rint(F.col(c) if self.as_codes else F.col(c) * F.col("_top")).cast("long")
            out = out.crossJoin(F.broadcast(top)).withColumn("_at", code).join(known, F.col("_at") == F.col("_code"), "left").withColumn(c, F.col("_value")).select(*self.columns)  # one row
        out = out.withColumns({c: positive_zero(F.round(F.col(c), int(p or 0))) for c, p in self.places.items()} | {c: to_type(F.col(c), self.schema[c].dataType) for c in [*self.numbers, *self.booleans] if c not in self.places})
        again = {c: F.when(~((F.col(c) == F.lit(self.fills[c]).cast(self.schema[c].dataType)) & (draw(c) < self.rates[c])), F.col(c)) for c in self.columns if self.rates[c]}
        out = out.withColumns(again) if again else out
        if self.id_col is not None and self.id_col in self.schema.names:
            out = out.withColumn(self.id_col, ids) if ids is not None else split.random_ids(out, self.id_col, self.seed)
            return out.select(*self.schema.names)
        return out.select(*self.columns)


def _sorted_codes(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, code, top) of levels in order of value."""
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    coded, n = prefix.numbered(levels, [F.col("value")], "code")
    return coded.withColumn("top", F.lit(n - 1).cast("long"))


def _rank(x: Column, points: list[float]) -> Column:
    """Place of a number between points that are in order, linear in between; the middle of a run of equal points."""
    grid = np.asarray(points, dtype=float)
    n = len(points) - 1

    @pandas_udf(T.DoubleType())
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            v = part.to_numpy(dtype=float)
            below, upto = np.searchsorted(grid, v, side="left"), np.searchsorted(grid, v, side="right")
            low, high = grid[np.maximum(below - 1, 0)], grid[np.minimum(below, n)]
            between = (below - 1 + (v - low) / np.where(high > low, high - low, 1.0)) / n
            found = np.where(upto > below, (below + upto - 1) / 2 / n, between)
            found = np.where(v <= grid[0], 0.0, np.where(v >= grid[-1], 1.0, found))
            yield pd.Series(np.where(np.isnan(v), np.nan, found))

    return place(x.cast("double"))


def _from_rank(u: Column, points: list[float]) -> Column:
    n = len(points) - 1
    grid = F.array(*map(F.lit, points))
    place = F.greatest(F.least(u, F.lit(1.0)), F.lit(0.0)) * n
    at = F.least(F.floor(place), F.lit(n - 1)).cast("int")
    return F.get(grid, at) + (place - at) * (F.get(grid, at + 1) - F.get(grid, at))
