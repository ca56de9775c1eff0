"""Exact splits and draws by the order of a hash: repeatable, and without sorting a class in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary"))


def take_first(df: DataFrame, quota: Column, id_col: str, seed: int, by: list[str]) -> DataFrame:
    """A column ``taken``: the first ``quota`` rows of each group in hash order; ``quota`` may use the column ``group_rows``.

    Groups are counted by the first three hex digits of the hash; only rows of the part in which a quota ends are
    ranked.
    """
    keyed = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_part", F.substring("_h", 1, 3))
    parts = keyed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    sums = parts.withColumns({"_upto": F.sum("_n").over(w.orderBy("_part")), "group_rows": F.sum("_n").over(w)})
    sums = sums.withColumn("_left", quota - (F.col("_upto") - F.col("_n"))).select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_by_part"), "_left", "_n")
    same = F.col("_part") == F.col("_by_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = keyed.join(sums, same)
    ends = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_h", id_col))
    return joined.withColumn("taken", F.when(ends, rank <= F.col("_left")).otherwise(F.col("_left") >= F.col("_n"))).select(*df.columns, "taken")


def stratified_split(df: DataFrame, label: str, id_col: str, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """A column ``is_train``: the rounded share of every class."""
    return take_first(df, F.round(F.col("group_rows") * train_share).cast("long"), id_col, seed, [label]).withColumnRenamed("taken", "is_train")


def exact_renull(df: DataFrame, column: str, fill_value: object, count: int, id_col: str, seed: int = 42) -> DataFrame:
    """``count`` of the cells that hold the fill value become null."""
    marked = df.withColumn("_is_fill", F.col(column).eqNullSafe(F.lit(fill_value)))
    taken = take_first(marked, F.lit(count), id_col, seed, ["_is_fill"])
    return taken.withColumn(column, F.when(~(F.col("_is_fill") & F.col("taken")), F.col(column))).select(*df.columns)


def ratio_adjust(df: DataFrame, label: str, quotas: dict[object, int], id_col: str, seed: int = 42) -> DataFrame:
    """At most the quota of each class; what classes lack is topped up with other rows, in hash order."""
    quota = F.lit(0)
    for value, n in quotas.items():
        quota = F.when(F.col(label) == value, n).otherwise(quota)
    taken = take_first(df, quota, id_col, seed, [label])
    kept = taken.where("taken").drop("taken")
    rest = taken.where("not taken").drop("taken")
    lack = sum(quotas.values()) - kept.count()
    top_up = take_first(rest.withColumn("_all", F.lit(0)), F.lit(max(lack, 0)), id_col, seed + 1, ["_all"]).where("taken").select(*df.columns)
    return kept.unionByName(top_up)


def half_split(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """A column ``is_first``: half of the rows, rounded down, in hash order."""
    halved = take_first(df.withColumn("_all", F.lit(0)), F.floor(F.col("group_rows") / 2), id_col, seed, ["_all"])
    return halved.withColumnRenamed("taken", "is_first").drop("_all")


def dense_index(df: DataFrame, id_col: str, name: str = "index", seed: int = 42) -> DataFrame:
    """A column that numbers the rows from 0, in hash order: a shuffled order, counted by parts of the hash."""
    keyed = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_part", F.substring("_h", 1, 3))
    parts = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select(F.col("_part").alias("_of"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # 4096 rows at most
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", id_col))
    numbered = keyed.withColumn("_r", rank).join(F.broadcast(before), F.col("_part") == F.col("_of"))
    return numbered.withColumn(name, F.col("_before") + F.col("_r") - 1).select(*df.columns, name)


def head_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by a column: each task keeps its own first ones before they meet."""
    return df.orderBy(order).limit(n)


def resample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn with replacement: rows (draw, columns...). A draw is repeatable by its number and the seed."""
    rows = df.count()
    place = F.conv(F.substring(F.md5(F.concat(F.col("draw").cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 12), 16, 10).cast("long") % F.lit(max(rows, 1))
    draws = df.sparkSession.range(n if rows else 0).withColumnRenamed("id", "draw").withColumn("_at", place)
    return draws.join(dense_index(df, id_col, "_index", seed), F.col("_at") == F.col("_index")).drop("_at", "_index")


def random_ids(df: DataFrame, name: str, seed: int = 42) -> DataFrame:
    return df.withColumn(name, F.concat(F.lit("ID-"), (F.lit(10000000) + F.floor(F.rand(seed) * 89999999)).cast("long").cast("string")))
