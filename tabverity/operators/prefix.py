"""Running sums over an order and look-ups in ranges, without one task that holds all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Buckets of 0..1 that a look-up deals points and intervals by, at least.
BUCKETS = 1024


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """``df`` with running sums up to and including each row, and the totals; ``order`` is one of all rows.

    Rows are dealt by ranges of the order, summed up by range, and every range adds what the ranges before it have. Only
    one row a range comes to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumns({f"_v_{name}": value for name, value in sums.items()}).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    stored = written(placed, "ranges")
    rows = sorted(stored.groupBy("_part").agg(*(F.sum(f"_v_{name}").alias(name) for name in sums)).collect(), key=lambda r: r["_part"])  # one a range
    ends = {name: [*accumulate(r[name] for r in rows)] for name in sums}
    before = spark.createDataFrame([(r["_part"], *(ends[name][k] - r[name] for name in sums)) for k, r in enumerate(rows)], ", ".join(["_part int", *(f"`_b_{name}` long" for name in sums)]))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = stored.join(F.broadcast(before), "_part").withColumns({name: F.sum(f"_v_{name}").over(w) + F.col(f"_b_{name}") for name in sums})  # a row a range
    return added.select(*df.columns, *sums), {name: (ends[name][-1] if rows else 0) for name in sums}


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """``df`` with the place of each row from 0, and the number of rows."""
    found, totals = running(df, order, {name: F.lit(1)})
    return found.withColumn(name, (F.col(name) - 1).cast("long")), totals[name]


def in_interval(df: DataFrame, x: Column, intervals: DataFrame, columns: list[str], n_intervals: int) -> DataFrame:
    """``df`` with ``columns`` of the interval (lo, hi) that holds x; intervals part 0..1 and are closed at the right.

    The first one is closed at the left too; x beyond 0..1 is clipped, a null x has nulls. Points and intervals are dealt by
    buckets of 0..1, as many as there are intervals, so that a bucket of evenly spread points meets few of them.
    """
    buckets = max(BUCKETS, n_intervals)
    place = lambda c: F.least(F.floor(c * buckets), F.lit(buckets - 1)).cast("long")
    some = intervals.where("hi > lo").select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *(F.col(c).alias(f"_of_{c}") for c in columns))
    spread = some.withColumn("_bucket", F.explode(F.sequence(place(F.col("_lo")), place(F.col("_hi")))))
    point = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))
    # points without a value are spread over buckets that no interval has
    asked = df.withColumn("_x", point).withColumn("_at", F.coalesce(place(F.col("_x")), -1 - F.floor(F.rand(1) * 1000).cast("long")))
    inside = (F.col("_at") == F.col("_bucket")) & ((F.col("_x") > F.col("_lo")) | ((F.col("_lo") == 0) & (F.col("_x") == 0))) & (F.col("_x") <= F.col("_hi"))
    return asked.join(spread, inside, "left").select(*df.columns, *(F.col(f"_of_{c}").alias(c) for c in columns))
