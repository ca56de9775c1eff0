"""Distances to the closest records: exact, with bounds between blocks of rows (see ``nearest``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from . import nearest
from .profile import exact_quantiles

#: A distance up to this counts as zero.
ZERO = 1e-8


def scaled(real: DataFrame, df: DataFrame, columns: list[str], how: str = "minmax") -> DataFrame:
    """Columns as doubles scaled by the real table's range (or mean and deviation); not clipped, constants are 0."""
    two = (lambda c: (F.min(c), F.max(c) - F.min(c))) if how == "minmax" else (lambda c: (F.avg(c), F.stddev_pop(c)))
    stats = real.agg(*(x.cast("double").alias(f"_{k}_{c}") for c in columns for k, x in enumerate(two(c))))
    joined = df.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumns({c: F.coalesce(ratio(F.col(c) - F.col(f"_0_{c}"), F.col(f"_1_{c}")), F.lit(0.0)) for c in columns}).select(*df.columns)


def row_distances(left: DataFrame, right: DataFrame, id_col: str, columns: list[str], same_table: bool = False, index: nearest.Index | None = None) -> DataFrame:
    """Rows (id, nearest, second, farthest, zeros, pairs) of each left row over the right rows; itself is left out of its own table."""
    found = nearest.search(left, right, id_col, nearest.Euclidean(tuple(columns)), 2, "string", farthest=True, not_itself=same_table, zero=ZERO, index=index)
    at = lambda k: F.get("near", F.lit(k))["d"]
    return found.select("id", at(0).alias("nearest"), at(1).alias("second"), F.col("far").alias("farthest"), "zeros", "pairs")


def summary(rows: DataFrame) -> DataFrame:
    """(mean, p05, nndr_p05, mean_max, zero_cells, removed_rows): rows with any zero distance are left out of the statistics."""
    return summaries(rows.withColumn("pair", F.lit("")), [""]).drop("pair")


def summaries(rows: DataFrame, pairs: list[str]) -> DataFrame:
    """The summary of the rows of each ``pair``: all quantiles are asked for at once."""
    kept = F.col("zeros") == 0
    finite = lambda c: F.when(kept & (F.abs(c) < float("inf")), F.col(c))
    found = rows.select("pair", "zeros", finite("nearest").alias("nearest"), finite("farthest").alias("farthest"), ratio(finite("nearest"), finite("second")).alias("nndr")).persist()
    asked = {f"{c}_{k}": F.when(F.col("pair") == p, F.col(c)) for k, p in enumerate(pairs) for c in ("nearest", "nndr")}
    low = {c: q[0] if q else None for c, q in exact_quantiles(found.select(*(v.alias(c) for c, v in asked.items())), list(asked), [0.05]).items()}
    quantile = lambda name: F.get(F.array(*(F.lit(low[f"{name}_{k}"]).cast("double") for k in range(len(pairs)))), (F.array_position(F.array(*map(F.lit, pairs)), F.col("pair")) - 1).cast("int"))
    sums = found.groupBy("pair").agg(F.avg("nearest").alias("mean"), F.avg("farthest").alias("mean_max"), F.sum("zeros").alias("zero_cells"), F.count_if(~kept).alias("removed_rows"))
    names = rows.sparkSession.createDataFrame([(p,) for p in pairs], "pair string")
    done = names.join(sums, "pair", "left").select("pair", "mean", quantile("nearest").alias("p05"), quantile("nndr").alias("nndr_p05"), "mean_max", "zero_cells", F.coalesce("removed_rows", F.lit(0)).alias("removed_rows"))
    few = rows.sparkSession.createDataFrame(done.collect(), done.schema)  # a row a pair
    found.unpersist()
    return few


def distance_metrics(real: DataFrame, synthetic: DataFrame, id_col: str, columns: list[str], how: str = "minmax") -> DataFrame:
    """Rows (pair, mean, p05, nndr_p05, mean_max, zero_cells, removed_rows) for RR, SS and RS (real rows to synthetic)."""
    r, s = scaled(real, real, columns, how), scaled(real, synthetic, columns, how)
    metric, out = nearest.Euclidean(tuple(columns)), None
    of_real, of_synthetic = (nearest.build_index(df, id_col, "string", metric) for df in (r, s))
    for name, left, right, index, same in (("RR", r, r, of_real, True), ("SS", s, s, of_synthetic, True), ("RS", r, s, of_synthetic, False)):
        one = row_distances(left, right, id_col, columns, same, index).withColumn("pair", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return summaries(out, ["RR", "SS", "RS"])


def distance_score(metrics: DataFrame) -> DataFrame:
    """Mean nearest distance of real to synthetic rows over the mean farthest distance among real rows."""
    one = metrics.agg(F.max(F.when(F.col("pair") == "RS", F.col("mean"))).alias("a"), F.max(F.when(F.col("pair") == "RR", F.col("mean_max"))).alias("b"))
    return one.select(ratio(F.col("a"), F.col("b")).alias("score"))

