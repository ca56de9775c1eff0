"""Vectors that no other vector dominates: local fronts first, then blocks against blocks that may dominate them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Vectors of a block, and compared at once; a local front that grows beyond MOST_HELD is passed on.
BLOCK, CHUNK, MOST_HELD = 8192, 256, 1 << 15


def dominated(v: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of ``v`` a row of ``by`` beats in one goal without losing in any (larger is better)."""
    out = np.zeros(len(v), dtype=bool)
    for k in range(0, len(v), CHUNK):
        some = v[k : k + CHUNK]
        at_least, beyond = np.ones((len(some), len(by)), dtype=bool), np.zeros((len(some), len(by)), dtype=bool)
        for g in range(v.shape[1]):
            at_least &= by[None, :, g] >= some[:, None, g]
            beyond |= by[None, :, g] > some[:, None, g]
        out[k : k + CHUNK] = (at_least & beyond).any(axis=1)
    return out


def front(v: np.ndarray) -> np.ndarray:
    """The rows of ``v`` that no row dominates: only rows of a larger sum can, so rows are taken in order of it."""
    v = v[np.argsort(-v.sum(axis=1), kind="stable")]
    kept = v[:0]
    for k in range(0, len(v), CHUNK):
        some = v[k : k + CHUNK]
        some = some[~dominated(some, kept)]
        kept = np.concatenate([kept, some[~dominated(some, some)]])
    return kept


def _vectors(column: pa.Array | pa.ChunkedArray, goals: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, goals)


def _batch(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.tolist(), pa.list_(pa.float64()))], names=["v"])


def undominated(vectors: DataFrame, goals: int) -> DataFrame:
    """Rows of the distinct ``vectors`` (v: an array of ``goals`` numbers, larger is better) that no other dominates.

    Every task passes on the front of what it has read. Fronts are dealt by ranges of the first goal into blocks; a block
    meets those blocks whose largest value of every goal reaches its least ones.
    """
    spark = vectors.sparkSession

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, goals))
        for batch in batches:
            v = _vectors(batch.column("v"), goals)
            for k in range(0, len(v), BLOCK):
                held = front(np.concatenate([held, v[k : k + BLOCK]]))
                if len(held) > MOST_HELD:
                    yield _batch(held)
                    held = held[:0]
        yield _batch(held)

    found = written(vectors.select("v").mapInArrow(local, "v array<double>"), "local-fronts").distinct()
    n = found.count()
    if n <= BLOCK:  # one block has them all
        return found.coalesce(1).mapInArrow(local, "v array<double>")
    parts = -(-n // BLOCK)
    blocks = written(found.repartitionByRange(parts, F.col("v")[0], F.col("v")).withColumn("block", F.spark_partition_id()), "fronts")
    sides = [f(F.col("v")[g]).alias(f"{name}_{g}") for name, f in (("least", F.min), ("most", F.max)) for g in range(goals)]
    corners = blocks.groupBy("block").agg(*sides).orderBy("block").collect()  # one a block
    low, high = (np.array([[r[f"{name}_{g}"] for g in range(goals)] for r in corners]).reshape(-1, goals) for name in ("least", "most"))
    numbers = [r["block"] for r in corners]
    met = [(numbers[i], numbers[j]) for i in range(len(corners)) for j in np.flatnonzero((high >= low[i]).all(axis=1))]
    tiles = spark.createDataFrame(met, "block int, other int")
    asked = blocks.join(F.broadcast(tiles), "block")
    against = blocks.withColumnRenamed("block", "other").join(F.broadcast(tiles), "other").select("block", "other", "v")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        v, by = _vectors(a.column("v"), goals), _vectors(b.column("v"), goals)
        return pa.Table.from_batches([_batch(v[dominated(v, by)])])

    alias = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))
    beaten = asked.groupBy("block", "other").cogroup(alias(against).groupBy("block", "other")).applyInArrow(compare, "v array<double>")
    return found.join(beaten.withColumnRenamed("v", "w"), F.col("v") == F.col("w"), "left_anti")
