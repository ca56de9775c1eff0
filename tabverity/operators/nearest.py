"""Exact nearest and farthest rows, with bounds that spare most pairs of blocks.

Right rows are dealt to the nearest of some pivots, and by their distance to it into rings. For a left row at distance a
from a pivot, the rows of a ring between lo and hi are at least max(a - hi, lo - a) and at most a + hi away: distances obey
the triangle inequality. The box of a ring's numbers bounds them as well. Two passes: the first compares every left row with the rings that are nearest by these bounds and
hold enough rows (and with the one that may be farthest); the second with those rings only that may still hold a nearer or
a farther row. Results are those of comparing all pairs.

Tasks compare a part of the left rows with one block of right rows. Pivots and rings are of bounded number; rings that are
larger than a block are cut by hash. Distances are summed column by column in matrices of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import split

#: Right rows that are one block without pivots, of a block on average else, pivots and rings of a pivot at most, left rows of a part, and of a matrix.
ONE_BLOCK, BLOCK_ROWS, MOST_PIVOTS, MOST_RINGS, PART_ROWS, CHUNK_ROWS = 8192, 256, 4096, 64, 1024, 256
#: What bounds are loosened by, as sums round.
SLACK = 1e-9


@dataclass(frozen=True)
class Gower:
    """Mean difference over columns: numbers by their share of ``widths``, levels 0 or 1; null differs from everything."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    widths: tuple[float, ...]

    def distances(self, x: np.ndarray, c: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
        d = np.zeros((len(x), len(y)))
        for f in range(len(self.numeric)):
            gaps = np.abs(x[:, f, None] - y[None, :, f]) / self.widths[f]
            d += np.where(np.isnan(gaps), 1.0, gaps)
        for f in range(len(self.categorical)):
            d += (c[:, f, None] != e[None, :, f]) | (c[:, f, None] < 0)
        return np.round(d / max(len(self.numeric) + len(self.categorical), 1), 12)

    def box_bounds(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, has_null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least, most = np.zeros((len(x), len(low))), np.full((len(x), len(low)), float(len(self.categorical)))
        for f in range(len(self.numeric)):
            near, far = (v / self.widths[f] for v in _gaps(x[:, f, None], low[None, :, f], high[None, :, f]))
            least += np.where(np.isnan(near), 1.0, near)
            most += np.where(np.isnan(far) | has_null[None, :, f], 1.0, far)
        columns = max(len(self.numeric) + len(self.categorical), 1)
        return least / columns, most / columns


@dataclass(frozen=True)
class Euclidean:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()

    def distances(self, x: np.ndarray, c: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
        d = np.zeros((len(x), len(y)))
        for f in range(len(self.numeric)):
            gaps = x[:, f, None] - y[None, :, f]
            d += gaps * gaps
        return np.sqrt(d)

    def box_bounds(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, has_null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least, most = np.zeros((len(x), len(low))), np.zeros((len(x), len(low)))
        for f in range(len(self.numeric)):
            near, far = _gaps(x[:, f, None], low[None, :, f], high[None, :, f])
            least += near * near
            most += far * far
        return np.sqrt(least), np.sqrt(most)


def _gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest difference of a number and those of a range."""
    return np.maximum(np.maximum(low - x, x - high), 0.0), np.maximum(np.abs(x - low), np.abs(x - high))


Metric = Gower | Euclidean


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Numbers of a list column, null as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _codes(columns: list[pa.Array], width: int) -> list[np.ndarray]:
    """Levels of list columns as the same numbers in all of them; null is -1."""
    flat = [c.flatten() for c in columns]
    coded = pa.chunked_array([f.cast(pa.string()) for f in flat]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    ends = np.cumsum([0, *map(len, flat)])
    return [coded[a:b].reshape(len(c), width) for c, a, b in zip(columns, ends, ends[1:])]


def _rows(df: DataFrame, id_col: str, kind: str, metric: Metric) -> DataFrame:
    return df.select(F.col(id_col).cast(kind).alias("id"), F.array(*(F.col(c).cast("double") for c in metric.numeric)).cast("array<double>").alias("x"), F.array(*(F.col(c).cast("string") for c in metric.categorical)).cast("array<string>").alias("c"))


@dataclass
class Index:
    """Right rows by blocks, and what bounds need: pivots, and the rings with their pivot, bounds, rows and box.

    A small table is one block, which every left row meets.
    """

    metric: Metric
    blocks: DataFrame
    pivots: tuple[pa.Array, pa.Array] | None = None
    of: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    boxes: tuple[np.ndarray, np.ndarray, np.ndarray] = ()
    sizes: DataFrame | None = None


def _to_pivots(batch: pa.RecordBatch | pa.Table, metric: Metric, pivots: tuple[pa.Array, pa.Array]) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of rows to all pivots, from row k on."""
    x, y = _matrix(batch.column("x"), len(metric.numeric)), _matrix(pivots[0], len(metric.numeric))
    c, e = _codes([batch.column("c"), pivots[1]], len(metric.categorical))
    for k in range(0, len(x), CHUNK_ROWS):
        yield k, metric.distances(x[k : k + CHUNK_ROWS], c[k : k + CHUNK_ROWS], y, e)


def build_index(right: DataFrame, id_col: str, kind: str, metric: Metric, block_rows: int | None = None) -> Index:
    return _index(_rows(right, id_col, kind, metric), kind, metric, block_rows)


def _deal(rows: DataFrame, kind: str, metric: Metric, pivots: tuple[pa.Array, pa.Array]) -> DataFrame:
    """Rows with their nearest pivot and their distance ``at`` to it; all cores take part, however few files the rows are in."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d.argmin(axis=1), d.min(axis=1)) for _, d in _to_pivots(batch, metric, shared.value)]
            if found:
                home, at = (np.concatenate(v) for v in zip(*found))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int64()), pa.array(at)], names=[*batch.schema.names, "pivot", "at"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartition(parts, "id").mapInArrow(assign, f"id {kind}, x array<double>, c array<string>, pivot long, at double"), "nearest-rows")


def _index(rows: DataFrame, kind: str, metric: Metric, block_rows: int | None = None) -> Index:
    """Blocks of ``block_rows`` right rows; without it a table of up to ONE_BLOCK rows is one block."""
    most, block_rows = (0, block_rows) if block_rows else (ONE_BLOCK, BLOCK_ROWS)
    spark, n = rows.sparkSession, rows.count()
    packed = F.sort_array(F.collect_list(F.struct("id", "x", "c"))).alias("rows")
    zero = F.lit(0).cast("long")
    if n <= most:
        one = rows.groupBy(zero.alias("number"), zero.alias("piece")).agg(packed)
        return Index(metric, one, rows=np.array([n] * (n > 0)), sizes=spark.range(1).select(zero.alias("number"), F.lit(1).cast("long").alias("pieces")))
    wanted = min(MOST_PIVOTS, max(1, -(-n // block_rows)))
    taken = split.take_first(rows.withColumn("_all", F.lit(0)), F.lit(wanted), "id", 7, ["_all"]).where("taken").select("x", "c")
    few = taken.distinct().toArrow()  # MOST_PIVOTS at most
    pivots = (few.column("x").combine_chunks(), few.column("c").combine_chunks())
    dealt = _deal(rows, kind, metric, pivots)
    cells = dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.min("at").alias("least"), F.max("at").alias("most"))
    cells = cells.withColumn("rings", F.least(F.ceil(F.col("n") / block_rows), F.lit(MOST_RINGS)))
    ring = F.least(F.floor(F.coalesce(F.try_divide((F.col("at") - F.col("least")) * F.col("rings"), F.col("most") - F.col("least")), F.lit(0.0))), F.col("rings") - 1)
    ringed = dealt.join(F.broadcast(cells.select("pivot", "least", "most", "rings")), "pivot").withColumn("ring", F.col("pivot") * MOST_RINGS + ring)  # a row a pivot
    sides = [f(F.col("x")[k]).alias(f"{name}_{k}") for k in range(len(metric.numeric)) for name, f in (("least", F.min), ("most", F.max), ("null", lambda c: F.bool_or(c.isNull())))]
    found = ringed.groupBy("ring").agg(F.first("pivot").alias("pivot"), F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n"), *sides).orderBy("ring").toPandas()  # MOST_PIVOTS * MOST_RINGS at most
    boxes = tuple(np.column_stack([np.zeros((len(found), 0)), *(found[f"{name}_{k}"].to_numpy() for k in range(len(metric.numeric)))]).astype(kind_) for name, kind_ in (("least", float), ("most", float), ("null", bool)))
    pieces = np.maximum(1, -(-found["n"].to_numpy() // (2 * block_rows)))
    sizes = spark.createDataFrame([(int(r), k, int(p)) for k, (r, p) in enumerate(zip(found["ring"], pieces))], "ring long, number long, pieces long")
    numbered = ringed.join(F.broadcast(sizes), "ring").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")))
    blocks = written(numbered.groupBy("number", "piece").agg(packed), "nearest-blocks")
    return Index(metric, blocks, pivots, found["pivot"].to_numpy(), found["low"].to_numpy(), found["high"].to_numpy(), found["n"].to_numpy(), boxes, sizes)


def _first_rings(low: np.ndarray, high: np.ndarray, rows: np.ndarray, k: int, farthest: bool) -> list[np.ndarray]:
    """For each left row, the rings nearest by their lower bound that hold ``k`` rows, and the one that may be farthest."""
    order = np.argsort(low + high * 1e-6, axis=1, kind="stable")  # bounds of 0 are many: the smaller ring is tried first
    enough = np.cumsum(rows[order], axis=1)
    last = np.minimum((enough < k).sum(axis=1), low.shape[1] - 1)
    out = [o[: n + 1] for o, n in zip(order, last)]
    return [np.union1d(o, [h]) for o, h in zip(out, high.argmax(axis=1))] if farthest else out


def _bounds(metric: Metric, x: np.ndarray, d: np.ndarray, rings: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Between which distances the rows of every ring lie: by its pivot, and by its box of numbers."""
    of, low, high, boxes = rings
    a = d[:, of]
    least, most = metric.box_bounds(x, *boxes)
    return np.maximum(np.maximum(np.maximum(a - high, low - a), 0), least) - SLACK, np.minimum(a + high, most) + SLACK


def _chunk_bounds(metric: Metric, x: np.ndarray, at: float, to_home: np.ndarray, rings: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Between which distances the rows of every ring lie from all of some rows, which are up to ``at`` from one pivot.

    ``to_home`` are distances of all pivots to that one. The rows' box meets the rings' boxes by its middle and half widths.
    """
    of, low, high, boxes = rings
    least, most = np.zeros(len(of)), np.full(len(of), np.inf)
    if x.shape[1] and not np.isnan(x).any():
        one = np.zeros((1, x.shape[1]))  # a point at 0 against boxes of differences
        gap_low, gap_high = boxes[0] - x.max(axis=0), boxes[1] - x.min(axis=0)
        near, far = metric.box_bounds(one, gap_low, gap_high, boxes[2])
        least, most = near[0], far[0]
    a = to_home[of]
    return np.maximum(np.maximum(a - at - high, low - a - at), least) - 3 * SLACK, np.minimum(a + at + high, most) + 3 * SLACK


def _candidates(low: np.ndarray, high: np.ndarray, rows: np.ndarray, k: int, farthest: bool) -> np.ndarray:
    """Rings that may be the nearest ones, which hold ``k`` rows, or the farthest one, of any row with these bounds."""
    order = np.argsort(high, kind="stable")
    last = int(np.searchsorted(np.cumsum(rows[order]), k))
    kept = ~(low > high[order[last]]) if last < len(order) else np.ones(len(order), dtype=bool)
    return np.flatnonzero(kept | ~(high < low.max()) if farthest else kept)


def _ask(left: DataFrame, index: Index, kind: str, k: int, farthest: bool, again: bool, zero: float) -> DataFrame:
    """Left rows with the rings they must meet; ``again``: after the first pass, whose rings and results they carry.

    Rows of one pivot follow each other. Some of them at a time rule out most rings by what bounds them all, so that a row
    looks at rings near it only.
    """
    metric, rings, rows = index.metric, (index.of, index.low, index.high, index.boxes), index.rows
    spark = left.sparkSession
    shared = spark.sparkContext.broadcast((index.pivots, rings, rows))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, rings, rows = shared.value
        of, ring_low, ring_high, boxes = rings
        y = _matrix(pivots[0], len(metric.numeric))
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[np.ndarray] = []
            x = _matrix(batch.column("x"), len(metric.numeric))
            c, e = _codes([batch.column("c"), pivots[1]], len(metric.categorical))
            home, far_out = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("pivot", "at"))
            cuts = np.flatnonzero(np.diff(home)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(home)]):
                to_home = metric.distances(y[home[begin], None], e[home[begin], None], y, e)[0]
                for at in range(begin, end, CHUNK_ROWS):
                    upto = min(end, at + CHUNK_ROWS)
                    some = _chunk_bounds(metric, x[at:upto], far_out[at:upto].max(), to_home, rings)
                    if again:
                        kth, far = (batch.column(n).to_numpy(zero_copy_only=False)[at:upto] for n in ("kth", "far"))
                        least = np.maximum(kth, zero)
                        kept = np.flatnonzero(~(some[0] > least.max()) | ~(some[1] < far.min()) if farthest else ~(some[0] > least.max()))
                    else:
                        kept = _candidates(*some, rows, k, farthest)
                    used, place = np.unique(of[kept], return_inverse=True)
                    d = metric.distances(x[at:upto], c[at:upto], y[used], e[used])
                    low, high = _bounds(metric, x[at:upto], d, (place, ring_low[kept], ring_high[kept], tuple(b[kept] for b in boxes)))
                    if not again:
                        out += [kept[o] for o in _first_rings(low, high, rows[kept], k, farthest)]
                        continue
                    wanted = low <= least[:, None]
                    if farthest:
                        wanted |= high >= far[:, None]
                    out += [np.setdiff1d(kept[row], seen) for row, seen in zip(wanted, batch.column("rings")[at:upto].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "x", "c", "pivot", "at")), pa.array([o.tolist() for o in out], pa.list_(pa.int64())), pa.array([int(o[0]) if len(o) else -1 for o in out], pa.int64())], names=["id", "x", "c", "pivot", "at", "rings", "home"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = left.repartitionByRange(parts, "pivot", "at", "id").sortWithinPartitions("pivot", "at")
    return written(together.mapInArrow(ask, f"id {kind}, x array<double>, c array<string>, pivot long, at double, rings array<long>, home long"), "nearest-asked")


def search(left: DataFrame, right: DataFrame, id_col: str, metric: Metric, k: int, kind: str = "long", farthest: bool = False, not_itself: bool = False, zero: float = 0.0, index: Index | None = None) -> DataFrame:
    """Rows (id, near, far, zeros, pairs) of each left row with an id: its ``k`` nearest right rows (d, id), ties by id.

    ``far`` is the largest distance if ``farthest``, ``zeros`` counts distances up to ``zero``, and ``pairs`` the right
    rows that were compared. With ``not_itself`` the right row of the same id is left out.
    """
    return _search(_rows(left, id_col, kind, metric), index or build_index(right, id_col, kind, metric), k, kind, farthest, not_itself, zero)


def search_vectors(left: DataFrame, right: DataFrame, id_col: str, metric: Metric, k: int) -> DataFrame:
    """Rows (id, near) as of ``search``. Left rows that are alike are asked about once, and of right rows that are alike the
    ``k`` with the smallest ids take part, as no other can be among the nearest: work grows with the different rows."""
    alike = Window.partitionBy("x", "c").orderBy("id")
    few = _rows(right, id_col, "long", metric).withColumn("_k", F.row_number().over(alike)).where(F.col("_k") <= k).drop("_k")
    index = _index(written(few, "nearest-right"), "long", metric)
    asked = _rows(left, id_col, "long", metric)
    kinds = written(asked.select("x", "c").distinct().withColumn("id", F.monotonically_increasing_id()).select("id", "x", "c"), "nearest-left")
    found = _search(kinds, index, k, "long").select(F.col("id").alias("_id"), "near")
    answers = kinds.join(found, F.col("id") == F.col("_id")).select(F.col("x").alias("_x"), F.col("c").alias("_c"), "near")
    every = asked.join(answers, (F.col("x") == F.col("_x")) & (F.col("c") == F.col("_c")))
    return every.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), F.lit(1), F.lit(k)).alias("near"))


def _search(asked: DataFrame, index: Index, k: int, kind: str, farthest: bool = False, not_itself: bool = False, zero: float = 0.0) -> DataFrame:
    if not len(index.rows):
        none = f"array<struct<d:double,id:{kind}>>"
        return asked.select("id", F.array().cast(none).alias("near"), F.lit(None).cast("double").alias("far"), F.lit(0).cast("long").alias("zeros"), F.lit(0).cast("long").alias("pairs"))
    if index.pivots is None:
        return _meet(asked.withColumns({"rings": F.array(F.lit(0).cast("long")), "home": F.lit(0).cast("long")}), index, kind, k, not_itself, zero)
    wanted = k + not_itself
    sent = _ask(_deal(asked, kind, index.metric, index.pivots), index, kind, wanted, farthest, False, zero)
    first = written(_meet(sent, index, kind, k, not_itself, zero), "nearest-first")
    bound = first.select(F.col("id").alias("_id"), F.when(F.size("near") >= k, F.col("near")[k - 1]["d"]).otherwise(float("inf")).alias("kth"), F.coalesce("far", F.lit(-1.0)).alias("far"))
    second = _ask(sent.join(bound, F.col("id") == F.col("_id")).select("id", "x", "c", "pivot", "at", "rings", "kth", "far"), index, kind, wanted, farthest, True, zero)
    every = first.unionByName(_meet(second.where(F.size("rings") > 0), index, kind, k, not_itself, zero))
    near = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), F.lit(1), F.lit(k))
    return every.groupBy("id").agg(near.alias("near"), F.max("far").alias("far"), F.sum("zeros").alias("zeros"), F.sum("pairs").alias("pairs"))


def _meet(asked: DataFrame, index: Index, kind: str, k: int, not_itself: bool, zero: float) -> DataFrame:
    """Partial results of left rows over the blocks of their rings, summed up by row."""
    metric = index.metric
    # left rows that go to the same rings lie together: by their first ring, in parts
    homes = asked.groupBy("home").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    parted = asked.join(F.broadcast(homes), "home").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))  # a row a ring
    spread = parted.withColumn("number", F.explode("rings")).join(F.broadcast(index.sizes), "number")  # a row a ring
    spread = spread.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    spread = spread.select("home", "part", "number", "piece", "id", "x", "c")
    tiles = spread.select(*(F.col(c).alias(c) for c in ("home", "part", "number", "piece"))).distinct()
    blocks = tiles.join(index.blocks.select(F.col("number").alias("_n"), F.col("piece").alias("_p"), "rows"), (F.col("number") == F.col("_n")) & (F.col("piece") == F.col("_p"))).drop("_n", "_p")
    schema = f"id {kind}, near array<struct<d:double,id:{kind}>>, far double, zeros long, pairs long"

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        arrow = pa.int64() if kind == "long" else pa.string()
        near_type = pa.list_(pa.struct([("d", pa.float64()), ("id", arrow)]))
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": pa.array([], arrow), "near": pa.array([], near_type), "far": pa.array([], pa.float64()), "zeros": pa.array([], pa.int64()), "pairs": pa.array([], pa.int64())})
        other = b.column("rows").combine_chunks().flatten()
        x_column, c_column, ids = (a.column(c).combine_chunks() for c in ("x", "c", "id"))
        x, y = _matrix(x_column, len(metric.numeric)), _matrix(other.field("x"), len(metric.numeric))
        c, e = _codes([c_column, other.field("c")], len(metric.categorical))
        mine, theirs = ids.to_numpy(zero_copy_only=False), other.field("id").to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        for at in range(0, len(x), CHUNK_ROWS):
            d = metric.distances(x[at : at + CHUNK_ROWS], c[at : at + CHUNK_ROWS], y, e)
            if not_itself:
                d[mine[at : at + CHUNK_ROWS, None] == theirs[None, :]] = np.nan
            finite = np.where(np.isnan(d), np.inf, d)
            n = min(k, d.shape[1])
            least = np.partition(finite, n - 1, axis=1)[:, n - 1]
            far, zeros = np.where(np.isnan(d), -np.inf, d).max(axis=1), (d <= zero).sum(axis=1)
            for row, most, f, z in zip(finite, least, far, zeros):
                best = np.flatnonzero(row <= most)
                best = best[np.argsort(row[best], kind="stable")[:n]]
                best = best[np.isfinite(row[best])]
                out.append((list(zip(row[best].tolist(), theirs[best].tolist())), None if f < 0 else float(f), int(z)))
        near = [[{"d": d, "id": i} for d, i in r[0]] for r in out]
        return pa.table({"id": ids, "near": pa.array(near, near_type), "far": pa.array([r[1] for r in out], pa.float64()), "zeros": pa.array([r[2] for r in out], pa.int64()), "pairs": pa.array([len(y)] * len(x), pa.int64())})

    found = spread.groupBy("home", "part", "number", "piece").cogroup(blocks.groupBy("home", "part", "number", "piece")).applyInArrow(compare, schema)
    near = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), F.lit(1), F.lit(k))
    return found.groupBy("id").agg(near.alias("near"), F.max("far").alias("far"), F.sum("zeros").alias("zeros"), F.sum("pairs").alias("pairs"))
