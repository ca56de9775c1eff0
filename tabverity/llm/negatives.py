"""Hard-negative mining with bit-sliced integer products.

A component x counts as the integer floor(scale * x); a row's score is its integer inner product with an anchor. Rows lie
in blocks, and a block has its components as bit-planes, in two's complement, the most significant plane first. Products of
an anchor are summed plane by plane. What the planes not yet read can add lies between the anchor's negative and its
positive components times the largest rest, so every plane halves the interval of every score. A row is dropped once its
interval lies outside every range asked for, or below the lower ends of as many rows as are wanted; those that are left
after the last plane have exact scores.

Two passes over pairs of a block of rows and a group of anchors: the first finds each anchor's positives, the second the
rows of other labels in the range of each positive. Anchors are a stated set of queries against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .kernels import ragged

#: Rows of a block at most on average, and at least for a table that has fewer blocks than Spark has partitions.
BLOCK_ROWS, LEAST_ROWS = 8192, 512
#: Anchors that meet a block of rows in one task, on average, and those whose products are formed at once.
GROUP_ANCHORS, ANCHORS_AT_ONCE = 1 << 14, 256
#: From this share of pairs down, planes are read for the rows that are left, anchor by anchor.
SPARSE = 1 / 8


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * vectors.astype(np.float64))


def slice_bits(values: np.ndarray) -> tuple[int, bytes]:
    """Planes of whole numbers (rows, dim): their number, and for each plane, the highest first, packed bits by row."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1, 0)
    planes = most.bit_length() + 1
    return planes, b"".join(np.packbits((values >> k) & 1 == 1, axis=1).tobytes() for k in reversed(range(planes)))


class Block:
    """Rows of one label after the other, with their bit-planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, planes: int, packed: bytes, dim: int) -> None:
        self.ids, self.labels, self.planes, self.dim = ids, labels, planes, dim
        self.packed = np.frombuffer(packed, dtype=np.uint8).reshape(planes, len(ids), -(-dim // 8))

    def bits(self, plane: int, rows: np.ndarray | slice, kind: type) -> np.ndarray:
        """0 or 1 for each row and component; ``plane`` counts from the lowest."""
        return np.unpackbits(self.packed[self.planes - 1 - plane][rows], axis=1, count=self.dim).astype(kind)

    def weight(self, plane: int) -> int:
        return -(1 << plane) if plane == self.planes - 1 else 1 << plane


def product_type(anchors: np.ndarray, planes: int) -> type:
    """The float that holds every partial product exactly."""
    most = (np.abs(anchors).sum(axis=1).max(initial=0) + 1) * 2.0**planes
    if most >= 2**53:
        raise ValueError("components are too large for exact products: scale vectors down")
    return np.float32 if most < 2**24 else np.float64


def possible(low: np.ndarray, high: np.ndarray, bands: np.ndarray, want: int) -> np.ndarray:
    """Which intervals may hold one of the ``want`` highest scores of a band (from, to)."""
    kept = np.zeros(len(low), dtype=bool)
    for a, b in bands:
        may = (high >= a) & (low <= b)
        sure = low[(low >= a) & (high <= b)]
        if len(sure) >= want:
            may &= high >= np.partition(sure, len(sure) - want)[len(sure) - want]
        kept |= may
    return kept


def best_of_bands(block: Block, rows: slice, left_out: slice, anchors: np.ndarray, bands: list[np.ndarray], want: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, band, places of rows, scores) of the ``want`` highest scores of each anchor's bands, ties to smaller ids.

    ``rows`` are looked at but for ``left_out``, which counts from the first of them.
    """
    kind = product_type(anchors, block.planes)
    for at in range(0, len(anchors), ANCHORS_AT_ONCE):
        a, some = anchors[at : at + ANCHORS_AT_ONCE].astype(kind), bands[at : at + ANCHORS_AT_ONCE]
        up, down = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1)
        least, most = np.array([b[:, 0].min(initial=np.inf) for b in some]), np.array([b[:, 1].max(initial=-np.inf) for b in some])
        partial = np.zeros((len(a), len(block.ids[rows])), dtype=kind)
        plane, left = block.planes, None
        while plane and (left is None or left.mean() > SPARSE):
            plane -= 1
            partial += (block.weight(plane) * a) @ block.bits(plane, rows, kind).T
            rest = (1 << plane) - 1
            floor_, ceiling = least - rest * up, most - rest * down
            if partial.shape[1] > want and np.isneginf(least).all() and np.isposinf(most).all():  # all scores are asked for
                partial[:, left_out] = -np.inf
                floor_ = np.partition(partial, -want, axis=1)[:, -want] - rest * (up - down)
            left = (partial >= floor_[:, None].astype(kind)) & (partial <= ceiling[:, None].astype(kind))
            left[:, left_out] = False
        for i, mine in enumerate(left):
            found, k = np.flatnonzero(mine), plane
            score = partial[i, found]
            while len(found):
                rest = (1 << k) - 1
                kept = possible(score + rest * down[i], score + rest * up[i], some[i], want)
                found, score = found[kept], score[kept]
                if not k:
                    break
                k -= 1
                score = score + block.weight(k) * (block.bits(k, found + (rows.start or 0), kind) @ a[i])
            ids = block.ids[rows][found]
            for j, (low, high) in enumerate(some[i]):
                inside = np.flatnonzero((score >= low) & (score <= high))
                first = inside[np.lexsort((ids[inside], -score[inside]))[:want]]
                yield at + i, j, found[first] + (rows.start or 0), score[first].astype(np.int64)


def _pack(table: pa.Table, scale: float) -> pa.Table:
    """One row for each length of vectors: ids, labels, which are anchors, integers of those, and all as bit-planes."""
    ids, labels, anchor = (table.column(c).to_numpy() for c in ("id", "label", "anchor"))
    vectors = table.column("vector").combine_chunks()
    lengths, values = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    # Of rows that repeat an id the first by label, length and components counts.
    _, place, times = np.unique(ids, return_inverse=True, return_counts=True)
    kept = times[place] == 1
    for k in np.flatnonzero(times > 1):
        same = np.flatnonzero(place == k)
        kept[min(same, key=lambda i: (labels[i], lengths[i], values[starts[i] : starts[i] + lengths[i]].tolist()))] = True
    out = []
    for dim in np.unique(lengths[kept]).tolist():
        own = np.flatnonzero(kept & (lengths == dim))
        own = own[np.lexsort((ids[own], labels[own]))]
        whole = integers(values[ragged(starts[own], lengths[own])].reshape(len(own), dim), scale)
        if len(whole) and np.abs(whole).max(initial=0) >= 2**52:
            raise ValueError("components are too large for exact products: scale vectors down")
        whole = whole.astype(np.int64)
        planes, packed = slice_bits(whole)
        asks = anchor[own].astype(bool)
        out.append({"dim": dim, "block": table.column("block")[0].as_py(), "ids": ids[own].tobytes(), "labels": labels[own].tobytes(), "planes": planes, "packed": packed, "n_anchors": int(asks.sum()), "a_ids": ids[own][asks].tobytes(), "a_labels": labels[own][asks].tobytes(), "a_values": whole[asks].tobytes()})
    return pa.Table.from_pylist(out, schema=PACKED_ARROW)


PACKED = "dim int, block long, ids binary, labels binary, planes int, packed binary, n_anchors int, a_ids binary, a_labels binary, a_values binary"
PACKED_ARROW = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("planes", pa.int32()), ("packed", pa.binary()), ("n_anchors", pa.int32()), ("a_ids", pa.binary()), ("a_labels", pa.binary()), ("a_values", pa.binary())])
FOUND = "dim int, block long, anchor_id long, positive_id long, positive_score long, other long, score long"


def _found(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * 7
    kinds = [pa.int32(), *[pa.int64()] * 6]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["dim", "block", "anchor_id", "positive_id", "positive_score", "other", "score"])


def _numbers(column: pa.ChunkedArray, kind: type = np.int64) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype=kind) for x in column]


def _tile(anchors: pa.Table, blocks: pa.Table, want: int, low: int, high: int, second: bool) -> pa.Table:
    """Best rows of one block for a group of anchors; ``second``: for the ranges of the anchors' positives."""
    if not anchors.num_rows or not blocks.num_rows:
        return _found([])
    dim, b = blocks.column("dim")[0].as_py(), {c: blocks.column(c)[0].as_py() for c in ("ids", "labels", "planes", "packed")}
    block = Block(np.frombuffer(b["ids"], dtype=np.int64), np.frombuffer(b["labels"], dtype=np.int64), b["planes"], b["packed"], dim)
    ids, labels = np.concatenate(_numbers(anchors.column("a_ids"))), np.concatenate(_numbers(anchors.column("a_labels")))
    values = np.concatenate([x.reshape(-1, dim) for x in _numbers(anchors.column("a_values"))]) if dim else np.zeros((len(ids), 0), dtype=np.int64)
    home = np.repeat(anchors.column("block").to_numpy(), anchors.column("n_anchors").to_numpy())
    positives: dict[int, list[tuple[int, int]]] = {}
    if second:
        for row in anchors.column("positives"):
            for p in row.as_py() or []:
                positives.setdefault(p["anchor_id"], []).append((p["positive_id"], p["positive_score"]))
    every, out = slice(0, len(block.ids)), []
    for label in np.unique(labels).tolist():
        own = np.flatnonzero(labels == label)
        same = slice(int(np.searchsorted(block.labels, label)), int(np.searchsorted(block.labels, label, side="right")))
        if not second and same.start == same.stop:
            continue
        if not second:
            bands = [np.array([[-np.inf, np.inf]])] * len(own)
            # an anchor meets itself, so one more is looked for
            for i, _, places, scores in best_of_bands(block, same, slice(0, 0), values[own], bands, want + 1):
                out += [(dim, int(home[own[i]]), int(ids[own[i]]), None, None, int(x), int(s)) for x, s in zip(block.ids[places], scores) if x != ids[own[i]]]
            continue
        own = np.array([i for i in own if int(ids[i]) in positives], dtype=np.int64)
        ranges = [sorted({p for _, p in positives[int(ids[i])]}) for i in own]
        bands = [np.array([(-((-low * p) // 100), high * p // 100) for p in r], dtype=np.float64) for r in ranges]
        for i, j, places, scores in best_of_bands(block, every, same, values[own], bands, want) if len(own) else ():
            a = int(ids[own[i]])
            for positive, p in positives[a]:
                if p == ranges[i][j]:
                    out += [(dim, int(home[own[i]]), a, positive, p, int(x), int(s)) for x, s in zip(block.ids[places], scores)]
    return _found(out)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says which rows are anchors. An anchor's positives are the ``positives`` other rows of its label with the
    highest scores; its negatives for a positive of score p are the ``negatives`` rows of other labels with the highest
    scores s of those with low * p <= 100 * s <= high * p. Ties go to the smaller id; fewer are returned if there are fewer.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; labels are whole numbers.
    Rows meet rows of the same length. Of rows that repeat an id one counts: the least by label, length and components.
    An empty table, or one without anchors, gives no rows. Components whose products don't fit 53 bits are an error.
    Columns of any other name don't matter: only the three are read.
    """
    spark = rows.sparkSession
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    vector = F.col(vector_col) if rows.schema[vector_col].dataType.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")
    plain = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    plain = plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    n = plain.count()
    blocks = max(1, -(-n // BLOCK_ROWS), min(shuffle_partitions(spark), -(-n // LEAST_ROWS)))
    dealt = plain.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    packed = materialize(dealt.groupBy("block").applyInArrow(lambda t: _pack(t, scale), PACKED), "planes")
    groups = min(blocks, max(1, -(-(packed.agg(F.sum("n_anchors")).first()[0] or 0) // GROUP_ANCHORS)))
    range_ = lambda count: F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>")
    sliced = packed.select(F.col("dim").alias("dim"), F.col("block").alias("at"), F.explode(range_(groups)).alias("group"), "ids", "labels", "planes", "packed")
    asks = packed.where("n_anchors > 0").select("dim", "block", "n_anchors", "a_ids", "a_labels", "a_values", (F.col("block") % groups).alias("group"))

    def met(asking: DataFrame, want: int, second: bool) -> DataFrame:
        tiles = asking.withColumn("at", F.explode(range_(blocks))).groupBy("dim", "at", "group")
        return tiles.cogroup(sliced.groupBy("dim", "at", "group")).applyInArrow(lambda a, b: _tile(a, b, want, low, high, second), FOUND)

    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other"))
    first = met(asks, positives, False).withColumn("rank", place("dim", "anchor_id")).where(F.col("rank") <= positives)
    pairs = materialize(first.select("dim", "block", "anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    of_block = pairs.groupBy("dim", "block").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("positives"))
    best = met(asks.join(of_block, ["dim", "block"]), negatives, True).withColumn("rank", place("dim", "anchor_id", "positive_id")).where(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives_sql() -> str:
    """The query in DuckDB's SQL, for tables of one row for each id."""
    return """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM e a JOIN e r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INT) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
