"""Singling out over random subsets of columns, counted by bitmaps.

A predicate has a few terms: a number is at least or at most a value, a level is equal, or a cell is null. It singles out
if exactly one row fits. Predicates are drawn from synthetic rows, over columns drawn for each, and kept if they single out
a synthetic row; an attack succeeds if its predicate singles out an original row.

Rows are counted in batches: every term has a bitmap of the batch's rows, all thresholds of a column come from one running
OR over the rows in order, and a predicate is the AND of its terms' bitmaps. A task stops looking at a predicate that two
rows fit. No row meets a predicate as a joined row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import split
from .profile import exact_quantiles

#: Kinds of terms.
IS_NULL, AT_LEAST, AT_MOST, EQUALS = range(4)
#: Rows of a batch, predicates that are broadcast at most, and of a block beyond that.
BATCH_ROWS, MOST_BROADCAST, BLOCK_PREDICATES, BLOCK_ROWS = 4096, 1 << 16, 4096, 1 << 16
TERMS = "array<struct<col:int,op:int,number:double,text:string>>"


def _medians(df: DataFrame, numeric: list[str]) -> dict[str, float | None]:
    return {c: q[0] if q else None for c, q in exact_quantiles(df, numeric, [0.5]).items()} if numeric else {}


def _term(k: int, column: Column, median: float | None, is_number: bool, op: Column | None = None) -> Column:
    """The term that a cell makes: numbers from the median on ask for at least their value, others for at most."""
    number = F.when(~F.isnan(column.cast("double")), column.cast("double")) if is_number else F.lit(None).cast("double")
    text = F.lit(None).cast("string") if is_number else column.cast("string")
    if is_number:
        kind = op if op is not None else F.when(number >= F.lit(median), F.lit(AT_LEAST)).otherwise(F.lit(AT_MOST))
        kind = F.when(number.isNull(), F.lit(IS_NULL)).otherwise(kind)
    else:
        kind = F.when(text.isNull(), F.lit(IS_NULL)).otherwise(F.lit(EQUALS))
    return F.struct(F.lit(k).alias("col"), kind.alias("op"), number.alias("number"), text.alias("text"))


def _draw_of(key: Column, name: str, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{name}:{seed}")).cast("binary"))


def draw_predicates(rows: DataFrame, id_col: str, numeric: list[str], categorical: list[str], n_cols: int, medians: dict[str, float | None], seed: int = 42) -> DataFrame:
    """Rows (attack, place, terms): a predicate of each row over ``n_cols`` columns drawn by hash; ``place`` orders them."""
    cells = [F.struct(_draw_of(F.col(id_col), c, seed).alias("h"), _term(k, F.col(c), medians.get(c), c in numeric).alias("t")) for k, c in enumerate([*numeric, *categorical])]
    drawn = F.slice(F.array_sort(F.array(*cells)), F.lit(1), F.lit(n_cols))
    terms = F.array_sort(F.transform(drawn, lambda x: x["t"])).cast(TERMS)
    return rows.select(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).alias("attack"), split.hash_order(id_col, seed).alias("place"), terms.alias("terms"))


class Bitmaps:
    """Terms of predicates, and how often batches of rows fit all terms of each."""

    def __init__(self, predicates: list[list[tuple]]) -> None:
        known: dict[tuple, int] = {}
        for terms in predicates:
            for t in terms:
                known.setdefault(t, 0)
        self.parts: list[tuple[int, int, np.ndarray | list[str]]] = []
        n = 1  # row 0 fits everything
        for col, op in sorted({t[:2] for t in known}):
            values = sorted({t[2] if op in (AT_LEAST, AT_MOST) else t[3] or "" for t in known if t[:2] == (col, op)})
            self.parts.append((col, op, np.array(values, dtype=float) if op in (AT_LEAST, AT_MOST) else values))
            place = {v: n + k for k, v in enumerate(values)}
            known.update({t: place[t[2] if op in (AT_LEAST, AT_MOST) else t[3] or ""] for t in known if t[:2] == (col, op)})
            n += len(values)
        self.rows = n
        self.terms = np.zeros((len(predicates), max([1, *map(len, predicates)])), dtype=np.int64)
        for k, terms in enumerate(predicates):
            self.terms[k, : len(terms)] = [known[t] for t in terms]

    def fits(self, columns: list[pa.Array]) -> np.ndarray:
        """Rows of the batch that fit each predicate."""
        n = len(columns[0])
        size = -(-n // 8)
        maps = np.zeros((self.rows, size), dtype=np.uint8)
        maps[0] = np.packbits(np.ones(n, dtype=bool))
        at = 1
        for col, op, values in self.parts:
            column = columns[col]
            null = column.is_null(nan_is_null=True).to_numpy(zero_copy_only=False)
            if op == IS_NULL:
                maps[at] = np.packbits(null)
            elif op == EQUALS:
                code = column.dictionary_encode()
                place = {v: k for k, v in enumerate(values)}
                to = np.array([place.get(v, -1) for v in code.dictionary.to_pylist()] + [-1], dtype=np.int64)
                own = to[code.indices.fill_null(len(to) - 1).to_numpy()]
                self._mark(maps[at : at + len(values)], own, own >= 0)
            else:
                x = column.to_numpy(zero_copy_only=False).astype(float)
                x[null] = 0.0
                block = np.zeros((len(values) + 1, size), dtype=np.uint8)
                if op == AT_LEAST:  # values[k] <= x for all k below the rank
                    self._mark(block, np.searchsorted(values, x, side="right"), ~null)
                    maps[at : at + len(values)] = np.bitwise_or.accumulate(block[::-1], axis=0)[::-1][1:]
                else:  # x <= values[k] from the rank on
                    self._mark(block, np.searchsorted(values, x, side="left"), ~null)
                    maps[at : at + len(values)] = np.bitwise_or.accumulate(block, axis=0)[:-1]
            at += len(values)
        found = maps[self.terms[:, 0]]
        for k in range(1, self.terms.shape[1]):
            found &= maps[self.terms[:, k]]
        return np.bitwise_count(found).sum(axis=1, dtype=np.int64)

    @staticmethod
    def _mark(maps: np.ndarray, row: np.ndarray, kept: np.ndarray) -> None:
        k = np.flatnonzero(kept)
        np.bitwise_or.at(maps, (row[k], k >> 3), np.uint8(128) >> (k & 7).astype(np.uint8))


def count_fits(attacks: list[str], predicates: list[list[tuple]], batches: Iterable[list[pa.Array]]) -> list[tuple[str, int]]:
    """(attack, rows that fit, 2 at most) of the predicates that some row fits."""
    counts = np.zeros(len(attacks), dtype=np.int64)
    live = np.arange(len(attacks))
    maps = Bitmaps(predicates)
    kept = live
    for columns in batches:
        if not len(kept):
            break
        found = maps.fits(columns)
        counts[live] = np.minimum(counts[live] + found, 2)
        kept = live[counts[live] < 2]
        if 4 * len(kept) < 3 * len(live):
            live, maps = kept, Bitmaps([predicates[k] for k in kept])
    return [(attacks[k], int(counts[k])) for k in np.flatnonzero(counts)]


def _cut(columns: list[pa.Array]) -> Iterator[list[pa.Array]]:
    for k in range(0, len(columns[0]) if columns else 0, BATCH_ROWS):
        yield [c.slice(k, BATCH_ROWS) for c in columns]


def _plain(terms: list) -> list[tuple]:
    return [(t["col"], t["op"], t["number"], t["text"]) for t in terms]


def count_matches(df: DataFrame, predicates: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Columns of ``predicates`` and ``matches``: the rows of ``df`` that fit, 0, 1 or 2 for two or more.

    Up to MOST_BROADCAST predicates go to all tasks, which read the rows where they are; more meet them in blocks.
    """
    names = [f"c{k}" for k in range(len(numeric) + len(categorical))]
    cells = df.select(*(F.col(c).cast("double").alias(n) for c, n in zip(numeric, names)), *(F.col(c).cast("string").alias(n) for c, n in zip(categorical, names[len(numeric) :])))
    n = predicates.count()
    if n <= MOST_BROADCAST:
        rows = predicates.select("attack", "terms").collect()  # MOST_BROADCAST at most
        asked = df.sparkSession.sparkContext.broadcast(([r["attack"] for r in rows], [_plain(r["terms"]) for r in rows]))

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = count_fits(*asked.value, (part for b in batches for part in _cut(b.columns)))
            yield pa.RecordBatch.from_pydict({"attack": pa.array([a for a, _ in found], pa.string()), "n": pa.array([k for _, k in found], pa.int64())})

        counts = cells.mapInArrow(scan, "attack string, n long")
    else:
        blocks, parts = -(-n // BLOCK_PREDICATES), max(1, -(-df.count() // BLOCK_ROWS))
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"))
        left = predicates.select("attack", "terms", F.pmod(F.xxhash64("attack"), F.lit(blocks)).alias("block")).withColumn("part", every(parts))
        right = cells.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(parts))).withColumn("block", every(blocks))

        def meet(asks: pa.Table, rows: pa.Table) -> pa.Table:
            columns = [rows.column(c).combine_chunks() for c in names]
            found = count_fits(asks.column("attack").to_pylist(), [_plain(t) for t in asks.column("terms").to_pylist()], _cut(columns))
            return pa.table({"attack": pa.array([a for a, _ in found], pa.string()), "n": pa.array([k for _, k in found], pa.int64())})

        counts = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "attack string, n long")
    counts = counts.groupBy("attack").agg(F.least(F.sum("n"), F.lit(2)).alias("matches"))
    return predicates.join(counts, "attack", "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("int"))


def singling_predicates(synthetic: DataFrame, id_col: str, numeric: list[str], categorical: list[str], n_attacks: int, n_cols: int, seed: int = 42, rounds: int = 4) -> DataFrame:
    """Rows (attack, terms): at most ``n_attacks`` different predicates that single out a synthetic row.

    A round draws predicates of the first four times as many rows, in hash order, as are missing; every round draws rows
    and columns anew. Fewer are returned if ``rounds`` don't give more.
    """
    n_cols = min(n_cols, len(numeric) + len(categorical))
    medians = _medians(synthetic, numeric)
    kept, have = None, 0
    for k in range(rounds):
        some = split.take_first(synthetic.withColumn("_all", F.lit(0)), F.lit(4 * (n_attacks - have)), id_col, seed + k, ["_all"]).where("taken").drop("taken", "_all")
        drawn = draw_predicates(some, id_col, numeric, categorical, n_cols, medians, seed + k)
        alone = count_matches(synthetic, drawn, numeric, categorical).where("matches = 1").select(F.lit(k).alias("round"), "place", "attack", "terms")
        kept = alone if kept is None else kept.unionByName(alone)
        first = kept.groupBy("terms").agg(F.min(F.struct("round", "place", "attack")).alias("first")).select("first.*", "terms").persist()
        have = first.count()
        if have >= n_attacks:
            break
    return first.orderBy("round", "place", "attack").limit(n_attacks).select("attack", "terms")


def naive_predicates(synthetic: DataFrame, id_col: str, numeric: list[str], categorical: list[str], n_attacks: int, n_cols: int, seed: int = 42) -> DataFrame:
    """Rows (attack, terms): predicates over drawn columns, each of the value of a row drawn for it; numbers at least or at most."""
    columns = [*numeric, *categorical]
    rows = max(synthetic.count(), 1)
    number = lambda h, a, b: F.conv(F.substring(h, a, b), 16, 10).cast("long")
    hashes = [F.struct(_draw_of(F.col("_attack"), c, seed).alias("h"), F.lit(k).alias("_col")) for k, c in enumerate(columns)]
    drawn = F.slice(F.array_sort(F.array(*hashes)), F.lit(1), F.lit(min(n_cols, len(columns))))
    asks = synthetic.sparkSession.range(n_attacks).select(F.col("id").alias("_attack")).select("_attack", F.explode(drawn).alias("_d"))
    asks = asks.select("_attack", "_d._col", (number(F.col("_d.h"), 9, 12) % rows).alias("_at"), (number(F.col("_d.h"), 21, 1) % 2).alias("_side"))
    numbered = split.dense_index(synthetic.select(id_col, *columns), id_col, "_index", seed)
    met = asks.join(numbered, F.col("_at") == F.col("_index"))
    op = F.when(F.col("_side") == 0, F.lit(AT_LEAST)).otherwise(F.lit(AT_MOST))
    term = F.get(F.array(*(_term(k, F.col(c), None, c in numeric, op).cast(TERMS[6:-1]) for k, c in enumerate(columns))), F.col("_col"))
    terms = met.select("_attack", term.alias("t")).groupBy("_attack").agg(F.array_sort(F.collect_list("t")).cast(TERMS).alias("terms"))
    return terms.select(F.concat(F.lit("naive:"), F.col("_attack").cast("string")).alias("attack"), "terms")


def shown(terms: Column, names: list[str]) -> Column:
    """Terms as text: ``age >= 31.0 & sex = F``."""
    sign = F.array(*map(F.lit, (" is null", " >= ", " <= ", " = ")))
    one = lambda t: F.concat(F.get(F.array(*map(F.lit, names)), t["col"]), F.get(sign, t["op"]), F.coalesce(t["number"].cast("string"), t["text"], F.lit("")))
    return F.array_join(F.transform(terms, one), " & ")


def tally(found: DataFrame) -> DataFrame:
    """(attacks, successes) of counted predicates."""
    return found.agg(F.count("*").alias("attacks"), F.count_if(F.col("matches") == 1).alias("successes"))


def singling_out(original: DataFrame, synthetic: DataFrame, control: DataFrame | None, id_col: str, numeric: list[str], categorical: list[str], n_attacks: int = 6000, n_cols: int = 7, seed: int = 42) -> DataFrame:
    """Rows (kind, attacks, successes) of the attack, the naive baseline and, with a control table, the control attack."""
    asks = singling_predicates(synthetic, id_col, numeric, categorical, n_attacks, n_cols, seed).persist()
    naive = naive_predicates(synthetic, id_col, numeric, categorical, n_attacks, n_cols, seed)
    runs = [("main", original, asks), ("baseline", original, naive)] + [("control", control, asks)] * (control is not None)
    parts = [tally(count_matches(df, p, numeric, categorical)).select(F.lit(kind).alias("kind"), "*") for kind, df, p in runs]
    return reduce(DataFrame.unionByName, parts)
