"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every benchmark item gives patterns: its windows of ``width`` consecutive words, or all its words if it has fewer.
Patterns of one length share a table of shifts, keyed by the hash of a block of words: the block under the end of
the search window tells how far the window may jump. Where it may not jump, the block selects a bucket of patterns,
and their words are compared with the text's, byte by byte.

The texts stay where they were read: no shuffle. The patterns are broadcast in blocks of at most
``PATTERN_BYTES`` of benchmark text, so that what is broadcast is bounded however large the benchmark is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import id_and_text, row_key, text_batches

WIDTH = 10
#: Most bytes of benchmark text whose patterns are searched for in one pass.
PATTERN_BYTES = 32 << 20
#: Words that one search window walks over; a longer text is walked over by several.
LANE = 512
BLOCK = 2


class PatternTable:
    """Shift table and buckets for the patterns of one length."""

    def __init__(self, length: int, patterns: dict[bytes, list[int]]) -> None:
        self.length, self.block = length, min(BLOCK, length)
        self.sequences = list(patterns)
        self.items = [patterns[s] for s in self.sequences]
        words = K.Words(self.sequences, K.ALNUM, lower=True)
        hashes = words.hashes()
        first = words.first[:-1]
        size = 1 << max(16, int(np.ceil(np.log2(8 * (len(self.sequences) * length + 1)))))
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, length - self.block + 1, dtype=np.int32)
        for end in range(self.block, length + 1):
            at = K.window_hashes(hashes, first + end - self.block, self.block) & self.mask
            np.minimum.at(self.shift, at.astype(np.int64), length - end)
        suffix = K.window_hashes(hashes, first + length - self.block, self.block)
        whole = K.window_hashes(hashes, first, length, which=2)
        order = np.lexsort((whole, suffix))
        self.suffix, self.whole, self.order = suffix[order], whole[order], order

    def find(self, words: K.Words, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of a start word and a pattern's number, for all occurrences."""
        m, b = self.length, self.block
        counts = words.per_text()
        ends_per_text = np.maximum(counts - m + 1, 0)
        lanes = -(-ends_per_text // LANE)
        lane_text = np.repeat(np.arange(len(counts)), lanes)
        if not len(lane_text):
            return
        nth = K.ragged(np.zeros(len(lanes), dtype=np.int64), lanes)
        at = words.first[lane_text] + m - 1 + nth * LANE
        stop = np.minimum(at + LANE, words.first[lane_text + 1])
        found = []
        with np.errstate(over="ignore"):
            while len(at):
                block = K.window_hashes_at(hashes, at - b + 1, b)
                jump = self.shift[(block & self.mask).astype(np.int64)]
                found.append(at[jump == 0])
                at = at + np.maximum(jump, 1)
                alive = at < stop
                at, stop = at[alive], stop[alive]
        ends = np.concatenate(found)
        if not len(ends):
            return
        starts = ends - m + 1
        suffix = K.window_hashes_at(hashes, ends - b + 1, b)
        lo, hi = np.searchsorted(self.suffix, suffix), np.searchsorted(self.suffix, suffix, side="right")
        kept = hi > lo
        starts, lo, hi = starts[kept], lo[kept], hi[kept]
        whole = K.window_hashes_at(hashes, starts, m, which=2)
        for start, h, i, j in zip(starts.tolist(), whole, lo.tolist(), hi.tolist()):
            k = i + int(np.searchsorted(self.whole[i:j], h))
            text = None
            while k < j and self.whole[k] == h:
                text = text or words.sequence(start, start + m)
                if self.sequences[self.order[k]] == text:
                    yield start, int(self.order[k])
                k += 1


def compile_patterns(texts: list[bytes], width: int = WIDTH) -> list[PatternTable]:
    """Tables for each length of pattern; the items of a pattern are places in ``texts``."""
    by_length: dict[int, dict[bytes, list[int]]] = {}
    words = K.Words(texts, K.ALNUM, lower=True)
    for k in range(len(texts)):
        i, j = int(words.first[k]), int(words.first[k + 1])
        parts = [words.word(x) for x in range(i, j)]
        n = min(width, len(parts))
        for s in {b" ".join(parts[x : x + n]) for x in range(len(parts) - n + 1)} if n else ():
            by_length.setdefault(n, {}).setdefault(s, []).append(k)
    return [PatternTable(n, p) for n, p in sorted(by_length.items())]


def search(texts: list[bytes], tables: list[PatternTable]) -> tuple[np.ndarray, list[np.ndarray], list[set[int]]]:
    """Of each text: its number of words, the words inside occurrences (places in the text), and the items found."""
    words = K.Words(texts, K.ALNUM, lower=True)
    hashes = words.hashes()
    hit = np.zeros(words.n + 1, dtype=np.int32)
    items: list[set[int]] = [set() for _ in texts]
    for table in tables:
        for start, pattern in table.find(words, hashes):
            hit[start] += 1
            hit[start + table.length] -= 1
            items[int(np.searchsorted(words.first, start, side="right")) - 1].update(table.items[pattern])
    covered = np.flatnonzero(np.cumsum(hit)[: words.n] > 0)
    cuts = np.searchsorted(covered, words.first)
    return words.per_text(), [covered[cuts[k] : cuts[k + 1]] - words.first[k] for k in range(len(texts))], items


def _benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // PATTERN_BYTES) or 1
    if blocks == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) for b in range(blocks)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Occurrences of benchmark windows in each document.

    Returns a row per row of ``docs``: doc_id, n_words, hit_words (places of the words inside occurrences, ascending),
    items (ids as strings, ascending). Null and empty texts have no words; a benchmark that is empty or has no words
    hits nothing; items repeated under one id count once; null items and items of null text are left out.
    Only the id and text columns are read, so other columns don't matter.
    """
    spark = docs.sparkSession
    parts = []
    blocks = _benchmark_blocks(benchmark, item_col, item_text_col)
    for block in blocks:
        rows = block.collect()  # at most PATTERN_BYTES
        names = [r["item"] for r in rows]
        shared = spark.sparkContext.broadcast((names, [r["text"].encode() for r in rows]))

        def scan(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, texts = shared.value
            tables = compile_patterns(texts, width)
            for (ids, keys), docs_ in text_batches(batches, ["doc_id", "row_key"]):
                n_words, hits, items = search(docs_, tables)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "row_key": pa.array(keys, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                    "hit_words": pa.array([h.tolist() for h in hits], pa.list_(pa.int64())),
                    "items": pa.array([sorted({names[x] for x in i}) for i in items], pa.list_(pa.string())),
                })

        source = id_and_text(docs, id_col, text_col).withColumn("row_key", row_key())
        parts.append(source.mapInArrow(scan, "doc_id long, row_key long, n_words long, hit_words array<long>, items array<string>"))
    if len(parts) == 1:
        return parts[0].drop("row_key")
    # Several blocks: a row of each pass for every row of docs; copies of a row are told apart by their number.
    every = reduce(DataFrame.unionByName, [p.withColumn("pass", F.lit(k)) for k, p in enumerate(parts)])
    return every.groupBy("doc_id", "row_key").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count_if(F.col("pass") == 0).alias("copies"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("row_key", "copies", "copy")


def contamination_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_contamination``'s rows."""
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of ``docs`` without any occurrence of a benchmark window; columns unchanged, null and empty texts stay.

    The search and the filter run in one pass over the texts: the rows aren't joined back.
    """
    spark = docs.sparkSession
    out = docs
    for block in _benchmark_blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast([r["text"].encode() for r in block.collect()])

        def keep(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tables = compile_patterns(shared.value, width)
            for batch in batches:
                kept: list[bool] = []
                for _, texts in text_batches([batch], []):
                    kept += [not len(h) for h in search(texts, tables)[1]]
                yield batch.filter(pa.array(kept, pa.bool_()))

        out = out.mapInArrow(keep, out.schema)
    return out


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination_sql(window: int = 10) -> str:
    """The digest in DuckDB's SQL, for tables of one row for each id."""
    words = lambda table, key: f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
    return f"""
WITH doc AS ({words("documents", "doc_id")}), item AS ({words("benchmark", "item_id")}),
pattern AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT item_id, w, least({window}, len(w)) AS n, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
place AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS p, i FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM place JOIN pattern USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
