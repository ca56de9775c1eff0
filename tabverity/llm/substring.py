"""Substring dedup by difference-cover anchors.

A window is ``width`` consecutive words. A word goes if it lies in a window whose words also start in a document with
a smaller id. Comparing all windows would shuffle every window of the corpus; anchors cut that down:

* The places 0, 1 and 3 modulo 7 are a difference cover: for any two places there is a step d < 7 that moves both
  onto cover places. So two equal windows share an equal anchor, a window of ``width - 6`` words at a cover place of
  both texts, whatever their offsets.
* Pass 1 hashes anchors at cover places only (3 of 7) and finds, by range of hashes, those that occur twice.
* They are marked in a Bloom filter of bounded size. Marks shared by chance only add candidates.
* Pass 2 extends: windows around a marked anchor are candidates; of each distinct candidate the smallest id is kept.
* Pass 3 tells that document which windows it owns. A document's candidates that it does not own are removed.

What tasks exchange are packed arrays, one row for a batch of texts and a range of hashes; equal hashes of a batch are
sent once, so that a passage shared by a third of all documents costs one entry a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import id_and_text, materialize, shuffle_partitions, text_batches

WIDTH = 13
PERIOD, COVER = 7, (0, 1, 3)
#: Most bits of the filter of repeated anchors (128 MB); beyond, more windows are sent and the result is the same.
MOST_BITS = 1 << 30
#: Characters of text whose windows make a range of hashes on average: what a task holds at once doesn't grow with the corpus.
BUCKET_CHARS = 1 << 26
#: Bits for a repeated anchor, and marks that each makes.
BITS_EACH, MARKS = 16, 3
#: Stands for a null id, which is never the smaller one.
NO_ID = np.iinfo(np.int64).max


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def binary_slices(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary array whose items are ``values[cuts[i]:cuts[i + 1]]``."""
    offsets = (np.asarray(cuts) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def anchors(words: K.Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start word and text of every anchor: cover places of all texts long enough for a window."""
    short = width - PERIOD + 1
    starts, text = words.windows(short)
    place = starts - words.first[text]
    cover = np.isin(place % PERIOD, COVER) & (words.per_text()[text] >= width)
    starts, text = starts[cover], text[cover]
    return K.window_hashes(hashes, starts, short, which=1), starts, text


def _send_anchors(batches: Iterable[pa.RecordBatch], buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    for _, texts in text_batches(batches, []):
        words = K.Words(texts, ~K.SPACE, lower=False)
        found, counts = np.unique(anchors(words, words.hashes(), width)[0], return_counts=True)
        found = np.repeat(found, np.minimum(counts, 2))  # sorted, and so by bucket
        cuts = np.searchsorted(bucket_of(found, buckets), np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "low": binary_slices(found.astype(np.uint32), np.append(cuts[full], cuts[-1]))})


def _by_key(batches: Iterable[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one key after the other, of batches that are sorted by it: a task holds one key's rows."""
    now, rows = None, []
    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *columns))):
            if rows and k != now:
                yield now, rows
                rows = []
            now = k
            rows.append(tuple(row))
    if rows:
        yield now, rows


def _repeated_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _by_key(batches, "bucket", ["low"]):
        parts = [np.frombuffer(low, dtype=np.uint32) for (low,) in rows]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        values = values[counts > 1]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(values)], pa.int64()), "low": pa.array([values.tobytes()], pa.binary())})


def _mark_places(low: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(MARKS):
        yield (K.mix64(low.astype(np.uint64) + np.uint64(k << 32)) % np.uint64(bits)).astype(np.int64)


def _marks(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, low in zip(batch.column("bucket").to_pylist(), batch.column("low").to_pylist()):
            marked = np.zeros(bits, dtype=bool)
            for place in _mark_places(np.frombuffer(low, dtype=np.uint32), bits):
                marked[place] = True
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(marked).tobytes()], pa.binary())})


class Marked:
    """Filter of repeated anchors; ``bits`` for each bucket."""

    def __init__(self, packed: np.ndarray, bits: int, buckets: int) -> None:
        self.packed, self.bits, self.buckets = packed, bits, buckets

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        base = bucket_of(hashes, self.buckets).astype(np.int64) * self.bits
        found = np.ones(len(hashes), dtype=bool)
        for place in _mark_places(hashes.astype(np.uint32), self.bits):
            at = base + place
            found &= (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return found


def candidates(words: K.Words, hashes: np.ndarray, marked: Marked, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, start word and text of the windows around marked anchors, ascending by start."""
    anchor, starts, text = anchors(words, hashes, width)
    kept = marked(anchor)
    starts, text = starts[kept], text[kept]
    edge = np.zeros(words.n + 2, dtype=np.int32)
    np.add.at(edge, np.maximum(starts - PERIOD + 1, words.first[text]), 1)
    np.add.at(edge, np.minimum(starts, words.first[text + 1] - width) + 1, -1)
    at = np.flatnonzero(np.cumsum(edge) > 0)
    return K.window_hashes(hashes, at, width, which=2), K.window_hashes(hashes, at, width, which=3).astype(np.uint32), at, np.searchsorted(words.first, at, side="right") - 1


def _send_windows(batches: Iterable[pa.RecordBatch], buckets: int, width: int, shared) -> Iterator[pa.RecordBatch]:
    marked = Marked(*shared.value)
    for (ids,), texts in text_batches(batches, ["doc_id"]):
        words = K.Words(texts, ~K.SPACE, lower=False)
        h, h2, _, text = candidates(words, words.hashes(), marked, width)
        doc = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)[text]
        order = np.lexsort((doc, h2, h))
        h, h2, doc = h[order], h2[order], doc[order]
        new = np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))[: len(h)]
        h, h2, doc = h[new], h2[new], doc[new]
        bucket = bucket_of(h, buckets).astype(np.int64)
        order = np.lexsort((doc, bucket))
        h, h2, doc, bucket = h[order], h2[order], doc[order], bucket[order]
        owners = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1]))[: len(doc)])
        counts = np.diff(np.append(owners, len(doc))).astype(np.uint32)
        cuts, owner_cuts = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(bucket[owners], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        a, b = np.append(cuts[full], cuts[-1]), np.append(owner_cuts[full], owner_cuts[-1])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "h": binary_slices(h, a), "h2": binary_slices(h2, a), "docs": binary_slices(doc[owners], b), "counts": binary_slices(counts, b)})


def _by_owner(owner: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in the order of their owners, the owners, and where each one's windows start."""
    order = np.argsort(owner, kind="stable")
    owner, windows = owner[order], windows[order]
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    return windows, owner[at], np.append(at, len(owner))


def _owners(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Bundles of windows for ranges of owners."""
    for _, rows in _by_key(batches, "bucket", ["h", "h2", "docs", "counts"]):
        parts = [(np.frombuffer(h, dtype=np.uint64), np.frombuffer(h2, dtype=np.uint32), np.repeat(np.frombuffer(docs, dtype=np.int64), np.frombuffer(counts, dtype=np.uint32))) for h, h2, docs, counts in rows]
        h, h2, doc = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, h2, h))
        h, h2, doc = h[order], h2[order], doc[order]
        first = np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))
        h, doc = h[first], doc[first]
        group = bucket_of(K.mix64(doc.astype(np.uint64)), buckets).astype(np.int64)
        order = np.argsort(group, kind="stable")
        h, doc, cuts = h[order], doc[order], np.searchsorted(group[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        for k in full.tolist():
            windows, owner, at = _by_owner(doc[cuts[k] : cuts[k + 1]], h[cuts[k] : cuts[k + 1]])
            yield pa.RecordBatch.from_pydict({"group": pa.array([k], pa.int32()), "owners": pa.array([owner.tobytes()], pa.binary()), "counts": pa.array([np.diff(at).astype(np.uint32).tobytes()], pa.binary()), "windows": pa.array([windows.tobytes()], pa.binary())})


def _gather_owned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each owner with all its windows, from the bundles of one group after another."""
    for _, rows in _by_key(batches, "group", ["owners", "counts", "windows"]):
        parts = [(np.repeat(np.frombuffer(owners, dtype=np.int64), np.frombuffer(counts, dtype=np.uint32)), np.frombuffer(windows, dtype=np.uint64)) for owners, counts, windows in rows]
        windows, owner, at = _by_owner(*(np.concatenate(x) for x in zip(*parts)))
        for k in range(0, len(owner), 5000):
            yield pa.RecordBatch.from_pydict({"owner": pa.array(owner[k : k + 5000], pa.int64()), "owned": binary_slices(windows, at[k : k + 5001])})


def _kept(batches: Iterable[pa.RecordBatch], width: int, shared) -> Iterator[pa.RecordBatch]:
    marked = Marked(*shared.value)
    for (ids, owned), texts in text_batches(batches, ["doc_id", "owned"]):
        words = K.Words(texts, ~K.SPACE, lower=False)
        h, _, at, text = candidates(words, words.hashes(), marked, width)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        removed: list[np.ndarray] = []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[k], cuts[k + 1]
            own = np.frombuffer(owned[k] or b"", dtype=np.uint64)
            removed.append(at[a:b][~np.isin(h[a:b], own)])
        edge = np.zeros(words.n + width + 1, dtype=np.int32)
        if removed:
            gone = np.concatenate(removed)
            edge[gone] += 1
            edge[gone + width] -= 1
        gone = np.cumsum(edge)[: words.n] > 0
        before = np.concatenate([[0], np.cumsum(gone)])[words.first]
        n_removed = np.diff(before)
        out = []
        for k, text_ in enumerate(texts):
            parts = text_.split()
            if n_removed[k]:
                mask = gone[words.first[k] : words.first[k + 1]].tolist()
                parts = [p for p, g in zip(parts, mask) if not g]
            out.append(b" ".join(parts))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "kept": pa.array(out, pa.binary()), "n_words": pa.array(words.per_text(), pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, kept_text, n_words, n_removed), one per row of ``docs``: the words that stay, joined by a space.

    Null and empty texts have no words; an empty table gives no rows. Rows that share an id never remove each other's
    words. A null id counts as larger than all others, and two null ids as the same. Only the id and text columns
    are read.
    """
    spark = docs.sparkSession
    if width < PERIOD:
        raise ValueError(f"width is at least {PERIOD}")
    source = id_and_text(docs, id_col, text_col)
    characters = source.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-characters // BUCKET_CHARS))
    sent = source.select("text").mapInArrow(lambda it: _send_anchors(it, buckets, width), "bucket int, low binary")
    repeated = materialize(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated_anchors, "bucket int, n long, low binary"), "anchors")
    n = repeated.agg(F.sum("n")).first()[0] or 0
    bits = min(max(1 << 10, 1 << (BITS_EACH * n // buckets).bit_length()), MOST_BITS // buckets) // 8 * 8
    packed = np.zeros(buckets * bits // 8, dtype=np.uint8)
    for row in repeated.mapInArrow(lambda it: _marks(it, bits), "bucket int, bits binary").toLocalIterator():
        packed[row["bucket"] * bits // 8 : (row["bucket"] + 1) * bits // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    shared = spark.sparkContext.broadcast((packed, bits, buckets))
    windows = source.mapInArrow(lambda it: _send_windows(it, buckets, width, shared), "bucket int, h binary, h2 binary, docs binary, counts binary")
    bundles = windows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _owners(it, buckets), "group int, owners binary, counts binary, windows binary")
    owned = bundles.repartition(buckets, "group").sortWithinPartitions("group").mapInArrow(_gather_owned, "owner long, owned binary")  # a row for each owner
    joined = source.join(owned, F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("owner"), "left").select("doc_id", "text", "owned")
    return joined.mapInArrow(lambda it: _kept(it, width, shared), "doc_id long, kept binary, n_words long, n_removed long").select("doc_id", F.col("kept").cast("string").alias("kept_text"), "n_words", "n_removed")


def repeats_digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def repeats_sql(width: int = WIDTH) -> str:
    """The digest in DuckDB's SQL, for tables of one row for each id."""
    return f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM doc WHERE len(w) >= {width})),
owner AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT doc_id, i FROM win JOIN owner USING (h) WHERE doc_id > d),
marked AS (SELECT w.doc_id, w.i, w.word, count(g.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) > 0 AS out FROM word w LEFT JOIN gone g USING (doc_id, i)),
done AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (out) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT out), '') AS kept FROM marked GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN done USING (doc_id)"""
