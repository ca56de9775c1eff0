"""N-gram Jaccard join with signature trees.

Documents link when their sets of 5-word shingles have a Jaccard similarity of at least 0.75. The join is exact.

1. Documents of equal sets form a class; the class is joined once, by the fingerprint of its set.
2. Every set is put in one order, frequent shingles last, and a class is filed under the first 31 % of its set: two
   sets that link have several shingles in common there, a sixteenth of the smaller set. A class that shares fewer
   with all others together, such as one that only quotes a passage, is done. How frequent shingles are is counted
   over all documents in a fixed number of counters; any order gives the same links, this one keeps groups small.
3. Within a shingle's group, candidates are first only a star and a chain. Their links, verified on whole sets,
   already connect most copies, without listing all pairs of a group of copies.
4. All groups that hold classes of two components are searched by signature trees: a leaf is a class, a node above has
   the OR of its children's token bitmaps, their range of sizes and their range of components. A bitmap's second half
   tells where two tokens fell on one place of the first. A group of one shingle is a tree (a very large one is cut into
   blocks, the trees' upper nodes, which meet in pairs). Tasks traverse a tree against itself, or two blocks, for many
   groups at once as arrays: a pair of nodes is left when both lie in one component, when their sizes can't link, or
   when their bitmaps bound the overlap below what a link takes. Large groups are traversed for the likeliest partners
   of each class first, whose links leave fewer components. Then pairs of classes that meet often enough, under shingles
   that are early enough in both sets, are verified on whole sets.

A component is the smallest id that links reach.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import kernels as K
from .common import id_and_text, materialize, released, shuffle_partitions, text_batches
from .components import connected_components
from .substring import binary_slices, bucket_of

NGRAM = 5
#: Similarity in hundredths, as the rule is in whole numbers: 100 * overlap >= 75 * union.
PERCENT = 75
#: Counters of shingle frequency, and how many rows carry them.
COUNTERS, SLICES = 1 << 20, 16
#: 64-bit words of a class's token bitmap: half for places that have a token, half for those that have two.
BITMAP_WORDS = 32
#: Sets whose bitmaps are made at once (1 MB of counts).
SETS_AT_ONCE = 128
#: Children of a node of a signature tree, and the most classes of a block.
FANOUT, BLOCK = 16, 4096
#: Rows of groups that a task searches at once, and pairs of nodes that it compares at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 1 << 14, 1 << 16
#: Entries in a range of shingles on average, and the most that a task holds before it passes them on.
RANGE_ENTRIES, HELD_ENTRIES = 1 << 20, 1 << 21
#: Most bits of the bitmap that tells which sets are wanted (128 MB); beyond, more sets are sent than needed.
MOST_BITS = 1 << 30


def shingle_sets(texts: list[bytes], ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the cuts between texts."""
    words = K.Words(texts, ~K.SPACE, lower=True)
    hashes = words.hashes()
    starts, text = words.windows(ngram)
    found = K.window_hashes(hashes, starts, ngram, which=1) if len(starts) else np.zeros(0, dtype=np.uint64)
    counts = words.per_text()
    short = np.flatnonzero((counts > 0) & (counts < ngram))
    if len(short):
        whole = K.window_hashes(hashes, words.first[short], counts[short], which=2)
        found, text = np.concatenate([found, whole]), np.concatenate([text, short])
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.append(True, (found[1:] != found[:-1]) | (text[1:] != text[:-1]))[: len(found)]
    found, text = found[new], text[new]
    return found, np.searchsorted(text, np.arange(len(texts) + 1))


def fingerprints(found: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Fingerprint of each set: sums over two mixes of its hashes and its size; 0 for an empty set."""
    with np.errstate(over="ignore"):
        a = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(K.mix64(found + np.uint64(3)))])
        b = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(K.mix64(found * np.uint64(5) + np.uint64(9)))])
        n = np.diff(cuts).astype(np.uint64)
        mixed = K.mix64(K.mix64(a[cuts[1:]] - a[cuts[:-1]]) ^ ((b[cuts[1:]] - b[cuts[:-1]]) * np.uint64(3) + n))
    return np.where(n > 0, mixed, np.uint64(0)).astype(np.int64)


#: A set is filed under one shingle in so many more than the shortest prefix; traversals use one in so many more.
EXTRA, FEW_EXTRA = 16, 64


def least_shared(n, extra: int = EXTRA):
    """Filed shingles that two linked sets have in common at least; n: size of the smaller set (number, array or column)."""
    return n // extra + 1 if not isinstance(n, Column) else F.floor(n / extra) + 1


def least_overlap(total, percent: int):
    """Shingles that two linked sets have in common at least; total: of their sizes."""
    return -((-percent * total) // (100 + percent)) if not isinstance(total, Column) else F.ceil(percent * total / (100 + percent))


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Linked sets x, y of overlap o share at least k shingles among the first n_x - o + k and n_y - o + k in order."""
    return n - -((-percent * n) // 100) + least_shared(n)


def bitmaps(found: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Token bitmap of each set, a row of BITMAP_WORDS words; ``found`` are hashes, cut into sets by ``cuts``.

    Two sets share at most as many tokens as bits, and those beyond two at one place.
    """
    places, rows = 32 * BITMAP_WORDS, []
    at = (found % np.uint64(places)).astype(np.int64)
    for k in range(0, len(cuts) - 1, SETS_AT_ONCE):
        c = cuts[k : k + SETS_AT_ONCE + 1]
        text = np.repeat(np.arange(len(c) - 1), np.diff(c))
        counts = np.bincount(text * places + at[c[0] : c[-1]], minlength=(len(c) - 1) * places).reshape(-1, places)
        rows.append(np.packbits(np.concatenate([counts > 0, counts > 1], axis=1), axis=1).view(np.uint64))
    return np.concatenate(rows) if rows else np.zeros((0, BITMAP_WORDS), dtype=np.uint64)


def _profile(batches: Iterable[pa.RecordBatch], ngram: int) -> Iterator[pa.RecordBatch]:
    """Size, fingerprint and bitmap of each set; at the end of a task, its counts of shingles."""
    counters = np.zeros(COUNTERS, dtype=np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("bitmap", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])
    for (ids,), texts in text_batches(batches, ["doc_id"]):
        found, cuts = shingle_sets(texts, ngram)
        np.add.at(counters, (found >> np.uint64(44)).astype(np.int64), 1)  # in place: a table of all counters a batch takes more memory
        n, none = np.diff(cuts), pa.nulls(len(ids))
        bits = binary_slices(bitmaps(found, cuts).ravel(), np.arange(len(ids) + 1) * BITMAP_WORDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(fingerprints(found, cuts), pa.int64(), mask=n == 0), bits, none.cast(pa.int32()), pa.nulls(len(ids), pa.binary())], schema=schema)
    if counters.any():
        parts = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in np.split(counters, SLICES)]
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], schema=schema)


def _sum_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            got = np.frombuffer(zlib.decompress(part), dtype=np.uint32).astype(np.int64)
            total[k] = total[k] + got if k in total else got
    for k, x in total.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "sums": pa.array([x.tobytes()], pa.binary())})


def _frequent(profile: DataFrame) -> np.ndarray:
    """For each counter, whether it stands out: a shingle counted there is frequent."""
    parts = profile.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(lambda it: released(_sum_counts(it)), "slice int, sums binary")
    counts = np.zeros((SLICES, COUNTERS // SLICES))
    for row in parts.collect():  # 8 MB
        counts[row["slice"]] = np.frombuffer(row["sums"], dtype=np.int64)
    mean = counts.mean()
    return (counts > mean + 6 * np.sqrt(mean) + 64).ravel()


def in_order(found: np.ndarray, cuts: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in the common order within each text, the text of each, and its place there."""
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    last = frequent[(found >> np.uint64(44)).astype(np.int64)]
    # found is sorted within each text, so a stable sort by (text, last) keeps the order by hash
    order = np.argsort(text * 2 + last, kind="stable")
    return found[order], text, np.arange(len(found)) - cuts[text]


def _file(batches: Iterable[pa.RecordBatch], buckets: int, ngram: int, percent: int, frequent) -> Iterator[pa.RecordBatch]:
    """Every set under the first shingles of its order: packed entries by range of shingles."""
    for _, texts in text_batches(batches, []):
        found, cuts = shingle_sets(texts, ngram)
        classes = fingerprints(found, cuts)
        n = np.diff(cuts)
        _, once = np.unique(classes, return_index=True)
        alone = np.zeros(len(n), dtype=bool)
        alone[once] = n[once] > 0
        token, text, place = in_order(found, cuts, frequent.value)
        kept = (place < prefix_length(n, percent)[text]) & alone[text]
        token, text, place = token[kept], text[kept], np.minimum(place[kept], 0xFFFF)  # a smaller place loses nothing
        bucket = bucket_of(token, buckets).astype(np.int64)
        order = np.lexsort((text, bucket))
        token, text, bucket, place = token[order], text[order], bucket[order], place[order].astype(np.uint16)
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        owners = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1]))[: len(text)])
        counts = np.diff(np.append(owners, len(text))).astype(np.uint32)
        full = np.flatnonzero(np.diff(at))
        a = np.append(at[full], at[-1])
        b = np.searchsorted(bucket[owners], np.append(full, buckets))
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(full, pa.int32()), "tokens": binary_slices(token, a), "places": binary_slices(place, a),
            "classes": binary_slices(classes[text[owners]], b), "sizes": binary_slices(n[text[owners]].astype(np.uint32), b), "counts": binary_slices(counts, b),
        })


def _several(parts: list[tuple[np.ndarray, ...]], every: bool) -> pa.RecordBatch:
    """Entries once each, of shingles under which several classes are filed, or of all."""
    token, place, cls, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((cls, token))
    token, place, cls, n = token[order], place[order], cls[order], n[order]
    new = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))
    token, place, cls, n = token[new], place[new], cls[new], n[new]
    if not every:
        sizes = np.diff(np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token)))
        kept = np.repeat(sizes > 1, sizes)
        token, place, cls, n = token[kept], place[kept], cls[kept], n[kept]
    return pa.RecordBatch.from_pydict({"token": pa.array(token.view(np.int64)), "class": pa.array(cls), "n": pa.array(n.astype(np.int64)), "place": pa.array(place.astype(np.int32))})


def _groups(batches: Iterable[pa.RecordBatch], held_entries: int = HELD_ENTRIES) -> Iterator[pa.RecordBatch]:
    """Entries (token, class, n, place) of shingles under which several classes are filed; batches are sorted by bucket.

    One range of shingles is held at a time. One that holds a very frequent shingle is passed on in pieces, with
    entries that stand alone or come twice; these only weaken later bounds on how much classes share.
    """
    now, parts, held, cut = None, [], 0, False
    for batch in batches:
        # numbers are read where the batch has them
        for bucket, *row in zip(batch.column("bucket").to_pylist(), *(batch.column(c) for c in ("tokens", "places", "classes", "sizes", "counts"))):
            tokens, places, classes, sizes, counts = (x.as_buffer() for x in row)
            if parts and (bucket != now or held > held_entries):
                cut = bucket == now or cut
                yield _several(parts, cut)
                parts, held, cut = [], 0, cut and bucket == now
            now, c = bucket, np.frombuffer(counts, dtype=np.uint32)
            parts.append((np.frombuffer(tokens, dtype=np.uint64), np.frombuffer(places, dtype=np.uint16), np.repeat(np.frombuffer(classes, dtype=np.int64), c), np.repeat(np.frombuffer(sizes, dtype=np.uint32), c)))
            held += len(parts[-1][0])
    if parts:
        yield _several(parts, cut)


def _sharing_enough(groups: DataFrame, percent: int) -> DataFrame:
    """Rows of the classes that share as many filed shingles as a link takes."""
    smaller = F.ceil(F.col("n") * percent / 100)
    live = groups.groupBy("class").agg(F.count("*").alias("shared"), F.max("n").alias("n")).where(F.col("shared") >= least_shared(smaller)).select("class")
    return groups.join(live, "class", "left_semi")


def may_link(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.lit(100) * F.least(n_a, n_b) >= F.lit(percent) * F.greatest(n_a, n_b)


def _first_candidates(groups: DataFrame, percent: int) -> DataFrame:
    """A star around each group's smallest set and a chain along its sizes, as distinct pairs (a, b), a < b."""
    w = Window.partitionBy("token").orderBy("n", "class")
    before = lambda f: F.struct(f("class").over(w).alias("class"), f("n").over(w).alias("n"))
    both = groups.select("class", "n", F.array(before(F.first), before(F.lag)).alias("others"))
    pairs = both.select("class", "n", F.explode("others").alias("o")).select("class", "n", F.col("o.class").alias("other"), F.col("o.n").alias("m"))
    pairs = pairs.where(F.col("other").isNotNull() & (F.col("class") != F.col("other")) & may_link(F.col("n"), F.col("m"), percent))
    # Most pairs that link meet in many groups; those of few are left to the traversal.
    met = pairs.groupBy(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).agg(F.count("*").alias("times"), F.min(F.least("n", "m")).alias("n"))
    return met.where(F.col("times") > F.col("n") / (4 * EXTRA)).select("a", "b")


def _wanted_bits(spark: SparkSession, classes: DataFrame):
    """Bitmap of the given classes, of bounded size, as a broadcast; classes share bits, so it only leaves out the surely unwanted."""
    n = classes.count()
    bits = min(max(1 << 16, 1 << (16 * n).bit_length()), MOST_BITS)
    parts = max(8, min(64, bits >> 20))
    per = bits // parts // 8 * 8

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            h = K.mix64(batch.column("class").to_numpy().view(np.uint64))
            part = (h % np.uint64(parts)).astype(np.int64)
            at = ((h >> np.uint64(8)) % np.uint64(per)).astype(np.int64)
            for k in np.unique(part).tolist():
                have.setdefault(k, np.zeros(per, dtype=bool))[at[part == k]] = True
        for k, x in have.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(x).tobytes()], pa.binary())})

    packed = np.zeros((parts, per // 8), dtype=np.uint8)
    for row in classes.select("class").repartition(8).mapInArrow(lambda it: released(mark(it)), "part int, bits binary").toLocalIterator():
        packed[row["part"]] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast(packed)


def _wanted(classes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    h = K.mix64(classes.view(np.uint64))
    at = (h >> np.uint64(8)) % np.uint64(packed.shape[1] * 8)
    return (packed[(h % np.uint64(len(packed))).astype(np.int64), (at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _sets_of(source: DataFrame, classes: DataFrame, ngram: int) -> DataFrame:
    """Rows (class, set) of the wanted classes: sorted hashes."""
    wanted = _wanted_bits(source.sparkSession, classes)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, []):
            found, cuts = shingle_sets(texts, ngram)
            cls = fingerprints(found, cuts)
            once = np.zeros(len(cls), dtype=bool)
            once[np.unique(cls, return_index=True)[1]] = True
            kept = np.flatnonzero(once & (np.diff(cuts) > 0) & _wanted(cls, wanted.value))
            n = np.diff(cuts)[kept]
            yield pa.RecordBatch.from_pydict({"class": pa.array(cls[kept], pa.int64()), "set": binary_slices(found[K.ragged(cuts[kept], n)], np.concatenate([[0], np.cumsum(n)]))})

    sets = source.select("text").mapInArrow(build, "class long, set binary")
    return sets.join(classes, "class", "left_semi").dropDuplicates(["class"])


def _within_bounds(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose bitmaps leave room for a link."""
    q = percent / (100 + percent)
    of = lambda side: classes.select(F.col("class").alias(side), F.col("size").alias(f"n_{side}"), F.col("bitmap").alias(f"bits_{side}"))

    def bound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_bit_rows(batch.column(f"bits_{side}")) for side in "ab")
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            slack = np.minimum(n - np.bitwise_count(x).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y).sum(axis=1, dtype=np.int64))
            kept = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64) + slack >= q * (n + m) - 1e-9
            yield batch.filter(pa.array(kept)).select(["a", "b"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(lambda it: released(bound(it)), "a long, b long")


def _verify(source: DataFrame, pairs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Pairs of classes (a, b) that link, by comparing whole sets; ``pairs`` is a stored table."""
    classes = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    sets = materialize(_sets_of(source, materialize(classes, "wanted"), ngram), "sets")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    joined = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(lambda it: released(compare(it)), "a long, b long")


def _bit_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, BITMAP_WORDS)


class Tree:
    """Signature trees of many groups, level by level; ``levels[0]`` has the classes, the last one the roots.

    ``sizes`` are the classes of each group, one group after the other. A class of size n with p bits set shares at most
    n - p + common bits with another, and a link takes an overlap of q * (n_a + n_b), q = percent / (100 + percent). So
    a node's slack, the largest n - p - q * n below it, bounds what it can have beyond the bits in common.
    """

    def __init__(self, sizes: np.ndarray, component: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> None:
        self.percent, self.q = percent, percent / (100 + percent)
        slack = n * (1 - self.q) - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [{"low": n, "high": n, "c_low": component, "c_high": component, "slack": slack, "bits": bits}]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            above = -(-sizes // FANOUT)
            first = np.repeat(np.cumsum(sizes) - sizes, above) + FANOUT * K.ragged(np.zeros_like(above), above)
            self.children.append((first, np.diff(np.append(first, sizes.sum()))))
            low = self.levels[-1]
            unite = {"low": np.minimum, "high": np.maximum, "c_low": np.minimum, "c_high": np.maximum, "slack": np.maximum, "bits": np.bitwise_or}
            self.levels.append({k: f.reduceat(low[k], first, axis=0) for k, f in unite.items()})
            sizes = above
            if (sizes == 1).all():
                return

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes can hold a link between two components."""
        x = self.levels[level]
        apart = np.minimum(x["c_low"][a], x["c_low"][b]) < np.maximum(x["c_high"][a], x["c_high"][b])
        kept = np.flatnonzero(apart & (100 * x["high"][a] >= self.percent * x["low"][b]) & (100 * x["high"][b] >= self.percent * x["low"][a]))
        a, b = a[kept], b[kept]
        common = np.bitwise_count(x["bits"][a] & x["bits"][b]).sum(axis=1, dtype=np.int64)
        return kept[(common + x["slack"][a] >= self.q * x["low"][b] - 1e-9) & (common + x["slack"][b] >= self.q * x["low"][a] - 1e-9)]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of classes that may link below the pairs of roots (a, b), by traversing both trees at once."""
        todo = [(len(self.levels) - 1, a, b)]
        while todo:
            level, a, b = todo.pop()
            if not level:
                yield a, b
                continue
            first, count = self.children[level - 1]
            each = count[a] * count[b]
            ends = np.cumsum(each)
            if len(a) > 1 and ends[-1] > PAIRS_AT_ONCE:
                half = min(max(1, int(np.searchsorted(ends, ends[-1] // 2))), len(a) - 1)
                todo += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            k = K.ragged(np.zeros_like(each), each)
            below = np.repeat(count[b], each)
            x, y = np.repeat(first[a], each) + k // below, np.repeat(first[b], each) + k % below
            kept = ~np.repeat(a == b, each) | (x < y) | ((x == y) & (level > 1))
            x, y = x[kept], y[kept]
            kept = self.may_link(level - 1, x, y)
            if len(kept):
                todo.append((level - 1, x[kept], y[kept]))


def _nearest(bits: np.ndarray, n: np.ndarray, cls: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (x, y), for each x and each y the one of most common bits for its sizes and the one of the smallest class.

    Pairs of sets for which bitmaps are too full to tell are left out.
    """
    full = n > 24 * BITMAP_WORDS
    kept = np.flatnonzero(~full[x] & ~full[y])
    x, y = x[kept], y[kept]
    share = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) / (n[x] + n[y])
    kept = np.zeros(len(x), dtype=bool)
    for own, other in ((x, y), (y, x)):
        for order in (np.lexsort((-share, own)), np.lexsort((cls[other], own))):
            kept[order[np.append(True, own[order][1:] != own[order][:-1])[: len(order)]]] = True
    return x[kept], y[kept]


def _traverse(batches: Iterable[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Meetings (a, b, n, times) of classes that may link; batches are sorted by (token, i, j, side)."""
    for table in _whole_groups(batches):
        token, i, j, side = (table.column(c).to_numpy() for c in ("token", "i", "j", "side"))
        new = np.append(True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        group, tree = np.cumsum(new) - 1, np.append(True, new[1:] | (side[1:] != side[:-1]))
        at = np.flatnonzero(tree)
        cls, n, place, bits = table.column("class").to_numpy(), table.column("n").to_numpy(), table.column("place").to_numpy(), _bit_rows(table.column("bitmap"))
        trees = Tree(np.diff(np.append(at, len(token))), table.column("component").to_numpy(), n, bits, percent)
        # A tree meets itself, but for two blocks, which meet each other.
        own = group[at]
        second = np.append(False, own[1:] == own[:-1])
        alone = ~second & ~np.append(second[1:], False) & (i[at] == j[at])
        left = np.flatnonzero(np.append(second[1:], False))
        a, b = np.concatenate([np.flatnonzero(alone), left]), np.concatenate([np.flatnonzero(alone), left + 1])
        for x, y in trees.pairs(a, b):
            beyond = least_shared(np.minimum(n[x], n[y]), FEW_EXTRA) - least_overlap(n[x] + n[y], percent)
            early = (cls[x] != cls[y]) & (place[x] < n[x] + beyond) & (place[y] < n[y] + beyond)
            x, y = _nearest(bits, n, cls, x[early], y[early]) if nearest else (x[early], y[early])
            p, q, m = np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y]), np.minimum(n[x], n[y])
            order = np.lexsort((q, p))
            p, q, m = p[order], q[order], m[order]
            once = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1]))[: len(p)])
            yield pa.RecordBatch.from_pydict({"a": pa.array(p[once]), "b": pa.array(q[once]), "n": pa.array(m[once]), "times": pa.array(np.diff(np.append(once, len(p))))})


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut between groups, of about ROWS_AT_ONCE rows."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS_AT_ONCE:
            continue
        table = joined()
        keys = [table.column(c).to_numpy() for c in ("token", "i", "j")]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = [table.slice(cut)]
        if cut:
            yield table.slice(0, cut)
    if held:
        yield joined()


def tree_pairs(groups: DataFrame, percent: int = PERCENT, block: int | None = None, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of classes of two components that may link, by dual traversal of each token's signature tree.

    ``groups`` has rows (token, class, component, n, place, bitmap). A token with more than ``block`` classes has its tree cut
    into blocks by ranges of components and sizes; all pairs of blocks that may link by component and size meet.
    With ``nearest``, only the likeliest partners of each class in a group are returned.
    """
    block = block or BLOCK
    sizes = groups.groupBy("token").agg(F.count("*").alias("size"))
    usual = groups.join(sizes.where(F.col("size") <= block), "token", "left_semi").select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    large = groups.join(sizes.where(F.col("size") > block), "token")
    if not large.isEmpty():
        w = Window.partitionBy("token").orderBy("component", "n", "class")
        large = materialize(large.withColumn("block", ((F.row_number().over(w) - 1) / block).cast("int")).drop("size"), "blocks")
        nodes = large.groupBy("token", "block").agg(F.min("component").alias("c_low"), F.max("component").alias("c_high"), F.min("n").alias("low"), F.max("n").alias("high"))
        x, y = nodes.alias("x"), nodes.alias("y")
        apart = F.least("x.c_low", "y.c_low") < F.greatest("x.c_high", "y.c_high")
        fit = (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.block") <= F.col("y.block")) & apart & fit).select(F.col("x.token").alias("token"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
        met = met.select("token", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side")).withColumn("block", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
        usual = usual.unionByName(large.join(met, ["token", "block"]).drop("block"))
    dealt = usual.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "side", "component", "n")
    met = dealt.mapInArrow(lambda it: released(_traverse(it, percent, nearest)), "a long, b long, n long, times long")
    if nearest:
        return met.select("a", "b").distinct()
    met = met.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("n").alias("n"))
    return met.where(F.col("times") >= least_shared(F.col("n"), FEW_EXTRA)).select("a", "b")


def _open_groups(groups: DataFrame) -> DataFrame:
    """Rows of tokens under which two components meet, with the token's smallest set (``least``) and rows (``size``)."""
    tokens = groups.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.count("*").alias("size")).where("low < high")
    return materialize(groups.join(tokens.select("token", "least", "size"), "token"), "open")


def _candidates(open_: DataFrame, classes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of classes of two components that may still link; ``nearest``: the likeliest of large groups."""
    rest = open_.where(F.col("size") > FANOUT // 2) if nearest else _sharing_enough(open_, percent)
    # A row is of use if a set of the group is small enough for a link whose shingles begin at its place.
    n = F.col("n")
    partner = F.greatest("least", F.ceil(n * percent / 100))
    rest = rest.where(F.col("place") < n + least_shared(n, FEW_EXTRA) - least_overlap(n + partner, percent))
    return tree_pairs(rest.join(classes.select("class", "bitmap"), "class").select("token", "class", "component", "n", "place", "bitmap"), percent, nearest=nearest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of ``docs``.

    Null and empty texts, and texts without words, have no shingles and are their own component. Rows with equal
    sets link, repeated ids too; rows that share an id link by their own texts. A row with a null id links like any
    other; its component is the smallest id reached, or null if there is none. Only the id and text columns are read.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    profile = materialize(source.mapInArrow(lambda it: _profile(it, ngram), "doc_id long, n long, class long, bitmap binary, slice int, counts binary"), "profile")
    frequent = spark.sparkContext.broadcast(_frequent(profile))
    rows = profile.where("slice is null")
    entries = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-entries // RANGE_ENTRIES))
    classes = materialize(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("head"), F.min("n").alias("size"), F.first("bitmap").alias("bitmap")), "classes")

    filed = source.mapInArrow(lambda it: _file(it, buckets, ngram, percent, frequent), "bucket int, tokens binary, places binary, classes binary, sizes binary, counts binary")
    groups = materialize(filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: released(_groups(it)), "token long, class long, n long, place int"), "groups")
    groups = materialize(_sharing_enough(groups, percent), "groups")
    first = materialize(_within_bounds(_first_candidates(groups, percent), classes, percent), "first-pairs")
    links = materialize(_verify(source, first, ngram, percent), "links")
    label = connected_components(links)

    labelled = groups.join(label.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_ = _open_groups(materialize(labelled, "labelled"))
    # A group of many near copies has many links; its likeliest ones leave few components, and so few pairs, to the rest.
    for nearest in (True, False):
        more = materialize(_candidates(open_, classes, percent, nearest), "candidates")
        if more.isEmpty():
            continue
        links = materialize(links.unionByName(_verify(source, more, ngram, percent)), "links")
        label = connected_components(links)
        if nearest:  # a component is named by its smallest class
            moved = open_.drop("least", "size").join(label.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
            open_ = _open_groups(moved.withColumn("component", F.coalesce("now", "component")).drop("now"))
    named = classes.join(label, F.col("class") == F.col("node"), "left").select("class", "head", F.coalesce("component", "class").alias("component"))
    smallest = named.groupBy("component").agg(F.min("head").alias("component_id"))
    of_class = named.join(smallest, "component").select("class", "component_id")
    return rows.join(of_class, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates_sql(ngram: int = NGRAM, percent: int = PERCENT) -> str:
    """The same in DuckDB's SQL, for tables of one row for each id."""
    return f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + n - 1], ' ')) AS s FROM (SELECT doc_id, w, least({ngram}, len(w)) AS n, unnest(range(1, len(w) - least({ngram}, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size p ON a = p.doc_id JOIN size q ON b = q.doc_id WHERE 100 * c >= {percent} * (p.n + q.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS node, a AS root FROM edge UNION SELECT edge.b, reach.root FROM reach JOIN edge ON reach.node = edge.a),
least_ AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN least_ ON node = doc_id"""
