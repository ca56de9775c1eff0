"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has a bit set if more than half of its shingles' hashes have it; repeated shingles count as often
as they occur. Fingerprints that differ in few bits link, whatever texts they stand for.

Distinct fingerprints form a binary trie, read from the highest bit. The join traverses pairs of its nodes together, the
root with itself first: a pair has the bits in which its two prefixes differ, and is left once these exceed the budget.

1. The upper trie is traversed in Spark, a few levels a step: a table of node pairs is joined with the children of both
   sides, one partner for each way to spend what is left of the budget. A node with few fingerprints is a leaf of this
   part; hot regions of the trie go deeper. Node tables are written to shared storage after each step.
2. Pairs of leaves are traversed bit by bit inside tasks, as arrays of node pairs, down to single fingerprints. A task
   returns a forest of the links of each pair of leaves, which has fewer rows than the leaves, not all links.

Components of the links are joins over a table of links. A component is the smallest id in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialize, text_batches
from .components import connected_components

#: Words of a shingle, seed of their hash, bits in which linked fingerprints differ at most.
NGRAM, SEED, BUDGET = 3, 42, 2
#: Bits of a fingerprint, levels of the trie in a step of the traversal in Spark, fingerprints of a leaf at most.
BITS, STEP, LEAF = 64, 4, 4096
#: Bytes of a text that are hashed at once, and pairs of nodes that a task holds at once.
PIECE, PAIRS_AT_ONCE = 1 << 18, 1 << 18
#: A fingerprint of more than one row in so many is hot; there are fewer of them than this.
HOT_SHARE = 2000


def _pieces(text: bytes, ngram: int) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece; a piece begins with the last words of the one before."""
    kept: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # a piece ends where a word does
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
        words = text[at:end].split()  # at \x20 and \x09-\x0D
        at = end
        if words:
            yield kept + words
            kept = (kept + words)[-(ngram - 1) :] if ngram > 1 else []


def shingle_hashes(text: bytes, ngram: int = NGRAM, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a lower-cased text, piece by piece; fewer words than a shingle has are hashed whole."""
    seen = 0
    for words in _pieces(text, ngram):
        if len(words) < ngram:
            last = words
            continue
        seen += 1
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = map(slice, starts[: len(words) - ngram + 1].tolist(), ends[ngram - 1 :].tolist())
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(seed)), dtype=np.uint64, count=len(words) - ngram + 1)
    if not seen and text.strip():
        yield np.array([xxhash.xxh64_intdigest(b" ".join(last), seed)], dtype=np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, the highest bit first."""
    total = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return total


def fingerprint(text: bytes, ngram: int = NGRAM, seed: int = SEED) -> int:
    """Fingerprint of a text, of which only A-Z are lower-cased; 0 without words."""
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text.lower(), ngram, seed):
        counts += _bit_counts(hashes)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(values: Iterable[int]) -> np.ndarray:
    return np.array(list(values), dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, bits): the fingerprint as a long, one for each row of ``docs``."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), texts in text_batches(batches, ["doc_id"]):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "bits": pa.array(_signed(fingerprint(t, ngram, seed) for t in texts), pa.int64())})

    return id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "doc_id long, bits long")


def masks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(mask, its bits) of all masks with at most ``budget`` bits set."""
    return [(sum(1 << b for b in some), n) for n in range(min(budget, bits) + 1) for some in combinations(range(bits), n)]


def _children(members: DataFrame, depth: int, step: int) -> DataFrame:
    """Nodes ``step`` levels below those whose members are given (bits, node): node, parent, n."""
    child = F.shiftrightunsigned("bits", BITS - depth - step)
    return members.withColumn("child", child).groupBy(F.col("child").alias("node"), F.col("node").alias("parent")).agg(F.count("*").alias("n"))


def leaf_pairs(distinct: DataFrame, budget: int = BUDGET, leaf: int | None = None) -> list[DataFrame]:
    """Tables (x, y, spent, xs, ys) of pairs of leaves with their fingerprints, one for each depth at which pairs end.

    ``distinct`` has one row (bits) for each fingerprint. x <= y are prefixes, which differ in ``spent`` bits.
    """
    leaf = leaf or LEAF
    spark = distinct.sparkSession
    root = F.lit(0).cast("long")
    if distinct.count() <= leaf:
        members = distinct.agg(F.collect_list("bits").alias("xs"))  # of one leaf
        return [members.select(root.alias("x"), root.alias("y"), F.lit(0).alias("spent"), "xs", F.col("xs").alias("ys"))]
    live = distinct.select("bits", root.alias("node"))
    pairs = spark.range(1).select(root.alias("x"), root.alias("y"), F.lit(0).alias("spent"))
    out, depth = [], 0
    while depth < BITS:
        step = min(STEP, BITS - depth)
        nodes = materialize(_children(live, depth, step), "trie-nodes")
        spend = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(c).alias("cost")) for m, c in masks(step, budget)))
        # children of x, and for each the partners below y that the budget allows
        down = pairs.join(nodes.select(F.col("parent").alias("x"), F.col("node").alias("cx"), F.col("n").alias("nx")), "x")
        down = down.withColumn("s", F.explode(spend)).where(F.col("spent") + F.col("s.cost") <= budget)
        low = F.lit((1 << step) - 1).cast("long")
        down = down.select("cx", "nx", (F.col("x") == F.col("y")).alias("one"), (F.col("spent") + F.col("s.cost")).alias("spent"), F.shiftleft("y", step).bitwiseOR(F.col("cx").bitwiseAND(low).bitwiseXOR(F.col("s.mask"))).alias("cy"))
        down = down.join(nodes.select(F.col("node").alias("cy"), F.col("n").alias("ny")), "cy").where("not one or cx <= cy")
        depth += step
        met = materialize(down.select(F.col("cx").alias("x"), F.col("cy").alias("y"), "spent", "nx", "ny"), "trie-pairs")
        ends = (F.greatest("nx", "ny") <= leaf) if depth < BITS else F.lit(True)
        done, pairs = met.where(ends).select("x", "y", "spent"), met.where(~ends).select("x", "y", "spent")
        members = live.select("bits", F.shiftrightunsigned("bits", BITS - depth).alias("node"))
        blocks = members.join(_nodes_of(done), "node", "left_semi").groupBy("node").agg(F.collect_list("bits").alias("members"))  # of a leaf
        side = lambda c: blocks.select(F.col("node").alias(c), F.col("members").alias(f"{c}s"))
        out.append(done.join(side("x"), "x").join(side("y"), "y").select("x", "y", "spent", "xs", "ys"))
        if pairs.isEmpty():
            break
        live = materialize(members.join(_nodes_of(pairs), "node", "left_semi"), "trie-members")
    return out


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()


def trie_links(xs: np.ndarray, ys: np.ndarray | None, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints (sorted, unsigned) that differ in ``budget`` bits at most; ``ys`` None: among ``xs``, once each.

    A node is a range of a sorted array that shares its highest bits. Pairs of nodes go down a bit at a time, spend what
    they differ in, and end when one side is empty, when the budget is exceeded, or as two single fingerprints.
    """
    same, ys = ys is None, xs if ys is None else ys
    todo = [(np.array([0]), np.array([len(xs)]), np.array([0]), np.array([len(ys)]), BITS - 1)]
    while todo:
        a, b, c, d, bit = todo.pop()
        if len(a) > PAIRS_AT_ONCE:  # half of the pairs wait
            half = len(a) // 2
            todo.append((a[half:], b[half:], c[half:], d[half:], bit))
            a, b, c, d = a[:half], b[:half], c[:half], d[:half]
        # what two nodes differ in above this bit is what their first members differ in there
        single = ((b - a) * (d - c) <= 4) | (bit < 0)
        if single.any():
            s = np.flatnonzero(single)
            n = (d[s] - c[s]) * (b[s] - a[s])
            owner = np.repeat(np.arange(len(s)), n)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            width = (d[s] - c[s])[owner]
            i, j = a[s][owner] + k // width, c[s][owner] + k % width
            near = np.bitwise_count(xs[i] ^ ys[j]) <= budget
            near &= (i < j) if same else True
            yield xs[i[near]], ys[j[near]]
            a, b, c, d = a[~single], b[~single], c[~single], d[~single]
        if not len(a):
            continue
        at = np.uint64(bit)
        x_cut, y_cut = _cuts(xs, a, b, at), _cuts(ys, c, d, at)
        rows = []
        for lo, hi in (((a, x_cut), (c, y_cut)), ((a, x_cut), (y_cut, d)), ((x_cut, b), (c, y_cut)), ((x_cut, b), (y_cut, d))):
            full = (lo[0] < lo[1]) & (hi[0] < hi[1])
            if same:  # x is never behind y
                full &= lo[0] <= hi[0]
            p, q, r, s = lo[0][full], lo[1][full], hi[0][full], hi[1][full]
            spent = np.bitwise_count((xs[p] ^ ys[r]) >> at)
            rows.append([v[spent <= budget] for v in (p, q, r, s)])
        todo.append((*(np.concatenate(v) for v in zip(*rows)), bit - 1))


def _cuts(values: np.ndarray, start: np.ndarray, end: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the bit turns to 1 within ranges whose higher bits are equal."""
    first = (values[start] >> bit | np.uint64(1)) << bit
    return np.clip(np.searchsorted(values, first), start, end)


def forest(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Links that join two trees when they come; they connect what all links connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = up = parent[up]
            x = up
        return x

    left, right = [], []
    for xs, ys in pairs:
        for x, y in zip(xs.tolist(), ys.tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(x)
                right.append(y)
    return left, right


def links(distinct: DataFrame, budget: int = BUDGET, leaf: int | None = None) -> DataFrame:
    """Rows (a, b) of linked fingerprints, enough to connect all that links connect."""

    def traverse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, xs, ys in zip(*(batch.column(c) for c in ("x", "y", "xs", "ys"))):
                side = [np.sort(v.values.to_numpy().view(np.uint64)) for v in ((xs,) if x == y else (xs, ys))]
                a, b = forest(trie_links(side[0], None if x == y else side[1], budget))
                yield pa.RecordBatch.from_pydict({"a": pa.array(_signed(a), pa.int64()), "b": pa.array(_signed(b), pa.int64())})

    every = None
    for pairs in leaf_pairs(distinct, budget, leaf):
        dealt = pairs.repartition("x", "y")
        part = dealt.select("x", "y", "xs", "ys").mapInArrow(traverse, "a long, b long")
        every = part if every is None else every.unionByName(part)
    return every


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, seed: int = SEED, budget: int = BUDGET, leaf: int | None = None) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits; component_id is the smallest doc_id that links reach, itself included.
    Null, empty and wordless texts have fingerprint zero, which links like any other. Rows that repeat an id link by
    their own texts. A row with a null id links like any other; its component is the smallest id reached, or null if there
    is none. An empty table gives no rows. Only the id and text columns are read, so other columns don't matter.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, ngram, seed), "fingerprints")
    classes = materialize(rows.groupBy("bits").agg(F.min("doc_id").alias("head"), F.count("*").alias("rows")), "fingerprint-classes")
    label = connected_components(links(classes.select("bits"), budget, leaf))
    named = classes.join(label, F.col("bits") == F.col("node"), "left").select("bits", "head", "rows", F.coalesce("component", "bits").alias("component"))
    smallest = named.groupBy("component").agg(F.min("head").alias("component_id"))
    of_class = materialize(named.join(smallest, "component").select("bits", "rows", "component_id"), "fingerprint-components")
    return _with_components(rows, of_class)


def _with_components(rows: DataFrame, of_class: DataFrame) -> DataFrame:
    """Joined by fingerprint; the fewer than HOT_SHARE fingerprints that hold many rows are broadcast."""
    total = of_class.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") > total / HOT_SHARE
    hot = F.broadcast(of_class.where(is_hot).select(F.col("bits").alias("hot_bits"), F.col("component_id").alias("hot_id")))
    split = rows.join(hot, F.col("bits") == F.col("hot_bits"), "left")
    shown = F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint")
    few = split.where("hot_bits is null").select("doc_id", "bits").join(of_class.where(~is_hot).select("bits", "component_id"), "bits").select("doc_id", shown, "component_id")
    return few.unionByName(split.where("hot_bits is not null").select("doc_id", shown, F.col("hot_id").alias("component_id")))
