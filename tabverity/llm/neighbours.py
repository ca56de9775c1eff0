"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node of the graph with many members, so that copies don't crowd out other neighbours. The first
graph joins each node to its nearest in a few random partitions, whose parts have a bounded size. Each round of NN-descent then is two
Spark joins: every node gathers the vectors of a bounded number of its neighbours, both ways round; all pairs among
them are compared there, and each node keeps its nearest; rounds end when few edges change. Nodes that have too few
neighbours then (alone in their parts, or in small closed groups) are searched like queries and linked both ways round,
and nodes that nobody has as a neighbour are linked to by their nearest.
Queries start at the nearest of a fixed number of entry nodes, and at their own node, and, for all queries at once,
expand their nearest unexpanded nodes along the graph until nothing nearer turns up. The graph and the search use single
precision; what a search found is measured again, and ranked, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize

#: Neighbours of a node in the graph.
DEGREE = 48
#: Nearest neighbours, and nodes that have it as a neighbour, that a node gathers in a round.
GATHER = 24
#: Rounds at most, and the share of changed edges under which they end.
ROUNDS, FEW_CHANGES = 20, 0.03
#: First partitions, the most nodes in one part of them, and the edges that a node gets in one.
PARTITIONS, PART_NODES, PART_DEGREE = 20, 1024, 12
#: Rows kept while a query is searched, nodes it expands in a round, and rounds at most.
BEAM, EXPAND, SEARCH_ROUNDS = 96, 24, 40
#: Nodes among which every query finds entries, and how many of them it starts from (k + 1 at least).
ENTRIES, STARTS = 2048, 16
#: Nearest neighbours of a searched node that link back to it.
LINKS_BACK = 4
SEED = 17


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as packed doubles; -0.0 counts as 0.0."""
    for batch in batches:
        rows = [(np.asarray(v.as_py(), dtype=np.float64) + 0.0).tobytes() for v in batch.column("vector")]
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "vector": pa.array(rows, pa.binary())})


def _matrix(vectors: Iterable[bytes], dtype: type = np.float32) -> np.ndarray:
    rows = list(vectors)
    return np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), -1)


def single(df: DataFrame, column: str) -> DataFrame:
    """Packed doubles of a column in single precision."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(v.as_py(), dtype=np.float64).astype(np.float32).tobytes() for v in batch.column(column)]
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(packed, pa.binary()))

    return df.mapInArrow(run, df.schema)


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows; of a row with itself infinite."""
    norms = (x * x).sum(axis=1)
    d = np.maximum(norms[:, None] + norms[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    return d


def _nearest_within(ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of each row of a part among the others of the part."""
    d = _squares(x)
    k = min(k, len(ids) - 1)
    if k < 1:
        return pd.DataFrame({"node": [], "other": [], "d": []})
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    return pd.DataFrame({"node": np.repeat(ids, k), "other": ids[near].ravel(), "d": np.take_along_axis(d, near, axis=1).ravel().astype(np.float64)})


def _keep_nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node; ``fresh`` tells the edges that no earlier graph had."""
    w = Window.partitionBy("node").orderBy("d", "other")
    once = edges.groupBy("node", "other").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


EDGE = "node long, other long, d double"


def _first_graph(nodes: DataFrame, n: int, dim: int) -> DataFrame:
    """Neighbours within random partitions: sides of random hyperplanes, split further until parts are small."""
    depth = max(0, round(np.log2(max(n, 1) / PART_NODES)))
    # Few parts hold more of a node's neighbours each, and one part all of them.
    trees, degree = (PARTITIONS, max(PART_DEGREE, DEGREE >> depth)) if depth else (1, DEGREE)
    planes = np.random.default_rng(SEED).standard_normal((PARTITIONS, max(depth, 1), dim), dtype=np.float32)

    def sides(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(v.as_py() for v in batch.column("vector"))
            for t in range(trees):
                bits = (x @ planes[t].T > 0)[:, :depth] if depth else np.zeros((len(x), 0), dtype=bool)
                part = (bits * (1 << np.arange(depth, dtype=np.int64))).sum(axis=1)
                yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "vector": batch.column("vector"), "tree": pa.array(np.full(len(x), t), pa.int32()), "part": pa.array(part, pa.int64())})

    sided = nodes.mapInArrow(sides, "node long, vector binary, tree int, part long")
    sizes = sided.groupBy("tree", "part").agg(F.count("*").alias("size"))
    pieces = sided.join(sizes, ["tree", "part"]).withColumn("piece", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("size") / PART_NODES)))

    def near(group: pd.DataFrame) -> pd.DataFrame:
        return _nearest_within(group["node"].to_numpy(), _matrix(group["vector"]), degree)

    return _keep_nearest(pieces.select("tree", "part", "piece", "node", "vector").groupBy("tree", "part", "piece").applyInPandas(near, EDGE).withColumn("fresh", F.lit(True)), DEGREE)


def _descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round: neighbours of neighbours, met at the node between them."""
    forward = graph.where(F.col("rank") <= GATHER).select(F.col("node").alias("at"), F.col("other").alias("member"))
    # Of the nodes that have it as a neighbour a node gathers the nearest; a popular node has many, so they are ranked.
    w = Window.partitionBy("other").orderBy("d", "node")
    backward = graph.withColumn("back", F.row_number().over(w)).where(F.col("back") <= GATHER).select(F.col("other").alias("at"), F.col("node").alias("member"))
    own = nodes.select(F.col("node").alias("at"), F.col("node").alias("member"))
    known = nodes.join(graph.groupBy("node").agg(F.when(F.count("*") >= DEGREE, F.max("d")).alias("worst")), "node", "left").withColumnRenamed("node", "member")
    met = forward.unionByName(backward).unionByName(own).distinct().join(known, "member")
    # At most 2 * GATHER + 1 members meet at a node.
    groups = met.groupBy("at").agg(F.collect_list(F.struct("member", F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "vector")).alias("met"))
    return _keep_nearest(graph.select("node", "other", "d", F.lit(False).alias("fresh")).unionByName(groups.select("met").mapInArrow(_compare, EDGE).withColumn("fresh", F.lit(True))), DEGREE)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that met at a node and are nearer than the worst neighbour that the first of them has."""
    for batch in batches:
        met = batch.column("met")
        cuts, values = met.offsets.to_numpy() - met.offsets[0].as_py(), met.flatten()
        ids, worst = values.field("member").to_numpy(), values.field("worst").to_numpy()
        x = _matrix(values.field("vector").to_pylist())
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            d = _squares(x[a:b])
            i, j = np.nonzero(d < worst[a:b, None])
            kept = ids[a + i] != ids[a + j]
            i, j = i[kept], j[kept]
            out.append((ids[a + i], ids[a + j], d[i, j]))
        node, other, d = (np.concatenate(c) for c in zip(*out)) if out else ([], [], [])
        yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64()), "d": pa.array(np.asarray(d, dtype=np.float64))})


def build_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (node, other, d, rank): the DEGREE nearest found of each node, squared distances; ``nodes`` has node, vector (single precision).

    Every node has DEGREE edges, or one to each other node; LINKS_BACK edges to the nodes that needed a search come on top.
    """
    n = nodes.count()
    if not n:
        return nodes.select("node", F.col("node").alias("other"), F.lit(0.0).alias("d"), F.lit(1).alias("rank"))
    dim = len(nodes.first()["vector"]) // 4
    graph = materialize(_first_graph(nodes, n, dim), "graph")
    for _ in range(rounds):
        graph = materialize(_descend(graph, nodes), "graph")
        if (graph.agg(F.avg(F.col("fresh").cast("int"))).first()[0] or 0) < FEW_CHANGES:
            break
    return _link_back(_link_lost(graph.select("node", "other", "d", "rank"), nodes, n))


def _link_back(graph: DataFrame) -> DataFrame:
    """With edges to the nodes that no edge leads to, from their nearest neighbours, so that searches reach them."""
    reached = graph.select(F.col("other").alias("node")).distinct()
    back = graph.where(F.col("rank") <= LINKS_BACK).join(reached, "node", "left_anti").select(F.col("other").alias("node"), F.col("node").alias("other"), "d", "rank")
    return materialize(graph.unionByName(back), "graph")


def _link_lost(graph: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Edges for the nodes that have under DEGREE: their nearest found by a search, and links back from some of them."""
    want = min(DEGREE, n - 1)
    full = graph.groupBy("node").agg(F.count("*").alias("edges")).where(F.col("edges") >= want)
    lost = materialize(nodes.join(full, "node", "left_anti").select(F.col("node").alias("query"), F.col("vector").alias("q_vector")), "lost-nodes")
    if want < 1 or lost.isEmpty():
        return graph
    # The entries they start from are DEGREE others at least.
    found = _search(lost, _entries(lost, nodes, want + 1), nodes, graph, want).where(F.col("query") != F.col("node"))
    found = found.select(F.col("query").alias("node"), F.col("node").alias("other"), (F.col("d") * F.col("d")).alias("d"))
    own = graph.join(lost.select(F.col("query").alias("node")), "node", "left_semi").select("node", "other", "d")
    new = _keep_nearest(found.unionByName(own).withColumn("fresh", F.lit(True)), DEGREE).select("node", "other", "d", "rank")
    new = materialize(new, "lost-edges")
    back = new.where(F.col("rank") <= LINKS_BACK).select(F.col("other").alias("node"), F.col("node").alias("other"), "d", "rank")
    kept = graph.join(lost.select(F.col("query").alias("node")), "node", "left_anti")
    return materialize(kept.unionByName(new).unionByName(back).dropDuplicates(["node", "other"]), "graph")


def _entries(queries: DataFrame, nodes: DataFrame, starts: int) -> DataFrame:
    """Rows (query, node): the nearest of a fixed number of nodes for each query; ``queries`` has query, q_vector."""
    picked = nodes.orderBy(F.xxhash64("node"), "node").limit(max(ENTRIES, starts)).collect()  # a fixed number
    if not picked:
        return nodes.select(F.col("node").alias("query"), "node")
    ids, y = np.array([r["node"] for r in picked], dtype=np.int64), _matrix(bytes(r["vector"]) for r in picked)
    starts, norms = min(starts, len(ids)), (y * y).sum(axis=1)

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                d = norms[None, :] - 2 * _matrix(v.as_py() for v in part.column("q_vector")) @ y.T
                near = np.argpartition(d, starts - 1, axis=1)[:, :starts]
                yield pa.RecordBatch.from_pydict({"query": pa.array(np.repeat(part.column("query").to_numpy(), starts), pa.int64()), "node": pa.array(ids[near].ravel(), pa.int64())})

    return queries.select("query", "q_vector").mapInArrow(start, "query long, node long")


def _distances(batches: Iterable[pa.RecordBatch], dtype: type) -> Iterator[pa.RecordBatch]:
    """Distance of a query's vector and a node's, component by component."""
    for batch in batches:
        if batch.num_rows:
            diff = _matrix((v.as_py() for v in batch.column("q_vector")), dtype) - _matrix((v.as_py() for v in batch.column("vector")), dtype)
            d = np.sqrt((diff * diff).sum(axis=1)).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"query": batch.column("query"), "node": batch.column("node"), "d": pa.array(d)})


def _measure(pairs: DataFrame, queries: DataFrame, nodes: DataFrame, dtype: type = np.float32) -> DataFrame:
    """Rows (query, node, d) for pairs (query, node)."""
    joined = pairs.select("query", "node").join(nodes.select("node", "vector"), "node").join(queries.select("query", "q_vector"), "query")
    return joined.select("query", "node", "q_vector", "vector").mapInArrow(lambda it: _distances(it, dtype), "query long, node long, d double")


def _search(queries: DataFrame, entries: DataFrame, nodes: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Rows (query, node, d): the BEAM nearest nodes found of each query."""
    beam = _measure(entries, queries, nodes).withColumn("done", F.lit(False))
    links = graph.select("node", F.col("other").alias("next"))
    best = Window.partitionBy("query").orderBy("d", "node")
    beam = materialize(beam, "beam")
    for _ in range(SEARCH_ROUNDS):
        waiting = beam.where(~F.col("done"))
        chosen = waiting.withColumn("r", F.row_number().over(best)).where(F.col("r") <= EXPAND).select("query", "node")
        reached = chosen.join(links, "node").select("query", F.col("next").alias("node")).distinct().join(beam.select("query", "node"), ["query", "node"], "left_anti")
        seen = beam.join(chosen.withColumn("now", F.lit(True)), ["query", "node"], "left").select("query", "node", "d", (F.col("done") | F.col("now").isNotNull()).alias("done"))
        both = seen.unionByName(_measure(reached, queries, nodes).withColumn("done", F.lit(False)))
        beam = materialize(both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= max(BEAM, 2 * k)).drop("r"), "beam")
        if beam.where(~F.col("done")).isEmpty():
            break
    return beam.select("query", "node", "d")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows found of each query row: (query_id, rank, vec_id, score), Euclidean distance.

    ``queries`` are rows of the same shape as ``vectors``; a row is never its own neighbour (ids are compared). Ties go
    to the smaller id. Rows with a null id and vectors that are null, zero or hold null or non-finite components take
    no part on either side, nor do vectors of another length than the most frequent one (of several, the longest). An
    id that is repeated with other vectors is one candidate, as near as its nearest vector, and one query, by its
    smallest vector (bytes compared). A query has fewer than k rows only if there are fewer candidates. Only the id and
    vector columns are read.
    """

    def packed(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        return rows.mapInArrow(pack, "vec_id long, vector binary").dropDuplicates(["vec_id", "vector"])

    rows = materialize(packed(vectors).withColumn("h", F.xxhash64("vector")), "vectors")
    lengths = rows.groupBy(F.length("vector").alias("bytes")).agg(F.count("*").alias("n"))
    usual = lengths.agg(F.max_by("bytes", F.struct("n", "bytes"))).first()[0] or 0
    rows = rows.where(F.length("vector") == usual)
    # A node for each distinct vector, named by its hash.
    nodes = materialize(rows.select(F.col("h").alias("node"), "vector").dropDuplicates(["node"]), "nodes")
    plain = materialize(single(nodes, "vector"), "nodes")
    graph = build_graph(plain)
    asked = packed(queries).where(F.length("vector") == usual).groupBy(F.col("vec_id").alias("query")).agg(F.min("vector").alias("q_vector"))
    asked = materialize(asked.withColumn("h", F.xxhash64("q_vector")), "queries")
    same = asked.join(nodes, (F.col("h") == F.col("node")) & (F.col("q_vector") == F.col("vector"))).select("query", "node")
    light = materialize(single(asked.select("query", "q_vector"), "q_vector"), "queries")
    starts = _entries(light, plain, max(STARTS, k + 1)).unionByName(same).distinct()
    found = _measure(_search(light, starts, plain, graph, k), asked, nodes, np.float64)
    return _expand(found, rows, nodes, k)


def _expand(found: DataFrame, rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Members of the nodes found: of each node its k + 1 smallest ids can be among a query's k nearest."""
    # A vector may be shared by a third of all rows: its members are cut down in salted groups first.
    known = nodes.select("node", F.col("vector").alias("n_vector"))
    named = rows.join(known, (F.col("h") == F.col("node")) & (F.col("vector") == F.col("n_vector"))).select("node", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    few = named
    for keys in (["node", "salt"], ["node"]):
        few = few.withColumn("m", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("m") <= k + 1)
    near = found.join(few.select("node", "vec_id"), "node").where(F.col("query") != F.col("vec_id")).groupBy("query", "vec_id").agg(F.min("d").alias("d"))
    w = Window.partitionBy("query").orderBy("d", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", F.col("d").alias("score"))
