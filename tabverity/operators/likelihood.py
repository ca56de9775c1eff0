"""Likelihood of synthetic rows under a tree-shaped Bayesian network of the real table's categories."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .quality import pair_cells

#: Log-probability of a combination that the real table doesn't have.
FLOOR = -20.0


def mutual_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, information) in nats, of each pair of columns."""
    cells = pair_cells(df, df.limit(0), list(combinations(columns, 2))).groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    x = cells.groupBy("a", "b", "x").agg(F.sum("n").alias("n_x"))
    y = cells.groupBy("a", "b", "y").agg(F.sum("n").alias("n_y"))
    total = cells.groupBy("a", "b").agg(F.sum("n").alias("all"))
    same = lambda k: F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = cells.alias("c").join(x.alias("o"), (F.col("c.a") == F.col("o.a")) & (F.col("c.b") == F.col("o.b")) & same("x")).select("c.*", "n_x")
    joined = joined.alias("c").join(y.alias("o"), (F.col("c.a") == F.col("o.a")) & (F.col("c.b") == F.col("o.b")) & same("y")).select("c.*", "n_y")
    joined = joined.join(F.broadcast(total), ["a", "b"])  # one row a pair
    return joined.groupBy("a", "b").agg(F.sum(ratio(F.col("n"), F.col("all")) * F.ln(ratio(F.col("n") * F.col("all"), F.col("n_x") * F.col("n_y")))).alias("information"))


def best_tree(information: list[tuple[str, str, float]], columns: list[str]) -> list[tuple[str, str]]:
    """Edges (parent, child) of the spanning tree with most information, from the first column on; ties by name."""
    weight = {frozenset((a, b)): i for a, b, i in information}
    inside, edges = [columns[0]], []
    while len(inside) < len(columns):
        _, parent, child = min((-weight[frozenset((p, c))], p, c) for p in inside for c in columns if c not in inside)
        edges.append((parent, child))
        inside.append(child)
    return edges


def row_log_likelihood(real: DataFrame, synthetic: DataFrame, columns: list[str], floor: float = FLOOR) -> DataFrame:
    """Synthetic rows with ``log_p`` and ``p``; an unseen combination has the floor and probability 0."""
    found = [(r["a"], r["b"], r["information"]) for r in mutual_information(real, columns).collect()]  # one row a pair
    tree = best_tree(found, columns)
    root = columns[0]
    n = real.count()
    scored = synthetic.select(*columns)
    tables = [([root], real.groupBy(root).agg((F.count("*") / max(n, 1)).alias("_p")))]
    for parent, child in tree:
        both = real.groupBy(parent, child).agg(F.count("*").alias("_n"))
        up = real.groupBy(F.col(parent).alias("_parent")).agg(F.count("*").alias("_all"))
        tables.append(([parent, child], both.join(up, F.col(parent).eqNullSafe(F.col("_parent"))).select(parent, child, ratio(F.col("_n"), F.col("_all")).alias("_p"))))
    log_p, p = F.lit(0.0), F.lit(1.0)
    for k, (keys, table) in enumerate(tables):
        named = table.select(*(F.col(c).alias(f"_t{k}_{c}") for c in keys), F.col("_p").alias(f"_p{k}"))
        on = F.lit(True)
        for c in keys:
            on = on & F.col(c).eqNullSafe(F.col(f"_t{k}_{c}"))
        scored = scored.join(named, on, "left")
        log_p, p = log_p + F.coalesce(F.ln(f"_p{k}"), F.lit(floor)), p * F.coalesce(F.col(f"_p{k}"), F.lit(0.0))
    return scored.select(*columns, log_p.alias("log_p"), p.alias("p"))


def bn_likelihood(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    return row_log_likelihood(real, synthetic, columns).agg(F.avg("p").alias("likelihood"), F.avg("log_p").alias("log_likelihood"))
