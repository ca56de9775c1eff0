"""Synthesizers: a protocol, a Gaussian copula, and random-forest density estimation with its sampling."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.scalars import ratio
from ..sources.tables import written
from . import prefix
from .profile import exact_quantiles

#: Points of each marginal distribution that the copula keeps.
GRID = 200


class Synthesizer(Protocol):
    """What a synthesizer offers; users bring their own."""

    name: str

    def fit(self, df: DataFrame) -> None: ...

    def generate(self, rows: int, conditions: dict[object, int] | None = None) -> DataFrame: ...


class Identity:
    """Returns rows of the table it was fitted on: known answers for all metrics."""

    name = "identity"

    def fit(self, df: DataFrame) -> None:
        self.df = df

    def generate(self, rows: int, conditions: dict[object, int] | None = None) -> DataFrame:
        """The first rows; conditions aren't known here."""
        if conditions:
            raise ValueError("this synthesizer has no target that conditions could be on")
        return self.df.limit(rows)


def null_rates(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Share of null or NaN rows of each column."""
    missing = lambda c: F.col(c).cast("double").isNull() | F.isnan(F.col(c).cast("double"))
    found = df.agg(F.lit(0), *(F.avg(missing(c).cast("int")).alias(c) for c in columns)).first()
    return {c: found[c] or 0.0 for c in columns}


def asked_rows(spark: SparkSession, rows: int, conditions: dict[object, int] | None) -> tuple[DataFrame, list]:
    """Rows (row_id, class): numbers from 0, and with conditions the place of the class that each row has; and the classes."""
    if not conditions:
        return spark.range(rows).select(F.col("id").alias("row_id"), F.lit(0).alias("class")), [None]
    classes = [c for c, n in conditions.items() if n > 0]
    ends = np.cumsum([conditions[c] for c in classes]).tolist()
    place = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= F.col("id")))
    return spark.range(ends[-1] if ends else 0).select(F.col("id").alias("row_id"), place.alias("class")), classes


def again_null(value: Column, rate: float, stream: int, seed: int) -> Column:
    """The value, or null in the share ``rate`` of rows, drawn from a stream of its own."""
    return F.when(draws.uniform(F.col("row_id"), stream, seed) >= rate, value) if rate else value


class GaussianCopula:
    """Marginals as exact quantile grids and level shares, dependence as the correlation of normal scores.

    Numeric columns are numbers; all others are levels, ordered by name, that share 0..1 by frequency; null is the last
    level. Fitting aggregates the whole table: nulls of numeric columns count as the median in the correlation, and as
    many are drawn as the column has. Sampling draws correlated normals in Spark tasks; a row's draws depend on its number
    alone. Rows of a class are drawn as such: the target's score from the class's interval, the others given that score.
    """

    name = "gaussian_copula"

    def __init__(self, numeric: list[str], categorical: list[str], seed: int = 42, target: str | None = None) -> None:
        self.numeric, self.categorical, self.seed, self.target = numeric, categorical, seed, target

    def fit(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        grids = exact_quantiles(df, self.numeric, [k / GRID for k in range(GRID + 1)]) if self.numeric else {}
        self.grids = {c: np.asarray(grids[c], dtype=float) if grids[c] else np.zeros(GRID + 1) for c in self.numeric}
        self.null_rates = null_rates(df, self.numeric)
        self.levels = {}
        for c in self.categorical:
            rows = df.groupBy(c).count().orderBy(F.col(c).asc_nulls_last()).collect()  # one row a level
            n = np.array([r["count"] for r in rows], dtype=float)
            self.levels[c] = ([r[0] for r in rows], np.concatenate([[0], np.cumsum(n) / n.sum()]))
        scores = self._scores(df)
        vectors = VectorAssembler(inputCols=[*self.numeric, *self.categorical], outputCol="v").transform(scores)
        r = np.nan_to_num(Correlation.corr(vectors, "v").head()[0].toArray())
        np.fill_diagonal(r, 1.0)
        values, axes = np.linalg.eigh(r)
        self.factor = axes * np.sqrt(np.maximum(values, 1e-9))

    def _scores(self, df: DataFrame) -> DataFrame:
        grids, levels, numeric, categorical, seed = self.grids, self.levels, self.numeric, self.categorical, self.seed
        names = [*numeric, *categorical]

        def score(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = {}
                for c in numeric:
                    x = batch[c].to_numpy(dtype=float)
                    x = np.where(np.isnan(x), grids[c][GRID // 2], x)
                    u = (np.searchsorted(grids[c], x, side="left") + np.searchsorted(grids[c], x, side="right")) / 2 / (GRID + 1)
                    out[c] = draws.quantile(np.clip(u, 1e-3, 1 - 1e-3))
                for c in categorical:
                    known, edges = levels[c]
                    at = pd.Categorical(batch[c], categories=[x for x in known if x is not None]).codes
                    at = np.where(at < 0, len(known) - 1, at)  # null is the last level
                    u = edges[at] + batch[f"_u_{c}"].to_numpy() * (edges[np.minimum(at + 1, len(known))] - edges[at])
                    out[c] = draws.quantile(np.clip(u, 1e-3, 1 - 1e-3))
                yield pd.DataFrame(out)

        # a level's place in its interval is drawn by the row's values
        placed = df.select(*names, *(draws.uniform(F.xxhash64(*df.columns), k, seed).alias(f"_u_{c}") for k, c in enumerate(categorical)))
        return placed.mapInPandas(score, ", ".join(f"`{c}` double" for c in names))

    def generate(self, rows: int, conditions: dict[object, int] | None = None) -> DataFrame:
        """``rows`` rows, or, with ``conditions``, as many of each class of the target as they say, drawn once."""
        grids, levels, numeric, categorical, seed, rates = self.grids, self.levels, self.numeric, self.categorical, self.seed, self.null_rates
        names = [*numeric, *categorical]
        asked, classes = asked_rows(self.spark, rows, conditions)
        factor, given, low, high, at = self.factor, np.zeros(len(names)), np.zeros(1), np.ones(1), -1
        if conditions:
            known, edges = levels[_target(self)]
            if gone := [c for c in classes if c not in known]:
                raise ValueError(f"{_target(self)} has no rows of {gone}")
            at = names.index(self.target)
            low, high = (np.array([edges[known.index(c) + k] for c in classes]) for k in (0, 1))
            r = factor @ factor.T
            given = r[:, at] / r[at, at]
            values, axes = np.linalg.eigh(r - np.outer(given, r[at, :]))
            factor = axes * np.sqrt(np.maximum(values, 0.0))

        def draw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                # term by term: a matrix product's last digits depend on the size of a batch
                z = sum(draws.quantile(batch[f"_u_{k}"].to_numpy())[:, None] * factor[:, k] for k in range(len(names)))
                cls = batch["class"].to_numpy()
                if at >= 0:
                    u = low[cls] + batch["_u_class"].to_numpy() * (high - low)[cls]
                    z = z + draws.quantile(np.clip(u, 1e-12, 1 - 1e-12))[:, None] * given
                u = draws.cdf(z)
                out = {"row_id": batch["row_id"].to_numpy()}
                for k, c in enumerate(numeric):
                    out[c] = np.interp(u[:, k] * GRID, np.arange(GRID + 1), grids[c])
                for k, c in enumerate(categorical, len(numeric)):
                    known, edges = levels[c]
                    out[c] = [classes[i] for i in cls] if k == at else [known[i] for i in np.clip(np.searchsorted(edges, u[:, k], side="right") - 1, 0, len(known) - 1)]
                yield pd.DataFrame(out)

        schema = "row_id long, " + ", ".join([f"`{c}` double" for c in numeric] + [f"`{c}` string" for c in categorical])
        streams = [draws.uniform(F.col("row_id"), k, seed).alias(f"_u_{k}") for k in range(len(names))] + [draws.uniform(F.col("row_id"), -1, seed).alias("_u_class")]
        made = asked.select("*", *streams).mapInPandas(draw, schema)
        return made.withColumns({c: again_null(F.col(c), rates[c], 1000 + k, seed) for k, c in enumerate(numeric)}) if numeric else made


def _target(model) -> str:
    if model.target is None:
        raise ValueError("conditions need a target column")
    return model.target


#: A line of a tree as Spark prints it: indent, and a split by threshold or by a set of levels, or a leaf.
_LINE = re.compile(r"(\s*)(?:(?:If|Else) \(feature (\d+) (<=|>|in|not in) ([^)]*)\)|(Predict): .*)")


def leaf_paths(description: str) -> list[list[tuple[int, str, object]]]:
    """The splits above each leaf of a tree, from the root on, leaves in Spark's order; ``description`` is its toDebugString."""
    paths, path = [], []
    for line in description.splitlines():
        if not (m := _LINE.match(line)):
            continue
        path = [p for p in path if p[0] < len(m[1])]
        if m[5]:
            paths.append([p[1] for p in path])
        else:
            value = float(m[4]) if m[3] in ("<=", ">") else frozenset(float(x) for x in m[4].strip("{}").split(",") if x)
            path.append((len(m[1]), (int(m[2]), m[3], value)))
    return paths


def leaf_bounds(path: list[tuple[int, str, object]], n_features: int) -> list[tuple[float, float]]:
    """Lower and upper bound of each feature in a leaf; infinite where no split bounds it."""
    bounds = [[-np.inf, np.inf] for _ in range(n_features)]
    for feature, sign, value in path:
        if sign == "<=":
            bounds[feature][1] = min(bounds[feature][1], value)
        elif sign == ">":
            bounds[feature][0] = max(bounds[feature][0], value)
    return [tuple(b) for b in bounds]


def leaf_levels(path: list[tuple[int, str, object]], feature: int, n_levels: int) -> frozenset[int] | None:
    """Numbers of the levels that a leaf's splits on a category leave, or None if no split is on it."""
    left = None
    for f, sign, value in path:
        if f != feature:
            continue
        some = {int(x) for x in value} if sign == "in" else set(range(n_levels)) - {int(x) for x in value} if sign == "not in" else {k for k in range(n_levels) if (k <= value) == (sign == "<=")}
        left = some if left is None else left & some
    return None if left is None else frozenset(left)


def prune(paths: list[list[tuple]], counts: dict[int, int], least: int) -> dict[int, int]:
    """For each leaf the leaf that stands for it: leaves with under ``least`` rows are merged up to their parent.

    All leaves below a parent that was made a leaf are the first of them.
    """
    group = {k: tuple(p) for k, p in enumerate(paths)}  # the node, by its path, that a leaf belongs to
    while True:
        rows: dict[tuple, int] = {}
        for k, node in group.items():
            rows[node] = rows.get(node, 0) + counts.get(k, 0)
        small = [node for node, n in rows.items() if n < least and node]
        if not small:
            break
        parent = max(small, key=len)[:-1]  # the deepest first
        group = {k: parent if node[: len(parent)] == parent else node for k, node in group.items()}
    first: dict[tuple, int] = {}
    for k in sorted(group):
        first.setdefault(group[k], k)
    return {k: first[node] for k, node in group.items()}


def leaf_numbers(df: DataFrame, tree: str, leaf: str) -> DataFrame:
    """Dense number of every (tree, leaf), from 0."""
    return prefix.numbered(df.select(tree, leaf).distinct(), [F.col(tree), F.col(leaf)], "f_idx")[0]


def leaf_stats(df: DataFrame, leaf: list[str], columns: list[str]) -> DataFrame:
    """Rows (leaf..., variable, mean, sd, low, high, n): sample deviation, null for one row."""
    long = df.select(*leaf, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(leaf, columns, "variable", "value")
    return long.groupBy(*leaf, "variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))


def merged_stats(cells: DataFrame, leaf: list[str], columns: list[str]) -> DataFrame:
    """As ``leaf_stats``, of cells of ``n`` rows with the count, mean, sum of squared deviations, least and largest value of each column."""
    parts = None
    for c in columns:
        some = cells.select(*leaf, "n", *(F.col(f"_{name}_{c}").alias(name) for name in ("mean", "squares", "low", "high")))
        sums = some.groupBy(*leaf).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_middle"))
        apart = F.sum(F.col("squares") + F.col("n") * (F.col("mean") - F.col("_middle")) * (F.col("mean") - F.col("_middle")))
        one = some.join(sums, leaf).groupBy(*leaf).agg(F.first("_middle").alias("mean"), F.sqrt(ratio(apart, F.sum("n") - 1)).alias("sd"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        one = one.select(*leaf, F.lit(c).alias("variable"), "mean", "sd", "low", "high", "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def level_probability(df: DataFrame, leaf: list[str], column: str, smoothing: float = 0.0, allowed: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Rows (leaf..., value, prob) of every leaf and every level that the column has; unseen ones have the smoothing only.

    With ``weight`` a row counts as often as that column says.

    ``allowed`` has rows (leaf..., value) for the leaves whose splits leave some levels only; the others have no share there.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*leaf, F.col(column).alias("value")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    levels = counts.select("value").distinct()
    total = counts.groupBy(*leaf).agg(F.sum("n").alias("all"))
    grid = total.crossJoin(F.broadcast(levels))  # a row for each level of one column
    if allowed is not None:
        tied = allowed.select(*leaf).distinct().withColumn("_tied", F.lit(True))
        kept = allowed.select(*leaf, "value").distinct().withColumn("_kept", F.lit(True))
        grid = grid.join(tied, leaf, "left").join(kept, [*leaf, "value"], "left").where("_tied is null or _kept").drop("_tied", "_kept")
    found = grid.join(counts, [*leaf, "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = found.groupBy(*leaf).agg(F.sum("n").alias("all"), F.count("*").alias("levels"))
    return found.drop("all").join(sums, leaf).select(*leaf, "value", ratio(F.col("n") + smoothing, F.col("all") + smoothing * F.col("levels")).alias("prob"))


def bounded(stats: DataFrame, bounds: DataFrame) -> DataFrame:
    """Statistics of leaves with the bounds that splits give in place of the observed range, where they are finite."""
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    joined = stats.join(bounds, ["tree", "leaf", "variable"], "left")
    return joined.withColumns({"low": F.coalesce(finite("bound_low"), "low"), "high": F.coalesce(finite("bound_high"), "high")}).drop("bound_low", "bound_high")


#: Cumulative chances of 0, 1, 2, ... of a Poisson number of mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]).tolist()


def bag_weight(row: Column, bag: int, seed: int) -> Column:
    """How often a bag's bootstrap sample holds a row: a Poisson number of mean 1, by the hash of the row's number."""
    u = draws.uniform(row, bag, seed)
    return sum((F.lit(p) <= u).cast("double") for p in POISSON)


def out_of_bag(votes: DataFrame) -> float | None:
    """Accuracy of rows (id, label, p, trees) of trees that left a row out: their mean share of 1 against one half.

    With a column ``n`` an id stands for that many rows.
    """
    rows = F.first("n") if "n" in votes.columns else F.lit(1)
    guess = votes.groupBy("id", "label").agg((F.sum(F.col("p") * F.col("trees")) / F.sum("trees")).alias("p"), rows.alias("n"))
    right = ((F.col("p") > 0.5).cast("double") == F.col("label")).cast("double")
    return guess.agg(F.sum(right * F.col("n")) / F.sum("n")).first()[0]


#: Intervals of a number that trees split between, as many as Spark's trees have.
BINS = 32


class ForestDensity:
    """Adversarial random forest: a forest that tells real rows from rows of shuffled columns gives leaves, leaves give densities.

    Numbers are dealt to BINS intervals between quantiles of a sketch of all rows, which trees split between. Rows that agree in
    intervals and levels are one cell: trees grow on the summed weights of cells, and leaves are summed up from cells, so that
    rows are only read to be dealt, drawn and counted.

    Trees grow in ``bags``, each on a bootstrap sample of its own; a row's vote is that of the bags that left it out. Every
    column is shuffled by drawing it, independently, from the leaf of a random row; rounds end when the out-of-bag accuracy
    is a coin's up to ``delta``, when it is no better than in the round before, or after ``rounds``. ``depth`` bounds the
    trees and so the tables of leaves. Nulls of numeric columns are imputed by
    the median and drawn again by the column's share of them; null levels are the level "missed". Leaves with under
    ``min_node_size`` real rows are merged into their parent. Sampling draws leaves by coverage, numbers from normals cut
    to the leaf's bounds (its observed range where no split bounds it), and levels by the leaf's shares, smoothed by
    ``alpha``.
    """

    name = "forest_density"

    def __init__(self, numeric: list[str], categorical: list[str], trees: int = 30, depth: int = 5, rounds: int = 10, seed: int = 42, target: str | None = None, min_node_size: int = 5, alpha: float = 0.0, bags: int = 4, delta: float = 0.0) -> None:
        self.bags, self.delta = max(1, min(bags, trees)), delta
        self.numeric, self.categorical, self.trees, self.depth, self.rounds, self.seed = numeric, categorical, trees, depth, rounds, seed
        self.target, self.min_node_size, self.alpha = target, min_node_size, alpha

    def fit(self, df: DataFrame) -> None:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import StringIndexer
        from pyspark.ml.functions import vector_to_array

        self.spark = df.sparkSession
        self.null_rates = null_rates(df, self.numeric)
        number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        medians = {c: q[0] if q else None for c, q in exact_quantiles(df, self.numeric, [0.5]).items()} if self.numeric else {}
        real = df.select(*(F.coalesce(number(c), F.lit(float(medians[c] or 0))).alias(c) for c in self.numeric), *(F.coalesce(F.col(c).cast("string"), F.lit("missed")).alias(c) for c in self.categorical))
        sketched = real.stat.approxQuantile(self.numeric, [k / BINS for k in range(1, BINS)], 1e-3) if self.numeric else []
        edges = {c: sorted(set(q)) for c, q in zip(self.numeric, sketched)}
        bins = {c: f"_bin_{k}" for k, c in enumerate(self.numeric)}
        cell = [*bins.values(), *self.categorical]
        dealt = {b: sum(((F.col(c) > e).cast("int") for e in edges[c]), F.lit(0)).cast("double") for c, b in bins.items()}
        rows = written(real.withColumns(dealt).withColumn("_row", F.monotonically_increasing_id()), "dealt-rows")
        of = {"mean": F.avg, "squares": lambda c: F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)), "low": F.min, "high": F.max}
        cells = written(rows.groupBy(*cell).agg(F.count("*").alias("n"), *(f(c).alias(f"_{name}_{c}") for c in self.numeric for name, f in of.items())), "cells")
        stages = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in self.categorical]
        stages.append(VectorAssembler(inputCols=[*bins.values(), *(f"{c}_index" for c in self.categorical)], outputCol="features"))
        prepared = Pipeline(stages=stages).fit(rows)
        leafed, self.accuracies = None, []
        for k in range(self.rounds):
            fake = self._shuffled(rows, cells if leafed is None else leafed, cell, leafed is not None, k)
            both = rows.select(*cell, F.lit(1.0).alias("label"), (2 * F.col("_row")).alias("_id")).unionByName(fake.select(*cell, F.lit(0.0).alias("label"), (2 * F.col("_row") + 1).alias("_id")))
            drawn = both.withColumns({f"_w_{bag}": bag_weight(F.col("_id"), bag, self.seed + k) for bag in range(self.bags)})
            out = sum((F.when(F.col(f"_w_{bag}") == 0, 1 << bag).otherwise(0) for bag in range(self.bags)), F.lit(0))  # the bags without a row
            sums = drawn.groupBy(*cell, "label", out.alias("_out")).agg(F.count("*").alias("n"), *(F.sum(f"_w_{bag}").alias(f"_w_{bag}") for bag in range(self.bags)))
            counted = prepared.transform(written(sums, "real-and-shuffled"))
            forests, votes = [], None
            for bag in range(self.bags):
                weighted = counted.groupBy(*cell, "label").agg(F.sum(f"_w_{bag}").alias("_w")).where("_w > 0")
                total = weighted.agg(F.sum("_w")).first()[0] or 1.0
                trees = self.trees // self.bags + (bag < self.trees % self.bags)
                # a cell stands for many rows: their weights bound a node, not its cells
                least = min(self.min_node_size / total, 0.49)
                learner = RandomForestClassifier(labelCol="label", weightCol="_w", numTrees=trees, bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=self.depth, maxBins=BINS, minInstancesPerNode=1, minWeightFractionPerNode=least, leafCol=f"leaf_{bag}", seed=self.seed + 100 * k + bag)
                forests.append(learner.fit(prepared.transform(weighted)))
                left_out = forests[-1].transform(counted.where(F.col("_out").bitwiseAND(1 << bag) > 0)).select(F.struct(*cell, "_out").alias("id"), "label", "n", vector_to_array("probability")[1].alias("p"), F.lit(trees).alias("trees"))
                votes = left_out if votes is None else votes.unionByName(left_out)
            accuracy = out_of_bag(votes)
            self.accuracies.append(0.5 if accuracy is None else accuracy)
            placed = prepared.transform(cells)
            for forest in forests:
                placed = forest.transform(placed).drop("prediction", "rawPrediction", "probability")
            leafed = written(placed.select(*cells.columns, F.concat(*(vector_to_array(f"leaf_{bag}") for bag in range(self.bags))).alias("leaf")), "leafed-cells")
            if self.accuracies[-1] <= 0.5 + self.delta or (k and self.accuracies[-1] >= self.accuracies[-2]):
                break
        rows = leafed.select(*cells.columns, F.posexplode("leaf").alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))
        paths = [leaf_paths(t.toDebugString) for forest in forests for t in forest.trees]
        counts: dict[int, dict[int, int]] = {}
        for r in rows.groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():  # a row for each leaf of a bounded forest
            counts.setdefault(r["tree"], {})[r["leaf"]] = r["n"]
        merged = {t: prune(p, counts.get(t, {}), self.min_node_size) for t, p in enumerate(paths)}
        self.merged = self.spark.createDataFrame([(t, k, g) for t, m in merged.items() for k, g in m.items()], "tree int, leaf int, stands int")
        # A merged leaf's bounds are those of all leaves in it.
        limits: dict[tuple, tuple[float, float]] = {}
        for t, p in enumerate(paths):
            for k, path in enumerate(p):
                for c, found in zip(self.numeric, leaf_bounds(path, len(cell))):
                    low, high = (edges[c][int(v)] if abs(v) < np.inf else v for v in found)  # between intervals
                    key = (t, merged[t][k], c)
                    have = limits.get(key, (np.inf, -np.inf))
                    limits[key] = (min(have[0], low), max(have[1], high))
        self.bounds = self.spark.createDataFrame([(*k, float(a), float(b)) for k, (a, b) in limits.items()], "tree int, leaf int, variable string, bound_low double, bound_high double")
        rows = written(rows.join(F.broadcast(self.merged), ["tree", "leaf"]).withColumn("leaf", F.col("stands")).drop("stands"), "leaves")  # a bounded forest
        total = rows.groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
        every = rows.agg(F.sum("n")).first()[0] or 1
        self.coverage = written(total.withColumn("coverage", F.col("n") / every), "coverage")
        self.stats = written(bounded(merged_stats(rows, ["tree", "leaf"], self.numeric), self.bounds), "leaf-stats") if self.numeric else None
        labels = {c: prepared.stages[k].labels for k, c in enumerate(self.categorical)}
        self.levels_left = {c: self._levels_left(paths, merged, len(self.numeric) + k, labels[c]) for k, c in enumerate(self.categorical)}
        self.probabilities = {c: written(level_probability(rows, ["tree", "leaf"], c, self.alpha, self.levels_left[c], "n"), "leaf-levels") for c in self.categorical}

    def _levels_left(self, paths: list, merged: dict, feature: int, labels: list[str]) -> DataFrame | None:
        """Rows (tree, leaf, value) of the leaves whose splits leave some levels of a category; a merged leaf has those of all."""
        left: dict[tuple[int, int], set[int] | None] = {}
        for t, p in enumerate(paths):
            for k, path in enumerate(p):
                some, key = leaf_levels(path, feature, len(labels) + 1), (t, merged[t][k])
                left[key] = None if some is None or (key in left and left[key] is None) else left.get(key, set()) | some
        rows = [(*key, labels[i]) for key, some in left.items() if some is not None for i in some if i < len(labels)]
        return self.spark.createDataFrame(rows, "tree int, leaf int, value string") if rows else None

    def _shuffled(self, rows: DataFrame, cells: DataFrame, cell: list[str], leafed: bool, k: int) -> DataFrame:
        """For each row, intervals and levels drawn independently from its leaf of a random tree, or from the table.

        What a leaf draws from are shares of intervals and levels, a bounded table for a bounded forest.
        """
        row = F.col("_row")
        if leafed:
            tree = F.floor(draws.uniform(row, 4000 + k, self.seed) * self.trees).cast("int")
            placed = rows.select("_row", *cell).join(cells.select(*cell, "leaf"), cell).select("_row", tree.alias("tree"), F.get("leaf", tree).cast("int").alias("leaf"))
            counted = cells.select(*cell, "n", F.posexplode("leaf").alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))
        else:
            nowhere = F.lit(0).alias("tree"), F.lit(0).alias("leaf")
            placed, counted = rows.select("_row", *nowhere), cells.select(*cell, "n", *nowhere)
        for j, c in enumerate(cell):
            some = counted.groupBy("tree", "leaf", F.col(c).alias("_level")).agg(F.sum("n").alias("_n")).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("_level", "_n"))).alias("_e"), F.sum("_n").alias("_all"))
            upto = F.transform("_e", lambda e, i: F.aggregate(F.slice("_e", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x["_n"]) / F.col("_all"))
            shares = some.select("tree", "leaf", F.col("_e._level").alias("_levels"), upto.alias("_upto"))
            place = F.least(F.size(F.filter("_upto", lambda x: x <= F.col("_u"))), F.size("_levels") - 1)
            placed = placed.join(F.broadcast(shares), ["tree", "leaf"]).withColumn("_u", draws.uniform(row, 5000 + 100 * k + j, self.seed)).withColumn(c, F.get("_levels", place)).drop("_levels", "_upto", "_u")
        return placed.select("_row", *cell)

    def generate(self, rows: int, conditions: dict[object, int] | None = None) -> DataFrame:
        """``rows`` rows, or, with ``conditions``, as many of each class of the target as they say, drawn once.

        Leaves share 0..1 by coverage, for a class by coverage times the class's share in the leaf; a row's draw falls into
        the interval of one. Leaves and their numbers are tables, which rows are joined with.
        """
        asked, classes = asked_rows(self.spark, rows, conditions)
        row, seed = F.col("row_id"), self.seed
        weighted = self.coverage.select("tree", "leaf", F.lit(0).alias("class"), F.col("coverage").alias("weight"))
        if conditions:
            number = self.spark.createDataFrame([(None if c is None else str(c), k) for k, c in enumerate(classes)], "value string, class int")
            shares = self.probabilities[_target(self)].join(F.broadcast(number), "value")  # a row a class
            weighted = self.coverage.join(shares, ["tree", "leaf"]).select("tree", "leaf", "class", (F.col("coverage") * F.col("prob")).alias("weight")).where("weight > 0")
        sums = {r["class"]: r["w"] for r in weighted.groupBy("class").agg(F.sum("weight").alias("w")).collect()}  # one a class
        if gone := [c for k, c in enumerate(classes) if k not in sums]:
            raise ValueError(f"{self.target} has no rows of {gone}")
        # the classes' leaves one after the other, each class as long as any other, in whole numbers
        unit = 1 << 40
        total = F.get(F.array(*(F.lit(float(sums[k])) for k in range(len(classes)))), F.col("class"))
        placed, totals = prefix.running(weighted, [F.col("class"), F.col("tree"), F.col("leaf")], {"upto": F.greatest(F.round(F.col("weight") / total * unit), F.lit(1)).cast("long")})
        ends = {r["class"]: r["upto"] for r in placed.groupBy("class").agg(F.max("upto").alias("upto")).collect()}  # one a class
        every = totals["upto"]
        width = F.greatest(F.round(F.col("weight") / total * unit), F.lit(1)).cast("long")
        intervals = placed.select("tree", "leaf", ((F.col("upto") - width) / every).alias("lo"), (F.col("upto") / every).alias("hi"))
        starts = [0.0] + [ends[k] / every for k in range(len(classes))]
        start = F.get(F.array(*map(F.lit, starts)), F.col("class"))
        end = F.get(F.array(*map(F.lit, starts)), F.col("class") + 1)
        found = prefix.in_interval(asked, start + draws.uniform(row, -2, seed) * (end - start), intervals, ["tree", "leaf"], placed.count())
        if self.numeric:
            wide = self.stats.groupBy("tree", "leaf").pivot("variable", self.numeric).agg(F.first(F.struct("mean", "sd", "low", "high")))
            # a pivot of one struct has the variables' names
            found = found.join(wide, ["tree", "leaf"], "left")
        for k, c in enumerate(self.categorical):
            if conditions and c == self.target:
                found = found.withColumn(f"_{c}", F.get(F.array(*(F.lit(None if x is None else str(x)).cast("string") for x in classes)), F.col("class")))
                continue
            shares = self.probabilities[c].groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("value", "prob"))).alias("_shares"))
            found = found.join(shares, ["tree", "leaf"], "left")
            sums_ = F.transform("_shares", lambda e, i: F.struct(e["value"].alias("value"), F.aggregate(F.slice("_shares", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x["prob"]).alias("upto")))
            u = draws.uniform(row, k, seed)
            chosen = F.coalesce(F.get(F.filter(sums_, lambda e: e["upto"] >= u), F.lit(0))["value"], F.element_at("_shares", -1)["value"])
            found = found.withColumn(f"_{c}", chosen).drop("_shares")
        out = {}
        for k, c in enumerate(self.numeric):
            p = F.col(f"`{c}`")
            sd = F.coalesce(p["sd"], F.lit(0.0))
            safe = F.when(sd > 0, sd).otherwise(F.lit(1.0))
            a, b = draws.normal_cdf((p["low"] - p["mean"]) / safe), draws.normal_cdf((p["high"] - p["mean"]) / safe)
            u = F.greatest(F.least(a + draws.uniform(row, 2000 + k, seed) * (b - a), F.lit(1 - 1e-12)), F.lit(1e-12))
            drawn = F.greatest(F.least(p["mean"] + sd * draws.normal_quantile(u), p["high"]), p["low"])
            out[c] = again_null(F.when((sd <= 0) | (p["high"] <= p["low"]), p["mean"]).otherwise(drawn), self.null_rates[c], 1000 + k, seed)
        return found.select("row_id", *(v.alias(c) for c, v in out.items()), *(F.col(f"`_{c}`").alias(c) for c in self.categorical))


def synthesizers(spark: SparkSession, numeric: list[str], categorical: list[str]) -> dict[str, Synthesizer]:
    return {s.name: s for s in (GaussianCopula(numeric, categorical), ForestDensity(numeric, categorical))}
