"""Attribute disclosure: correct attribution, naive Bayes and neighbours that guess sensitive values from key fields."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..sources.tables import written


def _on(left: str, right: str, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def _attribution(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: list[str]) -> DataFrame:
    """Classes of real rows (keys, sensitive) with their number and the share of synthetic rows of the same keys that agree."""
    rows = real.groupBy(*keys, *sensitive).agg(F.count("*").alias("rows"))
    by_key = synthetic.groupBy(*keys).agg(F.count("*").alias("n_key"))
    by_both = synthetic.groupBy(*keys, *sensitive).agg(F.count("*").alias("n_both"))
    found = rows.alias("r").join(by_key.alias("k"), _on("r", "k", keys), "left").select("r.*", "n_key")
    found = found.alias("r").join(by_both.alias("b"), _on("r", "b", [*keys, *sensitive]), "left").select("r.*", "n_both")
    return found.withColumn("cap", F.when(F.col("n_key").isNotNull(), ratio(F.coalesce("n_both", F.lit(0)), F.col("n_key"))))


def _score(found: DataFrame) -> DataFrame:
    mean = ratio(F.sum(F.when(F.col("cap").isNotNull(), F.col("cap") * F.col("rows"))), F.sum(F.when(F.col("cap").isNotNull(), F.col("rows"))))
    return found.agg((1 - mean).alias("score"))


def cap(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: list[str]) -> DataFrame:
    """1 - mean attribution; real rows whose keys no synthetic row has are left out."""
    return _score(_attribution(real, synthetic, keys, sensitive))


def zero_cap(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: list[str]) -> DataFrame:
    """Such rows count as 0."""
    return _score(_attribution(real, synthetic, keys, sensitive).withColumn("cap", F.coalesce("cap", F.lit(0.0))))


def _groups(keys: list[str], n: int) -> list[list[str]]:
    """The key fields in ``n`` groups of about the same size."""
    return [keys[k::n] for k in range(n)]


def _differ(columns: list[str]) -> Column:
    return sum(((~F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))).cast("int") for c in columns), F.lit(0))


def nearest_cells(classes: DataFrame, cells: DataFrame, keys: list[str], level: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """What ``level`` makes of every class and its nearest cells by key fields that differ, and the classes without any.

    Nearest cells are looked for by growing distance d, for the classes that found none so far. Of d + 1 groups of key
    fields one is untouched by d differences: cells are probed by each group, the first that agrees, and the other fields
    are counted. ``level`` gets the columns of both sides, as r and s, and returns rows with the key fields. Every distance
    is written before the next one, which few classes reach. Classes that differ in all fields are left.
    """
    waiting, done = classes, None
    for d in range(len(keys)):
        groups = _groups(keys, d + 1)
        probes = F.explode(F.array(*(F.struct(F.lit(k).alias("group"), F.xxhash64(*group).alias("hash")) for k, group in enumerate(groups))))
        left, right = (df.select(F.struct(*df.columns).alias(side), probes.alias("probe")).select(side, "probe.*") for df, side in ((waiting, "r"), (cells, "s")))
        apart = F.array(*(_differ(group) for group in groups))
        first = (F.get(apart, F.col("group")) == 0) & F.forall(F.slice(apart, F.lit(1), F.col("group")), lambda n: n > 0)
        pairs = left.join(right, ["group", "hash"]).where(first & (_differ(keys) == d)).select("r", "s")
        found = written(level(pairs), "nearest-cells")
        done = found if done is None else done.unionByName(found)
        waiting = written(waiting.alias("r").join(found.select(*keys).distinct().alias("l"), _on("r", "l", keys), "left_anti"), "waiting-classes")
        if waiting.isEmpty():
            break
    return done, waiting


def generalized_cap(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: list[str]) -> DataFrame:
    """Such rows take the classes of synthetic keys that differ in the fewest key fields. Classes are compared, not rows."""
    rows = written(real.groupBy(*keys, *sensitive).agg(F.count("*").alias("rows")), "classes")
    cells = written(synthetic.groupBy(*keys, *sensitive).agg(F.count("*").alias("n")), "cells")
    classes = [*keys, *sensitive]

    def level(pairs: DataFrame) -> DataFrame:
        met = pairs.select(*(F.col(f"r.{c}") for c in [*classes, "rows"]), _on("r", "s", sensitive).alias("agrees"), F.col("s.n").alias("n"))
        return met.groupBy(*classes, "rows").agg(ratio(F.sum(F.when(F.col("agrees"), F.col("n")).otherwise(0)), F.sum("n")).alias("cap"))

    done, waiting = nearest_cells(rows, cells, keys, level)
    # Nothing in common with any cell: all cells are equally near.
    shares = cells.groupBy(*sensitive).agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n").alias("all"))
    last = waiting.alias("r").join(shares.alias("s"), _on("r", "s", sensitive), "left").select("r.*", "n").crossJoin(F.broadcast(total))  # one row
    last = last.select(*classes, "rows", ratio(F.coalesce("n", F.lit(0)), F.col("all")).alias("cap"))
    return _score(done.unionByName(last))


def naive_bayes(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    """(correct, rows, score): score is 1 - the share of real rows whose value is guessed from synthetic counts.

    Counts are smoothed by one; ties go to the smallest value. Guesses are made for classes of keys, not for rows.
    """
    prior = synthetic.where(F.col(sensitive).isNotNull()).groupBy(F.col(sensitive).alias("guess")).agg(F.count("*").alias("n_s"))
    total = prior.agg(F.sum("n_s").alias("all"), F.count("*").alias("levels"))
    rows = real.groupBy(*keys, F.col(sensitive).alias("truth")).agg(F.count("*").alias("rows"))
    scored = rows.select(*keys).distinct().crossJoin(F.broadcast(prior.crossJoin(total)))  # a row for each sensitive level
    score = F.ln((F.col("n_s") + 1) / (F.col("all") + F.col("levels")))
    for k, key in enumerate(keys):
        levels = synthetic.agg(F.count_distinct(key).alias(f"_l{k}"))
        counts = synthetic.groupBy(F.col(key).alias(f"_k{k}"), F.col(sensitive).alias(f"_s{k}")).agg(F.count("*").alias(f"_n{k}"))
        scored = scored.join(counts, F.col(key).eqNullSafe(F.col(f"_k{k}")) & (F.col("guess") == F.col(f"_s{k}")), "left").crossJoin(F.broadcast(levels))  # one row
        score = score + F.ln((F.coalesce(F.col(f"_n{k}"), F.lit(0)) + 1) / (F.col("n_s") + F.col(f"_l{k}")))
    best = scored.groupBy(*keys).agg(F.min_by("guess", F.struct((-F.round(score, 9)).alias("score"), "guess")).alias("guess"))
    return _guessed(rows, best, keys)


def _guessed(rows: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    joined = rows.alias("r").join(best.alias("b"), _on("r", "b", keys), "left")
    found = joined.agg(F.coalesce(F.sum(F.when(F.col("truth").eqNullSafe(F.col("guess")), F.col("rows"))), F.lit(0)).alias("correct"), F.sum("rows").alias("rows"))
    return found.select("correct", "rows", (1 - ratio(F.col("correct"), F.col("rows"))).alias("score"))


def categorical_knn(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    """The same with the most frequent value among the synthetic rows that differ in the fewest keys; ties: smallest."""
    rows = written(real.groupBy(*keys, F.col(sensitive).alias("truth")).agg(F.count("*").alias("rows")), "classes")
    cells = written(synthetic.groupBy(*keys, F.col(sensitive).alias("value")).agg(F.count("*").alias("n")), "cells")
    best_of = lambda votes, by: votes.groupBy(*by).agg(F.min_by("value", F.struct((-F.col("votes")).alias("votes"), "value")).alias("guess"))

    def level(pairs: DataFrame) -> DataFrame:
        met = pairs.select(*(F.col(f"r.{c}") for c in keys), F.col("s.value").alias("value"), F.col("s.n").alias("n"))
        return best_of(met.groupBy(*keys, "value").agg(F.sum("n").alias("votes")), keys)

    best, waiting = nearest_cells(rows.select(*keys).distinct(), cells, keys, level)
    usual = best_of(cells.groupBy("value").agg(F.sum("n").alias("votes")), [])
    return _guessed(rows, best.unionByName(waiting.crossJoin(F.broadcast(usual))), keys)  # one row
