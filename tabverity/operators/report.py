"""Results as long tables: pivot, upsert, order, selection of candidates, and classification reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import format_value, ratio
from . import prefix, skyline

#: Families of metrics in the order in which they are shown.
FAMILIES = [
    "Utility", "Basic Quality", "Advanced Quality", "Likelihood", "Propensity Score", "Privacy Against Inference", "Distance",
    "Singling Out", "Linkability", "Inference", "Membership Inference Attack",
]


def melt(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(ids, metrics, "metric", "value")


def pivot_results(results: DataFrame, models: list[str]) -> DataFrame:
    """A row for each (metric_type, metric), a column for each model; several values are averaged."""
    return results.groupBy("metric_type", "metric").pivot("model_name", models).agg(F.avg("value"))


def typed_pivot(results: DataFrame, models: list[str]) -> DataFrame:
    """Metrics with texts among their values beside numeric ones: a row for each metric, a column of text for each model.

    ``results`` has rows (metric_type, metric, model_name, value) with values as text. Several numbers of a cell are
    averaged, of several texts the smallest is taken; a metric with any text is one of texts.
    """
    number = F.col("value").try_cast("double")
    texts = results.groupBy("metric_type", "metric").agg(F.bool_or(F.col("value").isNotNull() & number.isNull()).alias("is_text"))
    cells = results.groupBy("metric_type", "metric", "model_name").agg(F.avg(number).alias("mean"), F.min("value").alias("text"))
    shown = cells.join(texts, ["metric_type", "metric"]).withColumn("shown", F.when(F.col("is_text"), F.col("text")).otherwise(format_value(F.col("mean"))))
    return shown.groupBy("metric_type", "metric").pivot("model_name", models).agg(F.min("shown"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_age")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_age")


def missing(requested: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(stored, keys, "left_anti")


def in_order(results: DataFrame, families: list[str] = FAMILIES) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, families)), F.col("metric_type"))
    return results.withColumn("place", F.when(place > 0, place).otherwise(len(families) + 1))


def pareto_front(trials: DataFrame, id_col: str, maximise: list[str], minimise: list[str]) -> DataFrame:
    """Trials that no other trial beats in one metric without losing in any.

    Metric vectors are compared, not trials; a trial without one of the metrics isn't on the front.
    """
    goals = F.array(*(F.col(c).cast("double") for c in maximise), *(-F.col(c).cast("double") for c in minimise))
    vectors = trials.select(goals.alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).distinct()
    best = skyline.undominated(vectors, len(maximise) + len(minimise))
    return trials.withColumn("_v", goals).join(best, F.col("_v") == F.col("v"), "left_semi").select(*trials.columns)


def total_score(trials: DataFrame, maximise: list[str], minimise: list[str]) -> DataFrame:
    """A column ``total_score``: the sum of the metrics, each scaled to 0..1 (1 is best; 0.5 if constant)."""
    every = [*maximise, *minimise]
    limits = trials.agg(*(x for c in every for x in (F.min(c).cast("double").alias(f"_lo_{c}"), F.max(c).cast("double").alias(f"_hi_{c}"))))
    joined = trials.crossJoin(F.broadcast(limits))  # one row
    scaled = lambda c: ratio(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
    total = F.lit(0.0)
    for c in every:
        total = total + F.coalesce(scaled(c) if c in maximise else 1 - scaled(c), F.lit(0.5))
    return joined.withColumn("total_score", total).select(*trials.columns, "total_score")


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(tp, fp, tn, fn, tpr, fpr, tnr, fnr, ppv, accuracy, advantage) of 0/1 columns."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    counts = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(~t & ~g).alias("tn"), F.count_if(t & ~g).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    tpr, fpr = ratio(tp, tp + fn), ratio(fp, fp + tn)
    return counts.select("*", tpr.alias("tpr"), fpr.alias("fpr"), ratio(tn, tn + fp).alias("tnr"), ratio(fn, fn + tp).alias("fnr"), ratio(tp, tp + fp).alias("ppv"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), (tpr - fpr).alias("advantage"))


def f1_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(f1, f1_weighted, f1_macro, precision_macro, recall_macro, accuracy, support_0, support_1) of 0/1 columns; 0 for 0/0."""
    c = confusion(df, truth, guess).select("tp", "fp", "tn", "fn", "accuracy")
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    safe = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    f1_1, f1_0 = safe(2 * tp, 2 * tp + fp + fn), safe(2 * tn, 2 * tn + fn + fp)
    n1, n0 = tp + fn, tn + fp
    return c.select(
        f1_1.alias("f1"), safe(f1_1 * n1 + f1_0 * n0, n1 + n0).alias("f1_weighted"), ((f1_1 + f1_0) / 2).alias("f1_macro"), ((safe(tp, tp + fp) + safe(tn, tn + fn)) / 2).alias("precision_macro"),
        ((safe(tp, n1) + safe(tn, n0)) / 2).alias("recall_macro"), "accuracy", n0.alias("support_0"), n1.alias("support_1"),
    )


def pr_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Rows (threshold, precision, recall), one for each distinct score; counts by score come first."""
    counts = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count("*").alias("n"))
    total = df.agg(F.count_if(F.col(truth) == 1).alias("all_pos"))
    sums = prefix.running(counts, [F.desc("threshold")], {"tp": F.col("pos"), "called": F.col("n")})[0].crossJoin(F.broadcast(total))  # one row
    return sums.select("threshold", ratio(F.col("tp"), F.col("called")).alias("precision"), ratio(F.col("tp"), F.col("all_pos")).alias("recall"))


def write_results(results: DataFrame, path: str) -> None:
    """Partitioned by family, so that one family is rewritten without the others."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric_type").parquet(path)
