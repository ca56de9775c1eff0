"""Privacy attacks: linkability, inference, singling out, and the risk they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clip, ratio
from ..sources.tables import written
from . import models, nearest, split
from .profile import exact_quantiles

#: 0.975 quantile of the normal distribution.
Z = 1.959964


def gower_neighbours(left: DataFrame, right: DataFrame, id_col: str, numeric: list[str], categorical: list[str], k: int) -> DataFrame:
    """Rows (id, neighbours): the k nearest right rows (d, id) of each left row, by mean Gower distance; ties by id.

    Numbers differ by their share of the range over both tables, categories by 0 or 1; a null differs from everything.
    """
    widths = ()
    if numeric:
        both = left.select(*numeric).unionByName(right.select(*numeric))
        spans = both.agg(*((F.max(c) - F.min(c)).cast("double").alias(f"_{k}") for k, c in enumerate(numeric))).first()
        widths = tuple((spans[f"_{k}"] or 0) or 1.0 for k in range(len(numeric)))
    metric = nearest.Gower(tuple(numeric), tuple(categorical), widths)
    return nearest.search_vectors(left, right, id_col, metric, k).select("id", F.col("near").alias("neighbours"))


def linkability(original: DataFrame, synthetic: DataFrame, id_col: str, aux: tuple[tuple[list[str], list[str]], tuple[list[str], list[str]]], k: int) -> DataFrame:
    """(attacks, successes): a row is linked if its neighbours by two groups of columns have one in common."""
    (numeric_a, categorical_a), (numeric_b, categorical_b) = aux
    a = gower_neighbours(original, synthetic, id_col, numeric_a, categorical_a, k).select("id", F.col("neighbours.id").alias("a"))
    b = gower_neighbours(original, synthetic, id_col, numeric_b, categorical_b, k).select("id", F.col("neighbours.id").alias("b"))
    return a.join(b, "id").agg(F.count("*").alias("attacks"), F.count_if(F.arrays_overlap("a", "b")).alias("successes"))


def inference(original: DataFrame, synthetic: DataFrame, id_col: str, numeric: list[str], categorical: list[str], secret: str, regression: bool = False, tolerance: float = 0.05) -> DataFrame:
    """(attacks, successes): the secret of the nearest synthetic row is the guess; rows without a secret don't count."""
    asked = original.where(F.col(secret).isNotNull())
    near = gower_neighbours(asked, synthetic, id_col, numeric, categorical, 1).select("id", F.col("neighbours")[0]["id"].alias("at"))
    truth = asked.select(F.col(id_col).cast("long").alias("id"), F.col(secret).alias("truth"))
    guess = synthetic.select(F.col(id_col).cast("long").alias("at"), F.col(secret).alias("guess"))
    joined = near.join(truth, "id").join(guess, "at", "left")
    hit = F.abs(F.col("guess") - F.col("truth")) <= tolerance * F.abs(F.col("truth")) if regression else F.col("guess") == F.col("truth")
    return joined.agg(F.count("*").alias("attacks"), F.count_if(hit).alias("successes"))


def inference_by_group(original: DataFrame, synthetic: DataFrame, id_col: str, numeric: list[str], categorical: list[str], secret: str) -> DataFrame:
    near = gower_neighbours(original.where(F.col(secret).isNotNull()), synthetic, id_col, numeric, categorical, 1).select("id", F.col("neighbours")[0]["id"].alias("at"))
    joined = near.join(original.select(F.col(id_col).cast("long").alias("id"), F.col(secret).alias("truth")), "id").join(synthetic.select(F.col(id_col).cast("long").alias("at"), F.col(secret).alias("guess")), "at", "left")
    return joined.groupBy(F.col("truth").alias("group")).agg(F.count("*").alias("attacks"), F.count_if(F.col("guess") == F.col("truth")).alias("successes"))


def singling_out_univariate(original: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, kind, value, matches, success): predicates on values that one synthetic row has, and on the extremes.

    Predicates are rows, so that any number of them is one join.
    """
    parts = []
    for c in columns:
        value = F.col(c).cast("double")
        once = synthetic.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n")).where("n = 1").select("value")
        there = original.groupBy(value.alias("value")).agg(F.count("*").alias("m"))
        equal = once.join(there, "value", "left").select(F.lit("=").alias("kind"), "value", F.coalesce("m", F.lit(0)).alias("matches"))
        ends = synthetic.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        counts = original.crossJoin(F.broadcast(ends)).groupBy("lo", "hi").agg(F.count_if(value <= F.col("lo")).alias("below"), F.count_if(value >= F.col("hi")).alias("above"))  # one row
        outer = counts.select(F.inline(F.array(F.struct(F.lit("<=").alias("kind"), F.col("lo").alias("value"), F.col("below").alias("matches")), F.struct(F.lit(">=").alias("kind"), F.col("hi").alias("value"), F.col("above").alias("matches")))))
        parts.append(equal.unionByName(outer).withColumn("column", F.lit(c)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select("column", "kind", "value", "matches", (F.col("matches") == 1).alias("success"))


def singling_out_levels(original: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, value, matches, success): equality with the levels, as text, that one synthetic row has."""
    parts = []
    for c in columns:
        value = F.col(c).cast("string").alias("value")
        once = synthetic.where(F.col(c).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).where("n = 1").select("value")
        there = original.groupBy(value).agg(F.count("*").alias("m"))
        parts.append(once.join(there, "value", "left").select(F.lit(c).alias("column"), "value", F.coalesce("m", F.lit(0)).alias("matches")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.withColumn("success", F.col("matches") == 1)


def singling_out_multivariate(original: DataFrame, synthetic: DataFrame, id_col: str, numeric: list[str], categorical: list[str], n_attacks: int | None = None, n_cols: int | None = None) -> DataFrame:
    """(attacks, successes): every given synthetic row makes one predicate of all columns, or of the first ``n_cols``.

    ``n_attacks`` rows make predicates, in hash order, or all.

    Numbers from the synthetic median on ask for at least their value, others for at most; categories for equality.
    With up to two numbers no row meets an attack (see ``_fits_of_two``); with more they meet on the categories.
    """
    if n_cols is not None:
        numeric, categorical = numeric[: max(n_cols - len(categorical), 0)], categorical[:n_cols]
    medians = {c: q[0] if q else None for c, q in exact_quantiles(synthetic, numeric, [0.5]).items()} if numeric else {}
    asked = sample_attacks(synthetic, id_col, n_attacks)
    if len(numeric) <= 2:
        fits = _fits_of_two(original, asked, id_col, numeric, categorical, medians)
        matches = fits.groupBy("attack").agg(F.sum("n").alias("n"))
    else:
        s, r = asked.alias("s"), original.alias("r")
        on = F.lit(True)
        for c in categorical:
            on = on & F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}"))
        for c in numeric:
            on = on & F.when(F.col(f"s.{c}") >= F.lit(medians[c]), F.col(f"r.{c}") >= F.col(f"s.{c}")).otherwise(F.col(f"r.{c}") <= F.col(f"s.{c}"))
        matches = s.join(r, on, "left").groupBy(F.col(f"s.{id_col}").alias("attack")).agg(F.count(F.col(f"r.{id_col}")).alias("n"))
    return matches.agg(F.count("*").alias("attacks"), F.count_if(F.col("n") == 1).alias("successes"))


def _turned(c: str, kind: T.DataType) -> Column:
    """A number in the opposite order; NaN, which no bound from above lets in, is null."""
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(F.col(c))
    return F.when(~F.isnan(c), F.lit(0.0).cast(kind) - F.col(c)) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else -F.col(c)


def _second(a: Column, b: Column) -> Column:
    """The smaller of two numbers, or null if one is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def _fits_of_two(original: DataFrame, asked: DataFrame, id_col: str, numeric: list[str], categorical: list[str], medians: dict[str, float | None]) -> DataFrame:
    """Rows (attack, n): the rows that fit each attack's predicate over at most two numbers, 2 for two or more.

    In the order of the first number, a predicate is fitted by a row if the largest second number up to its place is large
    enough, and by two if the second largest is: two running maxima. Numbers that are asked to be at most a value are turned
    round, so that rows take part once for each pair of directions. Ranges of the order start from the maxima of those before.
    """
    spark = original.sparkSession
    kinds = {c: original.schema[c].dataType for c in numeric}
    up = {c: F.coalesce(F.col(c) >= F.lit(medians[c]), F.lit(False)) for c in numeric}
    names = ["_x", "_y"][: len(numeric)]
    plain = lambda c: F.col(c) if isinstance(kinds[c], T.IntegralType | T.DecimalType) else F.col(c) + F.lit(0.0).cast(kinds[c])  # noqa: E731  no -0.0
    directed = lambda c, rises: F.when(rises, plain(c)).otherwise(_turned(c, kinds[c]))
    rest = [F.lit(0).alias(n) for n in ("_x", "_y")[len(numeric) :]]
    group = F.struct(F.lit(0).alias("all"), *(F.col(c) for c in categorical))
    signs = F.array(*(up[c] for c in numeric)).cast("array<boolean>")
    asks = asked.select(F.struct(signs.alias("up"), group.alias("of")).alias("_group"), *(directed(c, up[c]).alias(n) for c, n in zip(numeric, names)), *rest, F.lit(True).alias("_asks"), F.col(id_col).alias("_id"))
    every = [F.array(*(F.lit(bool(k >> j & 1)) for j in range(len(numeric)))).cast("array<boolean>") for k in range(1 << len(numeric))]
    rows = original.where(F.col(id_col).isNotNull()).withColumn("_up", F.explode(F.array(*every)))
    rows = rows.select(F.struct(F.col("_up").alias("up"), group.alias("of")).alias("_group"), *(directed(c, F.col("_up")[j]).alias(n) for j, (c, n) in enumerate(zip(numeric, names))), *rest, F.lit(False).alias("_asks"), F.col(id_col).alias("_id"))
    rows = rows.where("_x is not null and _y is not null")
    order = [F.col("_x").desc(), F.col("_asks"), F.col("_id")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = written(rows.unionByName(asks).repartitionByRange(parts, F.col("_group"), *order).withColumn("_part", F.spark_partition_id()), "singling-ranges")
    value = F.when(~F.col("_asks"), F.col("_y"))
    w = Window.partitionBy("_part", "_group").orderBy(*order)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    swept = stored.withColumns({"_first": F.max(value).over(upto), "_pair": _second(value, F.max(value).over(earlier))}).withColumn("_next", F.max("_pair").over(upto))
    # the two largest of a group in a range, and in those before it: a row for each range that a group has rows in
    ends = swept.groupBy("_part", "_group").agg(F.max("_first").alias("_first"), F.max("_next").alias("_next"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_b_first": F.max("_first").over(before), "_b_pair": _second(F.col("_first"), F.max("_first").over(before))})
    ends = ends.select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), "_b_first", F.greatest(F.max("_next").over(before), F.max("_b_pair").over(before)).alias("_b_next"))
    found = swept.where("_asks").join(ends, (F.col("_part") == F.col("_p")) & (F.col("_group") == F.col("_g")), "left")
    least = lambda c: F.coalesce((c >= F.col("_y")).cast("int"), F.lit(0))
    first, both = F.greatest("_first", "_b_first"), F.greatest(F.col("_next"), F.col("_b_next"), _second(F.col("_first"), F.col("_b_first")))
    # a predicate without a first number is fitted by no row
    return found.select(F.col("_id").alias("attack"), F.when(F.col("_x").isNotNull(), least(first) + least(both)).otherwise(0).alias("n"))


def sample_attacks(df: DataFrame, id_col: str, n: int | None, seed: int = 42) -> DataFrame:
    """The rows that are attacked: ``n`` of them in hash order, or all."""
    if n is None:
        return df
    return split.take_first(df.withColumn("_all", F.lit(0)), F.lit(n), id_col, seed, ["_all"]).where("taken").drop("taken", "_all")


def _random_rows(df: DataFrame, id_col: str, synthetic: DataFrame, column: str, seed: int) -> DataFrame:
    """Rows (id, guess): a synthetic row's value for each row, chosen by the hash of the row's id."""
    rows = max(synthetic.count(), 1)
    numbered = split.dense_index(synthetic.select(F.col(id_col), F.col(column).alias("guess")), id_col, "_at", seed).select("_at", "guess")
    place = F.conv(F.substring(split.hash_order(id_col, seed), 1, 12), 16, 10).cast("long") % rows
    return df.select(F.col(id_col).cast("long").alias("id"), place.alias("_at")).join(numbered, "_at").select("id", "guess")


def inference_baseline(original: DataFrame, synthetic: DataFrame, id_col: str, secret: str, regression: bool = False, tolerance: float = 0.05, seed: int = 42) -> DataFrame:
    """(attacks, successes) of guessing the secret of a random synthetic row: what needs no knowledge of the victim."""
    asked = original.where(F.col(secret).isNotNull())
    truth = asked.select(F.col(id_col).cast("long").alias("id"), F.col(secret).alias("truth"))
    joined = _random_rows(asked, id_col, synthetic, secret, seed).join(truth, "id")
    hit = F.abs(F.col("guess") - F.col("truth")) <= tolerance * F.abs(F.col("truth")) if regression else F.col("guess") == F.col("truth")
    return joined.agg(F.count("*").alias("attacks"), F.count_if(hit).alias("successes"))


def inference_all(original: DataFrame, synthetic: DataFrame, control: DataFrame | None, id_col: str, numeric: list[str], categorical: list[str], n_attacks: int | None = None) -> DataFrame:
    """Rows (secret, attacks, successes, baseline_attacks, baseline_successes, control_attacks, control_successes): every column but the id is the secret once."""
    out = None
    for secret in [*numeric, *categorical]:
        aux = [c for c in numeric if c != secret], [c for c in categorical if c != secret]
        asked = sample_attacks(original.where(F.col(secret).isNotNull()), id_col, n_attacks)
        one = inference(asked, synthetic, id_col, *aux, secret, secret in numeric)
        base = inference_baseline(asked, synthetic, id_col, secret, secret in numeric).select(F.col("attacks").alias("baseline_attacks"), F.col("successes").alias("baseline_successes"))
        others = sample_attacks(control.where(F.col(secret).isNotNull()), id_col, n_attacks) if control is not None else None
        held = inference(others, synthetic, id_col, *aux, secret, secret in numeric).select(F.col("attacks").alias("control_attacks"), F.col("successes").alias("control_successes")) if others is not None else original.sparkSession.range(1).select(F.lit(0).cast("long").alias("control_attacks"), F.lit(0).cast("long").alias("control_successes"))
        row = one.crossJoin(base).crossJoin(held).select(F.lit(secret).alias("secret"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def inference_by_model(original: DataFrame, synthetic: DataFrame, id_col: str, numeric: list[str], categorical: list[str], secret: str, regression: bool = False, tolerance: float = 0.05) -> DataFrame:
    """(attacks, successes): the guess of a forest that was grown on synthetic rows; numbers count within the tolerance."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.regression import RandomForestRegressor

    known = lambda df: df.where(F.col(secret).isNotNull())
    count = lambda df, hit: df.agg(F.count("*").alias("attacks"), F.count_if(hit).alias("successes"))
    if regression:
        rows = lambda df: models.prepared(known(df), [*numeric, secret], categorical)
        forest = RandomForestRegressor(labelCol=secret, numTrees=20, maxDepth=6, seed=models.SEED)
        model = Pipeline(stages=[*models.features(numeric, categorical), forest]).fit(rows(synthetic))
        return count(model.transform(rows(original)), F.abs(F.col("prediction") - F.col(secret)) <= tolerance * F.abs(F.col(secret)))
    rows = lambda df: models.prepared(known(df), numeric, [*categorical, secret])
    index = StringIndexer(inputCol=secret, outputCol="label", handleInvalid="keep")
    model = Pipeline(stages=[index, *models.features(numeric, categorical), RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=6, seed=models.SEED)]).fit(rows(synthetic))
    return count(model.transform(rows(original)), F.col("prediction") == F.col("label"))


def _miss(n: int, k: int) -> float:
    """Chance that two sets of k of n rows have none in common."""
    miss = 1.0
    for i in range(k):
        miss *= max(n - k - i, 0) / max(n - i, 1)
    return miss


def linkability_baseline(original: DataFrame, synthetic: DataFrame, id_col: str, k: int) -> DataFrame:
    """(attacks, successes) expected when both sets of neighbours are random: 1 - C(n - k, k) / C(n, k) of the rows."""
    rows, miss = original.count(), _miss(synthetic.count(), k)
    return original.sparkSession.range(1).select(F.lit(rows).cast("long").alias("attacks"), F.lit(round(rows * (1 - miss))).cast("long").alias("successes"))


def linkability_random(original: DataFrame, synthetic: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """(attacks, successes) of random neighbours: whether two random sets meet is drawn for every row, by its hash."""
    miss = _miss(synthetic.count(), k)
    draw = F.conv(F.substring(split.hash_order(id_col, seed), 1, 12), 16, 10).cast("long") / float(1 << 48)
    return original.agg(F.count("*").alias("attacks"), F.count_if(draw >= miss).alias("successes"))


def success_rate(successes: Column, attacks: Column) -> tuple[Column, Column]:
    """Wilson rate and its error."""
    s, n = successes.cast("double"), attacks.cast("double")
    rate = ratio(s + Z * Z / 2, n + Z * Z)
    error = ratio(F.lit(Z), n + Z * Z) * F.sqrt(ratio(s * (n - s), n) + Z * Z / 4)
    return rate, error


def risk(main: tuple[Column, Column], control: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """Risk beyond the control attack, and its interval, within 0..1."""
    (m, e_m), (c, e_c) = main, control
    r = ratio(m - c, 1 - c)
    e = F.sqrt(F.pow(ratio(e_m, 1 - c), F.lit(2)) + F.pow(ratio((m - 1) * e_c, (1 - c) * (1 - c)), F.lit(2)))
    zero, one = F.lit(0.0), F.lit(1.0)
    return clip(r, zero, one), F.greatest(zero, r - e), F.least(one, r + e)


def risk_report(counts: DataFrame) -> DataFrame:
    """Rates, errors, risk and interval of columns successes, attacks, control_successes, control_attacks."""
    main, control = success_rate(F.col("successes"), F.col("attacks")), success_rate(F.col("control_successes"), F.col("control_attacks"))
    value, low, high = risk(main, control)
    return counts.select("*", main[0].alias("main_rate"), main[1].alias("main_error"), control[0].alias("control_rate"), control[1].alias("control_error"), value.alias("risk"), low.alias("risk_low"), high.alias("risk_high"))


def rates(spark: SparkSession, counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """What a report of risk shows, from (attacks, successes) of the main, the baseline and perhaps a control attack.

    The risk is what the main attack achieves beyond the control attack, or beyond the baseline without one.
    """
    beside = counts.get("control", counts["baseline"])
    names = "attacks long, successes long, control_attacks long, control_successes long, baseline_attacks long, baseline_successes long"
    report = risk_report(spark.createDataFrame([(*counts["main"], *beside, *counts["baseline"])], names))
    rate, error = success_rate(F.col("baseline_successes"), F.col("baseline_attacks"))
    row = report.withColumns({"baseline_rate": rate, "baseline_error": error}).first().asDict()
    kept = ["main_rate", "main_error", "baseline_rate", "baseline_error", "risk", "risk_low", "risk_high"] + ["control_rate", "control_error"] * ("control" in counts)
    return {name: row[name] for name in kept}
