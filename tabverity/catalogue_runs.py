"""Queries of fitted transforms, draws, attacks, stored runs and searches over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import AUX, CUST, LINE_NUMS, ORDER_CATS, PART_HALVES, halves, query, table, union, with_nulls
from .operators import attacks, prepare, profile, report, split, synthesis
from .plans import runs, search
from .sources.tables import Roles, TableSet, shared_dir

SCALED = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]


@query(union([f"SELECT '{c}' AS \"column\", {s} AS share, round(quantile_cont({c}, {s}), 6) AS value FROM lineitem" for c in LINE_NUMS for s in SCALED]))
def exact_quantiles(spark, sf_dir):
    found = profile.exact_quantiles(table(spark, sf_dir, "lineitem"), LINE_NUMS, SCALED)
    return spark.createDataFrame([(c, s, v) for c, values in found.items() for s, v in zip(SCALED, values)], "column string, share double, value double")


# fitted transforms

@query("""WITH b AS (SELECT value, row_number() OVER (ORDER BY since, value) - 1 AS code FROM (SELECT c_mktsegment AS value, min(c_custkey) AS since FROM customer WHERE c_custkey <= 3 GROUP BY 1)),
u AS (SELECT value, (SELECT count(*) FROM b) + row_number() OVER (ORDER BY value) AS code FROM (SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN (SELECT value FROM b)))
SELECT c_custkey, code AS c_mktsegment FROM customer JOIN (SELECT * FROM b UNION ALL SELECT * FROM u) ON c_mktsegment = value""")
def label_codec_extended(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return prepare.LabelCodec(["c_mktsegment"], "c_custkey").fit(df.where("c_custkey <= 3")).extend(df).encode(df)


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def label_codec_stored(spark, sf_dir):
    """Codes written, read again, and turned back into values."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    codec = prepare.LabelCodec(["c_mktsegment", "c_nationkey"], "c_custkey").fit(df)
    path = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    codec.save(path)
    loaded = prepare.LabelCodec.load(spark, path)
    return loaded.decode(codec.encode(df)).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS p_type FROM part")
def word_codec(spark, sf_dir):
    """Every column but the label as words, and back; null has a word too."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("p_type"))
    codec = prepare.WordCodec("p_partkey").fit(df)
    return codec.decode(codec.encode(df))


LEVELS = """WITH n AS (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, 'NaN_Category') AS value FROM orders),
c AS (SELECT value, count(*) AS k FROM n GROUP BY 1),
l AS (SELECT value, k / sum(k) OVER () AS frequency, (sum(k) OVER w - k) / sum(k) OVER () AS lo, sum(k) OVER w / sum(k) OVER () AS hi FROM c WINDOW w AS (ORDER BY value = 'NaN_Category', value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
NEIGHBOURS = """f AS (SELECT frequency AS f FROM l WHERE value = 'NaN_Category'),
q AS (SELECT (SELECT list(value ORDER BY value) FROM l, f WHERE frequency = f AND value <> 'NaN_Category') AS same, (SELECT value FROM l, f WHERE frequency < f ORDER BY frequency DESC, value DESC LIMIT 1) AS below, (SELECT value FROM l, f WHERE frequency > f ORDER BY frequency, value LIMIT 1) AS above),
p AS (SELECT CASE WHEN len(same) > 1 THEN same[1] ELSE below END AS lower, CASE WHEN len(same) > 1 THEN same[2] WHEN len(same) = 1 THEN same[1] ELSE above END AS upper FROM q)"""


def _orders_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))


def _point(column: str):
    return (F.col("o_orderkey") % 997) / 997


@query(LEVELS + " SELECT value, round(frequency, 6) AS frequency, round(lo, 6) AS lo, round(hi, 6) AS hi FROM l")
def uniform_levels(spark, sf_dir):
    codec = prepare.UniformCodec(["o_orderpriority"]).fit(_orders_with_nulls(spark, sf_dir))
    return codec.frequencies("o_orderpriority").join(codec.intervals("o_orderpriority"), "value")


@query(LEVELS + " SELECT o_orderkey, round(lo + (o_orderkey % 997) / 997 * (hi - lo), 6) AS o_orderpriority FROM n JOIN l USING (value)")
def uniform_transform(spark, sf_dir):
    df = _orders_with_nulls(spark, sf_dir)
    return prepare.UniformCodec(["o_orderpriority"]).fit(df).transform(df, draw=_point)


@query("""WITH c AS (SELECT o_orderpriority AS value, count(*) AS k FROM orders WHERE o_orderpriority < '3' GROUP BY 1),
l AS (SELECT value, (sum(k) OVER w - k) / sum(k) OVER () AS lo, sum(k) OVER w / sum(k) OVER () AS hi, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM c WINDOW w AS (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT o_orderkey, round(x.lo + (o_orderkey % 997) / 997 * (x.hi - x.lo), 6) AS o_orderpriority FROM orders LEFT JOIN l ON o_orderpriority = l.value
JOIN l x ON x.i = coalesce(l.i, CAST(floor((o_orderkey % 10) / 10 * x.n) AS BIGINT))""")
def uniform_unseen(spark, sf_dir):
    """Levels that the fit hasn't seen have the interval of a random known level."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    codec = prepare.UniformCodec(["o_orderpriority"]).fit(df.where("o_orderpriority < '3'"))
    return codec.transform(df, draw=_point, choose=lambda c: (F.col("o_orderkey") % 10) / 10)


@query(LEVELS + f", {NEIGHBOURS} SELECT * FROM p")
def null_neighbours(spark, sf_dir):
    """The levels nearest in frequency that stand in for null."""
    return prepare.null_neighbours(prepare.UniformCodec(["o_orderpriority"]).fit(_orders_with_nulls(spark, sf_dir)).levels["o_orderpriority"])


@query(LEVELS + f""", {NEIGHBOURS}, x AS (SELECT o_orderkey, (o_orderkey % 997) / 997 AS x FROM orders)
SELECT o_orderkey, CASE WHEN value <> 'NaN_Category' THEN value WHEN x < (lo + hi) / 2 THEN lower ELSE upper END AS o_orderpriority FROM x, p JOIN l ON (x > lo OR (lo = 0 AND x = 0)) AND x <= hi""")
def uniform_inverse_filled(spark, sf_dir):
    df = _orders_with_nulls(spark, sf_dir)
    codec = prepare.UniformCodec(["o_orderpriority"]).fit(df)
    return codec.inverse(df.withColumn("o_orderpriority", _point("")), fill_nulls=True)


PRICES = """WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS s FROM orders), m AS (SELECT median(p) AS m FROM n),
c AS (SELECT value, row_number() OVER (ORDER BY since, value) - 1 AS code FROM (SELECT s AS value, min(o_orderkey) AS since FROM n WHERE s IS NOT NULL GROUP BY 1))"""


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_nulls(table(spark, sf_dir, "orders")).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(PRICES + " SELECT o_orderkey, round(coalesce(p, m), 6) AS o_totalprice, coalesce(code, (SELECT count(*) FROM c)) + 0.25::DOUBLE AS o_orderstatus FROM n CROSS JOIN m LEFT JOIN c ON s = value")
def continuous_transform(spark, sf_dir):
    df = _prices(spark, sf_dir)
    return prepare.ContinuousTransformer("o_orderkey").fit(df).transform(df, draw=lambda c: F.lit(0.25))


@query(PRICES + """, k AS (SELECT count(*) FILTER (p IS NULL) AS wanted, count(*) FILTER (coalesce(p, m) = m) AS have FROM n, m)
SELECT count(*) AS n_rows, (SELECT CASE WHEN have >= wanted THEN wanted ELSE have * have // wanted END FROM k) AS null_prices, count(*) FILTER (s IS NULL) AS null_states, count(*) FILTER (s = 'O') AS open_orders FROM n""")
def continuous_inverse(spark, sf_dir):
    df = _prices(spark, sf_dir)
    fitted = prepare.ContinuousTransformer("o_orderkey").fit(df)
    back = fitted.inverse(fitted.transform(df, draw=lambda c: F.lit(0.25)))
    return back.agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_totalprice").isNull()).alias("null_prices"), F.count_if(F.col("o_orderstatus").isNull()).alias("null_states"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"))


@query(PRICES + """, f AS (SELECT s FROM n WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1), x AS (SELECT coalesce(n.p, m) AS p, coalesce(n.s, f.s) AS s FROM n, m, f),
g AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT s FROM x))
SELECT count(*) AS n_rows, round(min(p), 6) AS low, round(max(p), 6) AS high, round(sum(p), 2) AS total, round(avg(code / (SELECT max(code) FROM g)), 6) AS mean_state FROM x JOIN g USING (s)""")
def imputer_round_trip(spark, sf_dir):
    """Ranks turned back into prices; levels as codes in 0..1."""
    df = _prices(spark, sf_dir).select("o_totalprice", "o_orderstatus")
    fitted = prepare.Imputer().fit(df)
    scaled = fitted.transform(df)
    prices = fitted.inverse(scaled, draw=lambda c: F.lit(1.0)).agg(F.count("*").alias("n_rows"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return prices.crossJoin(scaled.agg(F.avg("o_orderstatus").alias("mean_state")))


@query(PRICES + """, f AS (SELECT s FROM n WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
SELECT count(*) FILTER (round(coalesce(n.p, m), 2) = m) AS null_prices, count(*) FILTER (coalesce(n.s, f.s) = f.s) AS null_states FROM n, m, f""")
def imputer_renull(spark, sf_dir):
    """With a draw of 0 every cell that holds the fill value is null again."""
    df = _prices(spark, sf_dir).select("o_totalprice", "o_orderstatus")
    fitted = prepare.Imputer().fit(df)
    back = fitted.inverse(fitted.transform(df), draw=lambda c: F.lit(0.0))
    return back.agg(F.count_if(F.col("o_totalprice").isNull()).alias("null_prices"), F.count_if(F.col("o_orderstatus").isNull()).alias("null_states"))


@query("SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS o_custkey, o_orderstatus FROM orders")
def cast_back(spark, sf_dir):
    """Columns back in the types of a schema where all values can be cast: a price as whole number, a text not."""
    df = table(spark, sf_dir, "orders")
    wanted = df.select("o_orderkey", "o_custkey", F.col("o_custkey").alias("o_orderstatus")).schema
    return prepare.keep_types_or_as_is(df.select("o_orderkey", F.col("o_totalprice").alias("o_custkey"), "o_orderstatus"), wanted)


# draws

HASHED = "SELECT *, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders"


@query(f"SELECT o_orderkey, i < n // 2 AS is_first FROM ({HASHED})")
def half_split(spark, sf_dir):
    return split.half_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT o_orderkey, i AS \"index\" FROM ({HASHED})")
def shuffled_index(spark, sf_dir):
    return split.dense_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"""WITH h AS ({HASHED}), d AS (SELECT draw, CAST('0x' || substr(md5(CAST(draw AS VARCHAR) || ':42'), 1, 12) AS BIGINT) % (SELECT count(*) FROM orders) AS i FROM range(1000) t(draw))
SELECT o_orderstatus, count(*) AS n FROM d JOIN h USING (i) GROUP BY 1""")
def resampled_levels(spark, sf_dir):
    """1000 rows drawn with replacement, counted by value."""
    return split.resample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def head_rows(spark, sf_dir):
    return split.head_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


# attacks

@query(CUST + """, v AS (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':42'), c_custkey LIMIT 50), k AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS r FROM g WHERE id IN (SELECT c_custkey FROM v)),
x AS (SELECT abs(s.c_acctbal - t.c_acctbal) <= 0.05 * abs(t.c_acctbal) AS hit FROM k JOIN customer t ON t.c_custkey = id JOIN customer s ON s.c_custkey = other WHERE r = 1)
SELECT count(*) AS attacks, count(*) FILTER (hit) AS successes FROM x""")
def inference_sampled(spark, sf_dir):
    """The nearest synthetic row's balance as the guess for 50 attacked rows."""
    real, synthetic = halves(spark, sf_dir, "customer")
    asked = attacks.sample_attacks(real, "c_custkey", 50)
    return attacks.inference(asked, synthetic, "c_custkey", AUX[1][0], AUX[1][1], "c_acctbal", True)


@query("""WITH s AS (SELECT c_mktsegment AS guess, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':42'), c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer WHERE c_custkey % 2 = 1),
r AS (SELECT c_mktsegment AS truth, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || ':42'), 1, 12) AS BIGINT) % (SELECT max(n) FROM s) AS i FROM customer WHERE c_custkey % 2 = 0)
SELECT count(*) AS attacks, count(*) FILTER (guess = truth) AS successes FROM r JOIN s USING (i)""")
def inference_baseline(spark, sf_dir):
    return attacks.inference_baseline(*halves(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment")


@query("SELECT count(*) FILTER (c_custkey % 2 = 0) AS attacks, CAST(round(count(*) FILTER (c_custkey % 2 = 0) * (1 - (SELECT product((m - 10 - i) / (m - i)) FROM (SELECT count(*) AS m FROM customer WHERE c_custkey % 2 = 1), range(10) t(i)))) AS BIGINT) AS successes FROM customer")
def linkability_baseline(spark, sf_dir):
    return attacks.linkability_baseline(*halves(spark, sf_dir, "customer"), "c_custkey", 10)


@query()
def inference_all_columns(spark, sf_dir):
    real, synthetic = halves(spark, sf_dir, "supplier")
    return attacks.inference_all(real, synthetic, None, "s_suppkey", ["s_acctbal"], ["s_nationkey"])


@query()
def inference_by_model(spark, sf_dir):
    return attacks.inference_by_model(*halves(spark, sf_dir, "part"), "p_partkey", ["p_size"], ["p_brand"], "p_type")


# results and runs

RESULT_SQL = """SELECT o_orderpriority AS metric_type, o_orderstatus AS metric, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS model_name,
CASE WHEN o_orderstatus = 'P' THEN 'up to ' || o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END AS value FROM orders"""


@query(f"""WITH r AS ({RESULT_SQL}), c AS (SELECT metric_type, metric, model_name, avg(TRY_CAST(value AS DOUBLE)) AS mean, min(value) AS text, bool_or(TRY_CAST(value AS DOUBLE) IS NULL) AS is_text FROM r GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN is_text THEN text WHEN mean = floor(mean) THEN CAST(CAST(mean AS BIGINT) AS VARCHAR) ELSE printf('%.5f', mean) END AS shown FROM c)
SELECT metric_type, metric, max(shown) FILTER (model_name = 'even') AS even, max(shown) FILTER (model_name = 'odd') AS odd FROM s GROUP BY 1, 2""")
def typed_pivot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("up to "), "o_orderstatus")).otherwise(F.col("o_custkey").cast("string"))
    rows = orders.select(F.col("o_orderpriority").alias("metric_type"), F.col("o_orderstatus").alias("metric"), F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("model_name"), value.alias("value"))
    return report.typed_pivot(rows, ["even", "odd"])


def _parts(spark: SparkSession, sf_dir: str) -> TableSet:
    real, synthetic = (df.select("p_partkey", "p_brand", "p_type", "p_size") for df in halves(spark, sf_dir, "part"))
    return TableSet(real, {"odd": synthetic}, None, Roles(id="p_partkey", key_fields=("p_brand",), sensitive_fields=("p_type",)))


NEW_ROWS = """(SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM part r WHERE r.p_partkey % 2 = 0 AND r.p_brand = s.p_brand AND r.p_type = s.p_type AND abs(s.p_size - r.p_size) <= 0.01 * abs(s.p_size)) THEN 0.0 ELSE 1.0 END) FROM part s WHERE s.p_partkey % 2 = 1)"""
MEAN_VALID = "(SELECT avg(score) FROM (" + union([
    "SELECT avg(CASE WHEN p_size BETWEEN lo AND hi THEN 1 ELSE 0 END) AS score FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part WHERE p_partkey % 2 = 0) WHERE p_partkey % 2 = 1",
    *(f"SELECT avg(CASE WHEN {c} IN (SELECT {c} FROM part WHERE p_partkey % 2 = 0) THEN 1 ELSE 0 END) FROM part WHERE p_partkey % 2 = 1" for c in ("p_brand", "p_type")),
    "SELECT count(DISTINCT p_partkey) / count(*) FROM part WHERE p_partkey % 2 = 1",
]) + "))"


@query(f"SELECT 'Basic Quality' AS metric_type, 'Data Validity' AS metric, 'odd' AS model_name, round({MEAN_VALID}, 6) AS value, 'ok' AS status UNION ALL SELECT 'Basic Quality', 'New Row Synthesis', 'odd', round({NEW_ROWS}, 6), 'ok'")
def stored_run(spark, sf_dir):
    """A run narrowed to one metric, widened to two, and found again: every metric is computed once."""
    tables, store = _parts(spark, sf_dir), runs.Store(spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}")
    store.save_config({"families": ["Basic Quality"], "mode": runs.parse_mode("Run All")})
    for wanted in (["Data Validity"], ["Data Validity", "New Row Synthesis"], ["New Row Synthesis"]):
        found = runs.run_synthetic(tables, store, [*store.config()["families"], "No such thing"], {"Basic Quality": wanted})
    return found.where(runs.of_family("Basic")).drop("inputs")


@query("SELECT 'Inference' AS metric_type, 'Inference' AS metric, 'odd' AS model_name, NULL::DOUBLE AS value, true AS is_failed")
def failed_status(spark, sf_dir):
    """A family that can't be computed leaves a row with its status."""
    parts = _parts(spark, sf_dir)
    rows = runs.compute(TableSet(parts.real, parts.synthetic, None, Roles(id="p_partkey", secret="p_absent")), "Inference", "odd")
    return rows.select("metric_type", "metric", "model_name", "value", F.col("status").startswith("failed").alias("is_failed"))


MENDED = PART_HALVES + """, k AS (SELECT p_brand, count(*) AS n FROM s GROUP BY 1), b AS (SELECT p_brand, p_type, count(*) AS m FROM s GROUP BY 1, 2),
c AS (SELECT CASE WHEN n IS NOT NULL THEN coalesce(m, 0) / n END AS cap FROM r LEFT JOIN k USING (p_brand) LEFT JOIN b USING (p_brand, p_type))"""


@query(f"{MENDED} SELECT 'Privacy Against Inference' AS metric_type, 'CategoricalCAP' AS metric, round(1 - avg(cap), 6) AS value, 'ok' AS status FROM c UNION ALL SELECT 'Privacy Against Inference', 'CategoricalZeroCAP', round(1 - avg(coalesce(cap, 0)), 6), 'ok' FROM c")
def mended_run(spark, sf_dir):
    """Metrics that failed for a missing column are computed by the next run, whose roles are right; the failures go."""
    tables, store = _parts(spark, sf_dir), runs.Store(spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}")
    names, wanted = ["Privacy Against Inference"], {"Privacy Against Inference": ["CategoricalCAP", "CategoricalZeroCAP"]}
    runs.run_synthetic(replace(tables, roles=replace(tables.roles, key_fields=("p_absent",))), store, names, wanted)
    return runs.run_synthetic(tables, store, names, wanted).select("metric_type", "metric", "value", "status")


@query("SELECT count(*) // 2 AS real_rows, count(*) - count(*) // 2 AS synthetic_rows FROM part WHERE p_partkey % 2 = 0")
def original_baseline(spark, sf_dir):
    """The real table's two halves, as the baseline compares them."""
    tables = runs.original_halves(_parts(spark, sf_dir))
    return tables.real.agg(F.count("*").alias("real_rows")).crossJoin(tables.synthetic["Original"].agg(F.count("*").alias("synthetic_rows")))


@query()
def original_baseline_scores(spark, sf_dir):
    store = runs.Store(spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}")
    return runs.run_original(_parts(spark, sf_dir), store, ["Utility", "Basic Quality", "Advanced Quality"]).drop("inputs")


class Part:
    """A synthesizer that returns the rows whose size is at most a bound: known answers for searches."""

    def __init__(self, most: int) -> None:
        self.name, self.most = "part", most

    def fit(self, df: DataFrame) -> None:
        self.df = df

    def generate(self, rows: int, conditions: dict | None = None) -> DataFrame:
        return self.df.where(F.col("p_size") <= self.most)


@query("SELECT 2::BIGINT AS trial, 'part' AS model, count(*) AS n_rows FROM part WHERE p_partkey % 2 = 0 AND p_size <= 50")
def grid_search(spark, sf_dir):
    """The bound that keeps all rows has the best quality; its table is copied and counted."""
    tables, path = _parts(spark, sf_dir), f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    space = search.Space({"part": Part}, {"part": {"most": [5, 20, 50]}})
    found = search.grid_search(TableSet(tables.real, {}, None, tables.roles), space, {"Basic Quality": ["Column Shapes", "Column Pair Trends"]}, path)
    best = found.limit(1)
    kept = spark.read.parquet(search.keep_best(tables, best, path))
    return best.select("trial", "model").crossJoin(kept.agg(F.count("*").alias("n_rows")))


@query()
def genetic_search(spark, sf_dir):
    tables, path = _parts(spark, sf_dir), f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    space = search.Space({"part": Part}, {"part": {"most": [5, 20, 50]}})
    return search.genetic_search(TableSet(tables.real, {}, None, tables.roles), space, {"Basic Quality": ["Column Shapes"]}, path, n_trials=5)


# synthesis

QUOTAS = "SELECT o_orderstatus, CAST(round(count(*) / (SELECT count(*) FROM orders) * 300) AS BIGINT) AS n FROM orders GROUP BY 1"


def _quotas(spark: SparkSession, sf_dir: str) -> dict[object, int]:
    return {r["class"]: r["num_rows"] for r in profile.class_quota(table(spark, sf_dir, "orders"), "o_orderstatus", 300).collect()}  # one row a class


@query(QUOTAS)
def copula_by_quota(spark, sf_dir):
    """300 synthetic rows in the classes' shares."""
    model = synthesis.GaussianCopula(["o_totalprice"], ORDER_CATS, target="o_orderstatus")
    model.fit(table(spark, sf_dir, "orders"))
    return model.generate(300, _quotas(spark, sf_dir)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(QUOTAS)
def forest_by_quota(spark, sf_dir):
    model = synthesis.ForestDensity(["o_totalprice"], ORDER_CATS, trees=5, rounds=1, target="o_orderstatus")
    model.fit(table(spark, sf_dir, "orders"))
    return model.generate(300, _quotas(spark, sf_dir)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT true AS within, true AS large, true AS sums_to_one")
def forest_leaves(spark, sf_dir):
    """Leaves after pruning: observed values lie within their bounds, none has under 20 rows, coverages sum to 1."""
    model = synthesis.ForestDensity(["o_totalprice"], ORDER_CATS, trees=5, rounds=1, min_node_size=20)
    model.fit(table(spark, sf_dir, "orders"))
    stats = model.stats.agg(F.bool_and((F.col("low") <= F.col("mean") + 1e-6) & (F.col("mean") <= F.col("high") + 1e-6)).alias("within"))
    return stats.crossJoin(model.coverage.agg((F.min("n") >= 20).alias("large"), (F.abs(F.sum("coverage") - 1) < 1e-9).alias("sums_to_one")))
