"""Queries of the table evaluation operators, by name, with their SQL.

Rows with an even key are the real table, rows with an odd key the synthetic one. Doubles are rounded to six digits on
both sides, since sums are formed in different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.scalars import format_interval, format_value, word_length
from .operators import attacks, distance, divergence, encode, likelihood, models, privacy, profile, quality, report, split, synthesis

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "lineitem": "l_orderkey"}
ORDER_CATS = ["o_orderstatus", "o_orderpriority"]
LINE_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART_CATS, PART_NUMS = ["p_brand", "p_type"], ["p_size", "p_retailprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def halves(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    df, key = table(spark, sf_dir, name), F.col(KEYS[name])
    return df.where(key % 2 == 0), df.where(key % 2 == 1)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name; its result is rounded."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


# profiles

@query("SELECT 'c_acctbal' AS \"column\", min(c_acctbal) AS low, max(c_acctbal) AS high, round(median(c_acctbal), 6) AS median, 0.0::DOUBLE AS null_rate FROM customer")
def clean_and_profile(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return profile.ranges(df, ["c_acctbal"]).join(profile.null_rates(df, ["c_acctbal"]), "column")


@query(union([f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN o_orderkey % {m} = 0 THEN 1 ELSE 0 END), 6) AS null_rate FROM orders" for c, m in (("o_totalprice", 7), ("o_orderstatus", 5))]))
def null_rate_by_column(spark, sf_dir):
    return profile.null_rates(with_nulls(table(spark, sf_dir, "orders")), ["o_totalprice", "o_orderstatus"])


def with_nulls(df: DataFrame) -> DataFrame:
    return df.withColumns({"o_totalprice": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")), "o_orderstatus": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))})


@query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS s FROM orders),
m AS (SELECT median(p) AS p FROM n), f AS (SELECT s FROM n WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
SELECT n.o_orderkey, round(coalesce(n.p, m.p), 6) AS o_totalprice, coalesce(n.s, f.s) AS o_orderstatus FROM n, m, f""")
def impute_median_mode(spark, sf_dir):
    df = with_nulls(table(spark, sf_dir, "orders")).select("o_orderkey", "o_totalprice", "o_orderstatus")
    return profile.fill(df, profile.fill_values(df, ["o_totalprice"], ["o_orderstatus"]))


@query(union([f"SELECT '{c}' AS \"column\", max(length(split_part(CAST({c} AS VARCHAR), '.', 2))) AS places FROM lineitem" for c in LINE_NUMS]))
def decimal_places(spark, sf_dir):
    return profile.decimal_places(table(spark, sf_dir, "lineitem"), LINE_NUMS)


@query(union([f"SELECT '{c}' AS \"column\", bool_or({c} % 1 <> 0) AS is_continuous FROM lineitem" for c in LINE_NUMS]))
def is_continuous(spark, sf_dir):
    return profile.continuous(table(spark, sf_dir, "lineitem"), LINE_NUMS)


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS frequency FROM orders GROUP BY 1")
def value_frequencies(spark, sf_dir):
    return profile.frequencies(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT quality AS class, count(*) AS n, CAST(round(count(*) / (SELECT count(*) FROM labels) * 1000) AS BIGINT) AS num_rows FROM labels GROUP BY 1")
def class_quota(spark, sf_dir):
    return profile.class_quota(table(spark, sf_dir, "labels"), "quality", 1000)


# encoders

CODES = "WITH c AS (SELECT value, row_number() OVER (ORDER BY first, value) - 1 AS code FROM (SELECT {c} AS value, min({k}) AS first FROM {t} {w} GROUP BY 1))"


@query(CODES.format(c="c_mktsegment", k="c_custkey", t="customer", w="") + " SELECT c_custkey, code AS c_mktsegment FROM customer JOIN c ON c_mktsegment = value")
def label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return encode.encode_labels(df, "c_mktsegment", encode.label_codes(df, "c_mktsegment", "c_custkey"))


@query(CODES.format(c="p_brand", k="p_partkey", t="part", w="WHERE p_size < 10") + """, u AS (SELECT DISTINCT p_brand AS value FROM part WHERE p_brand NOT IN (SELECT value FROM c))
SELECT value, code FROM c UNION ALL SELECT value, (SELECT count(*) FROM c) + row_number() OVER (ORDER BY value) FROM u""")
def label_encode_unseen(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return encode.extend_codes(encode.label_codes(df.where("p_size < 10"), "p_brand", "p_partkey"), df, "p_brand")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def label_decode(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    codes = encode.label_codes(df, "c_mktsegment", "c_custkey")
    return encode.decode_labels(encode.encode_labels(df, "c_mktsegment", codes), "c_mktsegment", codes)


INTERVALS = """WITH g AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT value, n, sum(n) OVER (ORDER BY value) AS upto, sum(n) OVER () AS total FROM g),
i AS (SELECT value, n / total AS frequency, (upto - n) / total AS lo, upto / total AS hi FROM s)"""


@query(INTERVALS + " SELECT value, round(frequency, 6) AS frequency, round(lo, 6) AS lo, round(hi, 6) AS hi FROM i")
def uniform_intervals(spark, sf_dir):
    return encode.uniform_intervals(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(INTERVALS + " SELECT o_orderkey, value AS u FROM orders JOIN i ON (((o_orderkey % 101) / 101.0 > lo OR (lo = 0 AND (o_orderkey % 101) = 0)) AND (o_orderkey % 101) / 101.0 <= hi)")
def uniform_decode(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    points = df.select("o_orderkey", (F.col("o_orderkey") % 101 / F.lit(101.0)).alias("u"))
    intervals = encode.uniform_intervals(df, "o_orderpriority")
    return encode.uniform_decode(points, "u", intervals)


@query("SELECT 'p_brand' AS \"column\", count(DISTINCT p_brand) AS n, 1 + (CASE WHEN count(DISTINCT p_brand) + 1 > 26 THEN 1 ELSE 0 END) AS length FROM part")
def word_code_length(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.lit("p_brand").alias("column"), F.count_distinct("p_brand").alias("n")).withColumn("length", word_length(F.col("n")))


@query("SELECT value, CASE WHEN n >= 26 THEN chr(CAST(65 + r // 26 AS INT)) ELSE '' END || chr(CAST(65 + r % 26 AS INT)) AS word FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand AS value FROM part))")
def word_encode(spark, sf_dir):
    return encode.word_codes(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo), 6) AS s_acctbal FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)")
def minmax_scale(spark, sf_dir):
    return encode.minmax_scale(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")


@query("SELECT s_suppkey, round((s_acctbal - m) / sd, 6) AS s_acctbal FROM supplier, (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS sd FROM supplier)")
def standard_scale(spark, sf_dir):
    return encode.standard_scale(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")


@query("WITH q AS (SELECT quantile_cont(s_acctbal, [" + ", ".join(f"{k / 10}" for k in range(11)) + "]) AS q FROM supplier) SELECT s_suppkey, round((" + " + ".join(f"(CASE WHEN s_acctbal >= q[{k + 2}] THEN 1.0 WHEN s_acctbal <= q[{k + 1}] THEN 0.0 ELSE (s_acctbal - q[{k + 1}]) / (q[{k + 2}] - q[{k + 1}]) END)::DOUBLE" for k in range(10)) + ") / 10, 6) AS s_acctbal FROM supplier, q")
def quantile_scale(spark, sf_dir):
    return encode.quantile_scale(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")


# splits

RANKED = "SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) AS r, count(*) OVER (PARTITION BY {g}) AS n FROM orders"


@query("SELECT o_orderkey, r <= round(n * 0.8) AS is_train FROM (" + RANKED.format(g="o_orderstatus") + ")")
def stratified_split(spark, sf_dir):
    return split.stratified_split(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey").select("o_orderkey", "is_train")


@query("SELECT o_orderstatus, r <= round(n * 0.8) AS is_train, count(*) AS n FROM (" + RANKED.format(g="o_orderstatus") + ") GROUP BY 1, 2")
def stratified_split_counts(spark, sf_dir):
    return split.stratified_split(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey").groupBy("o_orderstatus", "is_train").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND r <= 100 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM (" + RANKED.format(g="o_orderstatus = 'O'") + ")")
def exact_count_renull(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.exact_renull(df, "o_orderstatus", "O", 100, "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM (" + RANKED.format(g="o_orderstatus") + ") WHERE r <= CASE o_orderstatus WHEN 'O' THEN 200 WHEN 'F' THEN 150 ELSE 50 END")
def ratio_adjust(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.ratio_adjust(df, "o_orderstatus", {"O": 200, "F": 150, "P": 50}, "o_orderkey")


# quality

def ks_sql(t: str, key: str, c: str) -> str:
    return f"""WITH g AS (SELECT {c} AS v, count(*) FILTER ({key} % 2 = 0) AS p, count(*) FILTER ({key} % 2 = 1) AS q FROM {t} GROUP BY 1),
s AS (SELECT sum(p) OVER (ORDER BY v) / sum(p) OVER () AS f, sum(q) OVER (ORDER BY v) / sum(q) OVER () AS h FROM g) SELECT '{c}' AS "column", round(1 - max(abs(f - h)), 6) AS score FROM s"""


def tv_sql(t: str, key: str, c: str) -> str:
    return f"""WITH g AS (SELECT {c} AS v, count(*) FILTER ({key} % 2 = 0) AS p, count(*) FILTER ({key} % 2 = 1) AS q FROM {t} GROUP BY 1),
s AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM g) SELECT '{c}' AS "column", round(1 - 0.5 * sum(abs(p - q)), 6) AS score FROM s"""


@query(union([ks_sql("orders", "o_orderkey", c) for c in ("o_totalprice",)]))
def ks_complement(spark, sf_dir):
    return quality.ks_complement(*halves(spark, sf_dir, "orders"), ["o_totalprice"])


@query(union([tv_sql("orders", "o_orderkey", c) for c in ORDER_CATS]))
def tv_complement(spark, sf_dir):
    return quality.tv_complement(*halves(spark, sf_dir, "orders"), ORDER_CATS)


@query(union([ks_sql("orders", "o_orderkey", "o_totalprice")] + [tv_sql("orders", "o_orderkey", c) for c in ORDER_CATS]))
def column_shapes(spark, sf_dir):
    return quality.column_shapes(*halves(spark, sf_dir, "orders"), ["o_totalprice"], ORDER_CATS)


def corr_sql(t: str, key: str, a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, round(1 - abs(corr({a}, {b}) FILTER ({key} % 2 = 0) - corr({a}, {b}) FILTER ({key} % 2 = 1)) / 2, 6) AS score FROM {t}"


def binned_sql(t: str, key: str, columns: list[str], others: list[str] = ()) -> str:
    """Table b of bins 0..9 of the real range, with is_real."""
    limits = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in columns)
    bins = [f"CAST(least(greatest(floor(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / 10)), 0), 9) AS INT) AS {c}" for c in columns]
    return f"WITH l AS (SELECT {limits} FROM {t} WHERE {key} % 2 = 0), b AS (SELECT {', '.join([*bins, *others])}, {key} % 2 = 0 AS is_real FROM {t}, l)"


def joint_sql(a: str, b: str, source: str) -> str:
    return f"SELECT {a} AS x, {b} AS y, count(*) FILTER (is_real) AS p, count(*) FILTER (NOT is_real) AS q FROM {source} GROUP BY 1, 2"


def joint_tv_sql(a: str, b: str, source: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, round(1 - 0.5 * sum(abs(p - q)), 6) AS score FROM (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM ({joint_sql(a, b, source)}))"


def joint_kl_sql(a: str, b: str, source: str) -> str:
    e = divergence.SMOOTHING
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(1 / (1 + sum(q * ln(q / p))), 6) AS score FROM (
SELECT (p / sum(p) OVER () + {e}) / (1 + {e} * count(*) OVER ()) AS p, (q / sum(q) OVER () + {e}) / (1 + {e} * count(*) OVER ()) AS q FROM ({joint_sql(a, b, source)}))"""


ORDERS_HALVES = "(SELECT *, o_orderkey % 2 = 0 AS is_real FROM orders)"


@query(union([corr_sql("lineitem", "l_orderkey", a, b) for a, b in combinations(LINE_NUMS, 2)]))
def correlation_similarity(spark, sf_dir):
    return quality.correlation_similarity(*halves(spark, sf_dir, "lineitem"), LINE_NUMS)


@query(joint_tv_sql(*ORDER_CATS, ORDERS_HALVES))
def contingency_similarity(spark, sf_dir):
    return quality.contingency_similarity(*halves(spark, sf_dir, "orders"), [tuple(ORDER_CATS)])


def _trends_sql() -> str:
    mixed = [p for p in combinations([*PART_NUMS, *PART_CATS], 2) if p != tuple(PART_NUMS)]
    return binned_sql("part", "p_partkey", PART_NUMS, PART_CATS) + union([corr_sql("part", "p_partkey", *PART_NUMS), *(joint_tv_sql(a, b, "b") for a, b in mixed)])


@query(_trends_sql())
def pair_trends(spark, sf_dir):
    return quality.pair_trends(*halves(spark, sf_dir, "part"), PART_NUMS, PART_CATS)


@query(f"""WITH shapes AS (SELECT avg(score) AS score FROM ({union([ks_sql('part', 'p_partkey', c) for c in PART_NUMS] + [tv_sql('part', 'p_partkey', c) for c in PART_CATS]).replace(', 6)', ', 15)')})),
trends AS (SELECT avg(score) AS score FROM ({_trends_sql().replace(', 6)', ', 15)')}))
SELECT 'Column Shapes' AS metric, round(score, 6) AS score FROM shapes UNION ALL SELECT 'Column Pair Trends', round(score, 6) FROM trends UNION ALL SELECT 'Overall Quality', round((shapes.score + trends.score) / 2, 6) FROM shapes, trends""")
def overall_quality(spark, sf_dir):
    return quality.overall_quality(*halves(spark, sf_dir, "part"), PART_NUMS, PART_CATS)


BOUNDS = "SELECT 'c_acctbal' AS \"column\", round(avg(CASE WHEN c_acctbal BETWEEN lo AND hi THEN 1 ELSE 0 END), 6) AS score FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_custkey % 2 = 0) WHERE c_custkey % 2 = 1"
ADHERES = "SELECT 'c_mktsegment' AS \"column\", round(avg(CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey % 2 = 0) THEN 1 ELSE 0 END), 6) AS score FROM customer WHERE c_custkey % 2 = 1"
UNIQUE = "SELECT 'c_custkey' AS \"column\", round(count(DISTINCT c_custkey) / count(c_custkey), 6) AS score FROM customer WHERE c_custkey % 2 = 1"


@query(BOUNDS)
def boundary_adherence(spark, sf_dir):
    return quality.boundary_adherence(*halves(spark, sf_dir, "customer"), ["c_acctbal"])


@query(ADHERES)
def category_adherence(spark, sf_dir):
    return quality.category_adherence(*halves(spark, sf_dir, "customer"), ["c_mktsegment"])


@query(UNIQUE)
def key_uniqueness(spark, sf_dir):
    return quality.key_uniqueness(halves(spark, sf_dir, "customer")[1], "c_custkey")


@query(union([BOUNDS, ADHERES, UNIQUE]))
def data_validity(spark, sf_dir):
    return quality.data_validity(*halves(spark, sf_dir, "customer"), ["c_acctbal"], ["c_mktsegment"], "c_custkey")


def new_rows_sql(match: str) -> str:
    return f"""WITH s AS (SELECT * FROM part WHERE p_partkey % 2 = 1), n AS (SELECT count(*) AS new_rows FROM s WHERE NOT EXISTS (SELECT 1 FROM part r WHERE r.p_partkey % 2 = 0 AND {match}))
SELECT new_rows, (SELECT count(*) FROM s) AS rows, round(new_rows / (SELECT count(*) FROM s), 6) AS score FROM n"""


@query(new_rows_sql("r.p_brand = s.p_brand AND r.p_type = s.p_type AND abs(s.p_size - r.p_size) <= 0.01 * abs(s.p_size)"))
def new_row_synthesis(spark, sf_dir):
    return quality.new_row_synthesis(*halves(spark, sf_dir, "part"), PART_CATS, ["p_size"])


@query(new_rows_sql("abs(s.p_retailprice - r.p_retailprice) <= 0.01 * abs(s.p_retailprice) AND abs(s.p_size - r.p_size) <= 0.01 * abs(s.p_size)"))
def new_row_numeric_band(spark, sf_dir):
    return quality.new_row_bands(*halves(spark, sf_dir, "part"), ["p_retailprice", "p_size"])


# divergence

@query(joint_kl_sql(*ORDER_CATS, ORDERS_HALVES))
def discrete_kl(spark, sf_dir):
    return divergence.discrete_kl(*halves(spark, sf_dir, "orders"), ORDER_CATS)


@query(binned_sql("lineitem", "l_orderkey", LINE_NUMS) + union([joint_kl_sql(a, b, "b") for a, b in combinations(LINE_NUMS, 2)]))
def continuous_kl(spark, sf_dir):
    return divergence.continuous_kl(*halves(spark, sf_dir, "lineitem"), LINE_NUMS)


@query(union([f"""SELECT '{c}' AS "column", round(sum((q - p) * (q - p) / p), 6) AS statistic, count(*) - 1 AS freedom FROM (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM (
SELECT {c}, count(*) FILTER (o_orderkey % 2 = 0) AS p, count(*) FILTER (o_orderkey % 2 = 1) AS q FROM orders GROUP BY 1)) WHERE p > 0""" for c in ORDER_CATS]))
def chi_square_stat(spark, sf_dir):
    return divergence.chi_square(*halves(spark, sf_dir, "orders"), ORDER_CATS)


# 3 and 5 levels: with 2 and 4 degrees of freedom the tail has a closed form
@query("SELECT \"column\", round(exp(-x / 2) * CASE WHEN freedom = 2 THEN 1 ELSE 1 + x / 2 END, 6) AS p_value FROM (" + union([f"""SELECT '{c}' AS "column", sum((q - p) * (q - p) / p) AS x, count(*) - 1 AS freedom FROM (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM (
SELECT {c}, count(*) FILTER (o_orderkey % 2 = 0) AS p, count(*) FILTER (o_orderkey % 2 = 1) AS q FROM orders GROUP BY 1)) WHERE p > 0""" for c in ORDER_CATS]) + ")")
def chi_square_p(spark, sf_dir):
    return divergence.chi_square_p(*halves(spark, sf_dir, "orders"), ORDER_CATS)


# likelihood

@query("""WITH g AS (SELECT p_brand AS x, p_type AS y, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS total FROM g)
SELECT 'p_brand' AS a, 'p_type' AS b, round(sum(n / total * ln(n * total / (nx * ny))), 6) AS information FROM t""")
def mutual_information(spark, sf_dir):
    return likelihood.mutual_information(table(spark, sf_dir, "part"), PART_CATS)


@query(f"""WITH r AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), root AS (SELECT o_orderstatus, count(*) / (SELECT count(*) FROM r) AS p FROM r GROUP BY 1),
c AS (SELECT o_orderstatus, o_orderpriority, count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS p FROM r GROUP BY 1, 2)
SELECT round(avg(coalesce(root.p, 0) * coalesce(c.p, 0)), 6) AS likelihood, round(avg(coalesce(ln(root.p), {likelihood.FLOOR}) + coalesce(ln(c.p), {likelihood.FLOOR})), 6) AS log_likelihood
FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 1) s LEFT JOIN root USING (o_orderstatus) LEFT JOIN c USING (o_orderstatus, o_orderpriority)""")
def bn_log_likelihood(spark, sf_dir):
    return likelihood.bn_likelihood(*halves(spark, sf_dir, "orders"), ORDER_CATS)


# attribution

PART_HALVES = "WITH r AS (SELECT p_partkey AS id, p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0), s AS (SELECT p_partkey AS id, p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 1)"
CAP_SQL = PART_HALVES + """, k AS (SELECT p_brand, p_size, count(*) AS n FROM s GROUP BY 1, 2), b AS (SELECT p_brand, p_size, p_type, count(*) AS m FROM s GROUP BY 1, 2, 3),
c AS (SELECT CASE WHEN n IS NOT NULL THEN coalesce(m, 0) / n END AS cap FROM r LEFT JOIN k USING (p_brand, p_size) LEFT JOIN b USING (p_brand, p_size, p_type))"""
CAP_ARGS = (["p_brand", "p_size"], ["p_type"])


@query(CAP_SQL + " SELECT round(1 - avg(cap), 6) AS score FROM c")
def cap(spark, sf_dir):
    return privacy.cap(*halves(spark, sf_dir, "part"), *CAP_ARGS)


@query(CAP_SQL + " SELECT round(1 - avg(coalesce(cap, 0)), 6) AS score FROM c")
def zero_cap(spark, sf_dir):
    return privacy.zero_cap(*halves(spark, sf_dir, "part"), *CAP_ARGS)


NEAR = PART_HALVES + """, d AS (SELECT r.id, r.p_type AS truth, s.p_type AS value, CAST(r.p_brand <> s.p_brand AS INT) + CAST(r.p_size <> s.p_size AS INT) AS d FROM r, s),
n AS (SELECT *, min(d) OVER (PARTITION BY id) AS nearest FROM d)"""


@query(NEAR + " SELECT round(1 - avg(cap), 6) AS score FROM (SELECT id, avg(CASE WHEN value = truth THEN 1.0 ELSE 0.0 END) AS cap FROM n WHERE d = nearest GROUP BY id)")
def generalized_cap(spark, sf_dir):
    return privacy.generalized_cap(*halves(spark, sf_dir, "part"), *CAP_ARGS)


@query(NEAR + """, v AS (SELECT id, truth, value, count(*) AS votes FROM n WHERE d = nearest GROUP BY 1, 2, 3), g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, value) AS k FROM v)
SELECT CAST(sum(CASE WHEN value = truth THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS rows, round(1 - avg(CASE WHEN value = truth THEN 1.0 ELSE 0.0 END), 6) AS score FROM g WHERE k = 1""")
def categorical_knn(spark, sf_dir):
    return privacy.categorical_knn(*halves(spark, sf_dir, "part"), CAP_ARGS[0], "p_type")


@query(PART_HALVES + """, pr AS (SELECT p_type AS g, count(*) AS n FROM s GROUP BY 1), al AS (SELECT sum(n) AS total, count(*) AS levels FROM pr),
b AS (SELECT p_brand, p_type AS g, count(*) AS nb FROM s GROUP BY 1, 2), z AS (SELECT p_size, p_type AS g, count(*) AS nz FROM s GROUP BY 1, 2),
l AS (SELECT count(DISTINCT p_brand) AS lb, count(DISTINCT p_size) AS lz FROM s),
q AS (SELECT r.id, r.p_type AS truth, pr.g, round(ln((n + 1) / (total + levels)) + ln((coalesce(nb, 0) + 1) / (n + lb)) + ln((coalesce(nz, 0) + 1) / (n + lz)), 9) AS v
FROM r CROSS JOIN pr CROSS JOIN al CROSS JOIN l LEFT JOIN b ON b.g = pr.g AND b.p_brand = r.p_brand LEFT JOIN z ON z.g = pr.g AND z.p_size = r.p_size), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, g) AS k FROM q)
SELECT CAST(sum(CASE WHEN g = truth THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS rows, round(1 - avg(CASE WHEN g = truth THEN 1.0 ELSE 0.0 END), 6) AS score FROM w WHERE k = 1""")
def categorical_nb(spark, sf_dir):
    return privacy.naive_bayes(*halves(spark, sf_dir, "part"), CAP_ARGS[0], "p_type")


@query()
def categorical_rf(spark, sf_dir):
    return models.forest_guess(*halves(spark, sf_dir, "part"), CAP_ARGS[0], "p_type")


# distances

SUPP = """WITH l AS (SELECT min(s_acctbal) AS a, max(s_acctbal) - min(s_acctbal) AS aw, min(s_nationkey) AS b, max(s_nationkey) - min(s_nationkey) AS bw FROM supplier WHERE s_suppkey % 2 = 0),
x AS (SELECT s_suppkey AS id, (s_acctbal - a) / aw AS u, (s_nationkey - b) / bw AS v FROM supplier, l)"""
SUPP_COLS = ["s_acctbal", "s_nationkey"]


def distance_sql(left: int, right: int) -> str:
    return f"""d AS (SELECT p.id, sqrt((p.u - q.u) * (p.u - q.u) + (p.v - q.v) * (p.v - q.v)) AS d FROM x p, x q WHERE p.id % 2 = {left} AND q.id % 2 = {right} AND p.id <> q.id),
k AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM d),
w AS (SELECT id, min(d) AS nearest, min(d) FILTER (r = 2) AS second, max(d) AS farthest, count(*) FILTER (d <= 1e-8) AS zeros FROM k GROUP BY id),
m AS (SELECT avg(nearest) FILTER (zeros = 0) AS mean, quantile_cont(nearest, 0.05) FILTER (zeros = 0) AS p05, quantile_cont(nearest / second, 0.05) FILTER (zeros = 0) AS nndr_p05, avg(farthest) FILTER (zeros = 0) AS mean_max, CAST(sum(zeros) AS BIGINT) AS zero_cells, count(*) FILTER (zeros > 0) AS removed_rows FROM w)"""


def one_distance(left: int, right: int, columns: str = "round(mean, 6) AS mean, round(p05, 6) AS p05, round(nndr_p05, 6) AS nndr_p05, round(mean_max, 6) AS mean_max, zero_cells, removed_rows") -> str:
    return f"{SUPP}, {distance_sql(left, right)} SELECT {columns} FROM m"


def supplier_distances(spark: SparkSession, sf_dir: str, left: int, right: int) -> DataFrame:
    both = halves(spark, sf_dir, "supplier")
    scaled = [distance.scaled(both[0], b, SUPP_COLS) for b in both]
    return distance.summary(distance.row_distances(scaled[left], scaled[right], "s_suppkey", SUPP_COLS, left == right))


@query(one_distance(0, 0))
def dcr_rr(spark, sf_dir):
    return supplier_distances(spark, sf_dir, 0, 0)


@query(one_distance(1, 1))
def dcr_ss(spark, sf_dir):
    return supplier_distances(spark, sf_dir, 1, 1)


@query(one_distance(0, 1))
def dcr_rs(spark, sf_dir):
    return supplier_distances(spark, sf_dir, 0, 1)


@query(one_distance(0, 1, "round(nndr_p05, 6) AS nndr_p05"))
def nndr_rs(spark, sf_dir):
    return supplier_distances(spark, sf_dir, 0, 1).select("nndr_p05")


@query(one_distance(0, 1, "zero_cells, removed_rows"))
def removed_points(spark, sf_dir):
    return supplier_distances(spark, sf_dir, 0, 1).select("zero_cells", "removed_rows")


@query(f"SELECT round(a.mean / b.mean_max, 6) AS score FROM ({one_distance(0, 1, 'mean')}) a, ({one_distance(0, 0, 'mean_max')}) b")
def distance_score(spark, sf_dir):
    return distance.distance_score(distance.distance_metrics(*halves(spark, sf_dir, "supplier"), "s_suppkey", SUPP_COLS))


# attacks

CUST = """WITH w AS (SELECT max(c_acctbal) - min(c_acctbal) AS aw, max(c_nationkey) - min(c_nationkey) AS nw FROM customer),
g AS (SELECT r.c_custkey AS id, s.c_custkey AS other, round((abs(r.c_acctbal - s.c_acctbal) / aw) / 1, 12) AS d1, round((abs(r.c_nationkey - s.c_nationkey) / nw + CAST(r.c_mktsegment <> s.c_mktsegment AS INT)) / 2, 12) AS d2
FROM customer r, customer s, w WHERE r.c_custkey % 2 = 0 AND s.c_custkey % 2 = 1)"""
AUX = ((["c_acctbal"], []), (["c_nationkey"], ["c_mktsegment"]))


@query(CUST + """, a AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d1, other) AS k1, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS k2 FROM g)
SELECT count(*) AS attacks, count(*) FILTER (hit) AS successes FROM (SELECT id, bool_or(k1 <= 10 AND k2 <= 10) AS hit FROM a GROUP BY id)""")
def linkability_success(spark, sf_dir):
    return attacks.linkability(*halves(spark, sf_dir, "customer"), "c_custkey", AUX, 10)


@query("""WITH w AS (SELECT max(c_acctbal) - min(c_acctbal) AS aw, max(c_nationkey) - min(c_nationkey) AS nw FROM customer),
g AS (SELECT r.c_custkey AS id, r.c_mktsegment AS truth, s.c_mktsegment AS guess, row_number() OVER (PARTITION BY r.c_custkey ORDER BY round((abs(r.c_acctbal - s.c_acctbal) / aw + abs(r.c_nationkey - s.c_nationkey) / nw) / 2, 12), s.c_custkey) AS k
FROM customer r, customer s, w WHERE r.c_custkey % 2 = 0 AND s.c_custkey % 2 = 1) SELECT count(*) AS attacks, count(*) FILTER (truth = guess) AS successes FROM g WHERE k = 1""")
def inference_success(spark, sf_dir):
    return attacks.inference(*halves(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], [], "c_mktsegment")


@query("""WITH r AS (SELECT p_retailprice AS v FROM part WHERE p_partkey % 2 = 0), s AS (SELECT p_retailprice AS v FROM part WHERE p_partkey % 2 = 1),
e AS (SELECT '=' AS kind, v AS value FROM s GROUP BY v HAVING count(*) = 1), p AS (SELECT kind, value, (SELECT count(*) FROM r WHERE v = value) AS matches FROM e
UNION ALL SELECT '<=', (SELECT min(v) FROM s), (SELECT count(*) FROM r WHERE v <= (SELECT min(v) FROM s)) UNION ALL SELECT '>=', (SELECT max(v) FROM s), (SELECT count(*) FROM r WHERE v >= (SELECT max(v) FROM s)))
SELECT 'p_retailprice' AS "column", kind, round(value, 6) AS value, matches, matches = 1 AS success FROM p""")
def singling_out_univariate(spark, sf_dir):
    return attacks.singling_out_univariate(*halves(spark, sf_dir, "part"), ["p_retailprice"])


@query("""WITH s AS (SELECT * FROM part WHERE p_partkey % 2 = 1), m AS (SELECT median(p_size) AS ms, median(p_retailprice) AS mp FROM s),
n AS (SELECT s.p_partkey, count(r.p_partkey) AS n FROM s CROSS JOIN m LEFT JOIN part r ON r.p_partkey % 2 = 0 AND r.p_brand = s.p_brand AND r.p_type = s.p_type
AND CASE WHEN s.p_size >= ms THEN r.p_size >= s.p_size ELSE r.p_size <= s.p_size END AND CASE WHEN s.p_retailprice >= mp THEN r.p_retailprice >= s.p_retailprice ELSE r.p_retailprice <= s.p_retailprice END GROUP BY 1)
SELECT count(*) AS attacks, count(*) FILTER (n = 1) AS successes FROM n""")
def singling_out_multivariate(spark, sf_dir):
    return attacks.singling_out_multivariate(*halves(spark, sf_dir, "part"), "p_partkey", PART_NUMS, PART_CATS)


Z2 = attacks.Z**2
RISK_COLS = ["main_rate", "main_error", "control_rate", "control_error", "risk", "risk_low", "risk_high"]


@query(f"""WITH c AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS successes, count(*) AS attacks, count(*) FILTER (o_orderstatus = 'P') AS control_successes, count(*) AS control_attacks FROM orders),
r AS (SELECT *, (successes + {Z2} / 2) / (attacks + {Z2}) AS m, {attacks.Z} / (attacks + {Z2}) * sqrt(successes * (attacks - successes) / attacks + {Z2} / 4) AS em,
(control_successes + {Z2} / 2) / (control_attacks + {Z2}) AS k, {attacks.Z} / (control_attacks + {Z2}) * sqrt(control_successes * (control_attacks - control_successes) / control_attacks + {Z2} / 4) AS ek FROM c),
v AS (SELECT *, (m - k) / (1 - k) AS x, sqrt(pow(em / (1 - k), 2) + pow((m - 1) * ek / pow(1 - k, 2), 2)) AS e FROM r)
SELECT successes, attacks, control_successes, control_attacks, round(m, 6) AS main_rate, round(em, 6) AS main_error, round(k, 6) AS control_rate, round(ek, 6) AS control_error,
round(least(greatest(x, 0), 1), 6) AS risk, round(greatest(0, x - e), 6) AS risk_low, round(least(1, x + e), 6) AS risk_high FROM v""")
def risk_interval(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return attacks.risk_report(df.agg(F.count_if(F.col("o_orderstatus") == "F").alias("successes"), F.count("*").alias("attacks"), F.count_if(F.col("o_orderstatus") == "P").alias("control_successes"), F.count("*").alias("control_attacks")))


# reports

RULE = "(SELECT quality AS truth, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS guess, n_chars // 500 AS score FROM labels JOIN documents USING (doc_id))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select(F.col("quality").alias("truth"), (F.col("n_chars") >= 1000).cast("int").alias("guess"), F.expr("n_chars div 500").alias("score"))


COUNTS = f"c AS (SELECT count(*) FILTER (truth = 1 AND guess = 1) AS tp, count(*) FILTER (truth <> 1 AND guess = 1) AS fp, count(*) FILTER (truth <> 1 AND guess <> 1) AS tn, count(*) FILTER (truth = 1 AND guess <> 1) AS fn FROM {RULE})"


@query(f"""WITH {COUNTS} SELECT *, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr, round(tn / (tn + fp), 6) AS tnr, round(fn / (fn + tp), 6) AS fnr, round(tp / (tp + fp), 6) AS ppv,
round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fn) - fp / (fp + tn), 6) AS advantage FROM c""")
def confusion_report(spark, sf_dir):
    return report.confusion(scored(spark, sf_dir), "truth", "guess")


@query(f"""WITH {COUNTS}, f AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1, 2 * tn / (2 * tn + fp + fn) AS f0, tp + fn AS n1, tn + fp AS n0 FROM c)
SELECT round(f1, 6) AS f1, round((f1 * n1 + f0 * n0) / (n1 + n0), 6) AS f1_weighted, round((f1 + f0) / 2, 6) AS f1_macro, round((tp / (tp + fp) + tn / (tn + fn)) / 2, 6) AS precision_macro,
round((tp / n1 + tn / n0) / 2, 6) AS recall_macro, round((tp + tn) / (n1 + n0), 6) AS accuracy, n0 AS support_0, n1 AS support_1 FROM f""")
def binary_f1_report(spark, sf_dir):
    return report.f1_report(scored(spark, sf_dir), "truth", "guess")


@query(f"""WITH g AS (SELECT score AS threshold, count(*) FILTER (truth = 1) AS pos, count(*) AS n FROM {RULE} GROUP BY 1), s AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS called, sum(pos) OVER () AS total FROM g)
SELECT threshold, round(tp / called, 6) AS "precision", round(tp / total, 6) AS recall FROM s""")
def pr_curve(spark, sf_dir):
    return report.pr_curve(scored(spark, sf_dir), "truth", "score")


LONG = "(SELECT 'Shapes' AS metric_type, o_orderpriority AS metric, o_orderstatus AS model_name, o_totalprice AS value FROM orders)"


def long_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.lit("Shapes").alias("metric_type"), F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("model_name"), F.col("o_totalprice").alias("value"))


@query(f"SELECT metric_type, metric, round(avg(value) FILTER (model_name = 'F'), 6) AS \"F\", round(avg(value) FILTER (model_name = 'O'), 6) AS \"O\" FROM {LONG} GROUP BY 1, 2")
def results_pivot(spark, sf_dir):
    return report.pivot_results(long_results(spark, sf_dir), ["F", "O"])


@query("SELECT s_suppkey, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE printf('%.5f', v) END AS text FROM (SELECT s_suppkey, s_suppkey / 4 AS v FROM supplier)")
def format_value_(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", format_value(F.col("s_suppkey") / F.lit(4.0)).alias("text"))


@query("SELECT s_suppkey, '(' || CAST(s_suppkey / 8 AS VARCHAR) || ', ' || CAST(s_suppkey / 4 AS VARCHAR) || ')' AS interval FROM supplier")
def format_interval_(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", format_interval(F.col("s_suppkey") / F.lit(8.0), F.col("s_suppkey") / F.lit(4.0)).alias("interval"))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS value FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def results_upsert(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return report.upsert(df.where("key % 2 = 0"), df.where("key % 3 = 0").withColumn("value", F.col("value") + 1), ["key"])


FAMILY_LIST = "[" + ", ".join(f"'{f}'" for f in report.FAMILIES) + "]"


@query(f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 < {len(report.FAMILIES)} THEN {FAMILY_LIST}[CAST(o_orderkey % 13 + 1 AS INT)] ELSE o_orderpriority END AS metric_type FROM orders)
SELECT metric_type, CAST(CASE WHEN list_contains({FAMILY_LIST}, metric_type) THEN list_position({FAMILY_LIST}, metric_type) ELSE {len(report.FAMILIES) + 1} END AS BIGINT) AS place, count(*) AS n FROM r GROUP BY ALL""")
def metric_order(spark, sf_dir):
    """Result rows of all families, and of others, by their place."""
    family = F.get(F.array(*map(F.lit, report.FAMILIES)), (F.col("o_orderkey") % 13).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.coalesce(family, "o_orderpriority").alias("metric_type"))
    return report.in_order(rows).groupBy("metric_type", F.col("place").cast("long").alias("place")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_retailprice, p_size FROM part t WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size >= t.p_size AND o.p_retailprice <= t.p_retailprice AND (o.p_size > t.p_size OR o.p_retailprice < t.p_retailprice))")
def pareto_front(spark, sf_dir):
    return report.pareto_front(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), "p_partkey", ["p_size"], ["p_retailprice"])


TOTAL = "SELECT p_partkey, (p_size - a) / (b - a) + 1 - (p_retailprice - c) / (d - c) AS total_score FROM part, (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)"


@query(f"SELECT p_partkey, round(total_score, 6) AS total_score FROM ({TOTAL})")
def total_score(spark, sf_dir):
    return report.total_score(table(spark, sf_dir, "part"), ["p_size"], ["p_retailprice"]).select("p_partkey", "total_score")


@query(f"SELECT p_partkey, round(total_score, 6) AS total_score FROM ({TOTAL}) ORDER BY total_score DESC, p_partkey LIMIT 1")
def best_trial(spark, sf_dir):
    return report.total_score(table(spark, sf_dir, "part"), ["p_size"], ["p_retailprice"]).select("p_partkey", "total_score").orderBy(F.desc("total_score"), "p_partkey").limit(1)


# leaves of forests: return flags stand for trees, ship modes' line numbers for leaves

@query("SELECT tree, leaf, dense_rank() OVER (ORDER BY tree, leaf) - 1 AS f_idx FROM (SELECT DISTINCT l_returnflag AS tree, l_linenumber AS leaf FROM lineitem)")
def ngroup_leaf(spark, sf_dir):
    return synthesis.leaf_numbers(_leaves(spark, sf_dir), "tree", "leaf")


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "tree", "l_linenumber": "leaf"})


@query(union([f"SELECT l_returnflag AS tree, l_linenumber AS leaf, '{c}' AS variable, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c}), 6) AS low, round(max({c}), 6) AS high, count({c}) AS n FROM lineitem GROUP BY 1, 2" for c in ("l_quantity", "l_discount")]))
def leaf_stats(spark, sf_dir):
    return synthesis.leaf_stats(_leaves(spark, sf_dir), ["tree", "leaf"], ["l_quantity", "l_discount"])


@query("""WITH g AS (SELECT l_returnflag AS tree, l_linenumber AS leaf, l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT tree, leaf, sum(n) AS total FROM g GROUP BY 1, 2), v AS (SELECT DISTINCT value FROM g)
SELECT t.tree, t.leaf, v.value, round((coalesce(n, 0) + 0.5) / (total + 0.5 * (SELECT count(*) FROM v)), 6) AS prob FROM t CROSS JOIN v LEFT JOIN g ON g.tree = t.tree AND g.leaf = t.leaf AND g.value = v.value""")
def level_probability(spark, sf_dir):
    return synthesis.level_probability(_leaves(spark, sf_dir), ["tree", "leaf"], "l_linestatus", 0.5)


# models: no SQL

ORDER_MODEL = (["o_totalprice"], ["o_orderpriority"])


def _with_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", (F.col("o_orderstatus") == "F").cast("int"))


@query()
def propensity(spark, sf_dir):
    return models.propensity(*halves(spark, sf_dir, "orders"), "o_orderkey", *ORDER_MODEL)


@query()
def utility_tstr(spark, sf_dir):
    real, synthetic = halves(spark, sf_dir, "orders")
    return models.utility(models.train_classifier(_with_target(synthetic), "target", *ORDER_MODEL), _with_target(real), "target", *ORDER_MODEL)


@query()
def mia_black_box(spark, sf_dir):
    members, others = halves(spark, sf_dir, "orders")
    return models.membership_attack(_with_target(members), _with_target(others), "target", *ORDER_MODEL, "o_orderkey")


@query()
def mia_shadow(spark, sf_dir):
    df = _with_target(table(spark, sf_dir, "orders"))
    third = F.col("o_orderkey") % 3
    return models.shadow_attack(df.where(third == 0), df.where(third == 1), df.where(third == 2), "target", *ORDER_MODEL, "o_orderkey")


@query()
def copula_sample(spark, sf_dir):
    model = synthesis.GaussianCopula(["o_totalprice"], ORDER_CATS)
    model.fit(table(spark, sf_dir, "orders"))
    return model.generate(1000)


@query()
def arf_sample(spark, sf_dir):
    model = synthesis.ForestDensity(["o_totalprice"], ORDER_CATS)
    model.fit(table(spark, sf_dir, "orders"))
    return model.generate(1000)


QUERIES["format_value"], SQL["format_value"] = QUERIES.pop("format_value_"), SQL.pop("format_value_")
QUERIES["format_interval"], SQL["format_interval"] = QUERIES.pop("format_interval_"), SQL.pop("format_interval_")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
