"""Queries of the attacks as a whole run reports them, and of searches for nearest rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import PART_CATS, PART_NUMS, halves, query, table, union
from .operators import attacks, singling
from .plans import evaluate
from .sources.tables import Options, Roles, TableSet

# singling out over drawn columns: 60 attacks, 3 of 4 columns

DRAWN = PART_NUMS + PART_CATS
COLUMN_LIST = ", ".join(f"('{c}', {k})" for k, c in enumerate(DRAWN))
FITS = " AND ".join(
    f"(NOT list_contains(cols, {k}) OR CASE WHEN t.{c} >= m_{c} THEN x.{c} >= t.{c} ELSE x.{c} <= t.{c} END)" if c in PART_NUMS else f"(NOT list_contains(cols, {k}) OR x.{c} = t.{c})" for k, c in enumerate(DRAWN)
)
SINGLING = f"""WITH s AS (SELECT * FROM part WHERE p_partkey % 2 = 1), r AS (SELECT * FROM part WHERE p_partkey % 2 = 0), m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in PART_NUMS)} FROM s),
tried AS (SELECT *, md5(p_partkey || ':42') AS place FROM s ORDER BY place, p_partkey LIMIT 240),
cols AS (SELECT p_partkey, list(k ORDER BY k) AS cols FROM (SELECT p_partkey, k, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(p_partkey || ':' || c || ':42')) AS n FROM tried, (VALUES {COLUMN_LIST}) v(c, k)) WHERE n <= 3 GROUP BY 1),
t AS (SELECT tried.*, cols, m.* FROM tried JOIN cols USING (p_partkey), m),
alone AS (SELECT t.p_partkey, t.place FROM t JOIN s x ON {FITS} GROUP BY 1, 2 HAVING count(*) = 1 ORDER BY place, t.p_partkey LIMIT 60),
found AS (SELECT t.p_partkey, cols, count(x.p_partkey) AS n FROM t JOIN alone USING (p_partkey) LEFT JOIN r x ON {FITS} GROUP BY 1, 2)"""


def _drawn_attacks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    real, synthetic = halves(spark, sf_dir, "part")
    asks = singling.singling_predicates(synthetic, "p_partkey", PART_NUMS, PART_CATS, 60, 3, rounds=1)
    return asks, singling.count_matches(real, asks, PART_NUMS, PART_CATS)


@query(SINGLING + " SELECT '42:' || p_partkey AS attack, array_to_string(cols, ',') AS cols, CAST(least(n, 2) AS INT) AS matches FROM found")
def singling_out_random_columns(spark, sf_dir):
    """Every attack with its drawn columns and the real rows that fit, counted up to 2."""
    return _drawn_attacks(spark, sf_dir)[1].select("attack", F.array_join(F.transform("terms", lambda t: t["col"].cast("string")), ",").alias("cols"), "matches")


@query(SINGLING + " SELECT count(*) AS attacks, count(*) FILTER (n = 1) AS successes FROM found")
def singling_out_drawn(spark, sf_dir):
    return singling.tally(_drawn_attacks(spark, sf_dir)[1])


NAIVE_FITS = " AND ".join(
    f"(NOT list_contains(cols, {k}) OR CASE WHEN sides[list_position(cols, {k})] = 0 THEN x.{c} >= v_{c} ELSE x.{c} <= v_{c} END)" if c in PART_NUMS else f"(NOT list_contains(cols, {k}) OR x.{c} = v_{c})" for k, c in enumerate(DRAWN)
)


@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY md5(p_partkey || ':42'), p_partkey) - 1 AS i FROM part WHERE p_partkey % 2 = 1), r AS (SELECT * FROM part WHERE p_partkey % 2 = 0),
d AS (SELECT a, k, CAST('0x' || substr(h, 9, 12) AS BIGINT) % (SELECT count(*) FROM s) AS i, CAST('0x' || substr(h, 21, 1) AS BIGINT) % 2 AS side, row_number() OVER (PARTITION BY a ORDER BY h) AS n FROM (SELECT a, k, md5(a || ':' || c || ':42') AS h FROM range(300) t(a), (VALUES {COLUMN_LIST}) v(c, k))),
t AS (SELECT a, list(k ORDER BY k) AS cols, list(side ORDER BY k) AS sides, {', '.join(f'max(CASE WHEN k = {k} THEN {c} END) AS v_{c}' for k, c in enumerate(DRAWN))} FROM d JOIN s USING (i) WHERE n <= 3 GROUP BY 1),
f AS (SELECT a, count(x.p_partkey) AS n FROM t LEFT JOIN r x ON {NAIVE_FITS} GROUP BY 1) SELECT count(*) AS attacks, count(*) FILTER (n = 1) AS successes FROM f""")
def singling_out_naive(spark, sf_dir):
    """What guessing without any synthetic row achieves: values of drawn rows over drawn columns."""
    real, synthetic = halves(spark, sf_dir, "part")
    asks = singling.naive_predicates(synthetic, "p_partkey", PART_NUMS, PART_CATS, 300, 3)
    return singling.tally(singling.count_matches(real, asks, PART_NUMS, PART_CATS))


# whole risk reports: the attack, a baseline and a control attack

def _customers(spark: SparkSession, sf_dir: str) -> TableSet:
    third = F.col("c_custkey") % 3
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    roles = Roles(id="c_custkey", aux=(("c_acctbal",), ("c_nationkey", "c_mktsegment")))
    return TableSet(df.where(third == 0), {"made": df.where(third == 1)}, df.where(third == 2), roles, Options(linkability_neighbours=10, linkability_attacks=200, inference_columns=("c_mktsegment", "c_nationkey"), inference_attacks=150, inference_model=False))


def _asked(part: int, n: int) -> str:
    return f"(SELECT * FROM customer WHERE c_custkey % 3 = {part} ORDER BY md5(c_custkey || ':42'), c_custkey LIMIT {n})"


def _rates_sql(counts: str) -> str:
    """Rates of rows (metric_type, kind, attacks, successes): main, baseline and control."""
    z, zz = attacks.Z, attacks.Z**2
    return f"""r AS (SELECT metric_type, kind, (successes + {zz} / 2) / (attacks + {zz}) AS rate, {z} / (attacks + {zz}) * sqrt(successes * (attacks - successes) / attacks + {zz} / 4) AS error FROM ({counts})),
w AS (SELECT m.metric_type, m.rate AS main_rate, m.error AS main_error, b.rate AS baseline_rate, b.error AS baseline_error, c.rate AS control_rate, c.error AS control_error FROM r m JOIN r b ON b.metric_type = m.metric_type AND b.kind = 'baseline' JOIN r c ON c.metric_type = m.metric_type AND c.kind = 'control' WHERE m.kind = 'main'),
e AS (SELECT *, (main_rate - control_rate) / (1 - control_rate) AS x, sqrt(pow(main_error / (1 - control_rate), 2) + pow((main_rate - 1) * control_error / pow(1 - control_rate, 2), 2)) AS y FROM w),
a AS (SELECT metric_type, main_rate, main_error, baseline_rate, baseline_error, control_rate, control_error, least(greatest(x, 0), 1) AS risk, greatest(0, x - y) AS risk_low, least(1, x + y) AS risk_high FROM e)
SELECT metric_type, metric, round(value, 6) AS value FROM (UNPIVOT a ON COLUMNS(* EXCLUDE metric_type) INTO NAME metric VALUE value)"""


def _linked(part: int) -> str:
    return f"""SELECT count(*) AS attacks, count(*) FILTER (hit) AS successes FROM (SELECT id, bool_or(k1 <= 10 AND k2 <= 10) AS hit FROM (
SELECT id, row_number() OVER (PARTITION BY id ORDER BY d1, other) AS k1, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS k2 FROM (SELECT r.c_custkey AS id, s.c_custkey AS other, round(abs(r.c_acctbal - s.c_acctbal) / w1, 12) AS d1,
round((abs(r.c_nationkey - s.c_nationkey) / w2 + CAST(r.c_mktsegment <> s.c_mktsegment AS INT)) / 2, 12) AS d2 FROM {_asked(part, 200)} r, s, (SELECT max(c_acctbal) - min(c_acctbal) AS w1, max(c_nationkey) - min(c_nationkey) AS w2 FROM (SELECT * FROM {_asked(part, 200)} UNION ALL SELECT * FROM s)))) GROUP BY id)"""


@query(f"""WITH s AS (SELECT * FROM customer WHERE c_custkey % 3 = 1), p AS (SELECT product((n - 10 - i) / (n - i)) AS miss FROM (SELECT count(*) AS n FROM s), range(10) t(i)),
{_rates_sql(f"SELECT 'Linkability' AS metric_type, 'main' AS kind, * FROM ({_linked(0)}) UNION ALL SELECT 'Linkability', 'control', * FROM ({_linked(2)}) UNION ALL SELECT 'Linkability', 'baseline', count(*), count(*) FILTER (CAST('0x' || substr(md5(c_custkey || ':42'), 1, 12) AS BIGINT) / 281474976710656 >= miss) FROM {_asked(0, 200)}, p")}""")
def linkability_report(spark, sf_dir):
    """Limited attacks on real and control rows, and random neighbours as the baseline."""
    return evaluate.compute(_customers(spark, sf_dir), "Linkability", "made").select("metric_type", "metric", "value")


def _guessed(part: int, secret: str, aux: str) -> str:
    distance = {"c_nationkey": "abs(r.c_nationkey - s.c_nationkey) / w", "c_mktsegment": "CAST(r.c_mktsegment <> s.c_mktsegment AS INT)"}[aux]
    hit = {"c_nationkey": "abs(guess - truth) <= 0.05 * abs(truth)", "c_mktsegment": "guess = truth"}[secret]
    return f"""SELECT count(*) AS attacks, count(*) FILTER ({hit}) AS successes FROM (SELECT r.{secret} AS truth, s.{secret} AS guess, row_number() OVER (PARTITION BY r.c_custkey ORDER BY round({distance}, 12), s.c_custkey) AS k
FROM {_asked(part, 150)} r, s, (SELECT max(c_nationkey) - min(c_nationkey) AS w FROM (SELECT * FROM {_asked(part, 150)} UNION ALL SELECT * FROM s))) WHERE k = 1"""


def _random_guess(secret: str) -> str:
    hit = {"c_nationkey": "abs(guess - truth) <= 0.05 * abs(truth)", "c_mktsegment": "guess = truth"}[secret]
    return f"""SELECT count(*) AS attacks, count(*) FILTER ({hit}) AS successes FROM (SELECT {secret} AS truth, CAST('0x' || substr(md5(c_custkey || ':42'), 1, 12) AS BIGINT) % (SELECT count(*) FROM s) AS i FROM {_asked(0, 150)})
JOIN (SELECT {secret} AS guess, row_number() OVER (ORDER BY md5(c_custkey || ':42'), c_custkey) - 1 AS i FROM s) USING (i)"""


SECRETS = {"c_mktsegment": "c_nationkey", "c_nationkey": "c_mktsegment"}


@query("WITH s AS (SELECT * FROM customer WHERE c_custkey % 3 = 1), " + _rates_sql(union([f"SELECT 'Inference | {secret}' AS metric_type, '{kind}' AS kind, * FROM ({sql})" for secret, aux in SECRETS.items() for kind, sql in (("main", _guessed(0, secret, aux)), ("control", _guessed(2, secret, aux)), ("baseline", _random_guess(secret)))])))
def inference_report(spark, sf_dir):
    """Every column as the secret: a level by equality, a number within 5 %."""
    return evaluate.compute(_customers(spark, sf_dir), "Inference", "made").select("metric_type", "metric", "value")
