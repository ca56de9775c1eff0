"""Queries of sources, sinks and whole runs over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import PART_HALVES, RANKED, halves, query, table
from .catalogue_runs import MEAN_VALID, NEW_ROWS, Part, _parts
from .operators import attacks, report, split
from .plans import runs, search
from .sources import tables
from .sources.tables import Roles, TableSet, shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS model_name, count(*) AS n_rows, round(sum(s_acctbal), 2) AS total, min(s_name) AS first_name FROM supplier GROUP BY 1")
def csv_models(spark, sf_dir):
    """A folder of CSV tables, one for each model, read as one table without the id."""
    folder = _folder(spark, "csv")
    for name, df in zip(("even", "odd"), halves(spark, sf_dir, "supplier")):
        df.select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(f"{folder}/{name}.csv")
    rows = tables.drop_id(tables.read_models(spark, folder), "s_suppkey")
    return rows.groupBy("model_name").agg(F.count("*").alias("n_rows"), F.round(F.sum("s_acctbal"), 2).alias("total"), F.min("s_name").alias("first_name"))


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def csv_table(spark, sf_dir):
    """One CSV table with a schema, by its path."""
    df, folder = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), _folder(spark, "csv")
    df.write.option("header", True).csv(f"{folder}/customer.csv")
    return tables.as_frame(spark, f"{folder}/customer.csv", df.schema)


@query("SELECT o_orderstatus AS model_name, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def written_models(spark, sf_dir):
    """One folder a model, read back as a table partitioned by it."""
    folder = _folder(spark, "models")
    tables.write_models(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "model_name"), folder)
    return spark.read.parquet(folder).groupBy("model_name").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_nationkey AS nationkey, n_name AS nname, n_regionkey AS nregion FROM nation")
def cleaned_names(spark, sf_dir):
    """Names without the characters - . and /."""
    df = table(spark, sf_dir, "nation")
    return tables.clean_columns(df.select(F.col("n_nationkey").alias("nation-key"), F.col("n_name").alias("n.name"), F.col("n_regionkey").alias("n/region")))


@query("SELECT part, o_orderstatus, count(*) AS n FROM (SELECT *, CASE WHEN r <= round(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM (" + RANKED.format(g="o_orderstatus") + ")) GROUP BY 1, 2")
def split_tables(spark, sf_dir):
    """Train and test tables as a run writes them."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    train, test = runs.split_and_store(df, Roles(id="o_orderkey", target="o_orderstatus"), _folder(spark, "split"), runs.Settings())
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "o_orderstatus").agg(F.count("*").alias("n"))


@query(f"SELECT 'Basic Quality' AS metric_type, 'New Row Synthesis' AS metric, round({NEW_ROWS}, 6) AS odd, 0.0::DOUBLE AS same")
def results_csv(spark, sf_dir):
    """The pivoted results of two models as a CSV file, read again."""
    parts, path = _parts(spark, sf_dir), _folder(spark, "run")
    store = runs.Store(spark, path)
    runs.run_synthetic(replace(parts, synthetic=parts.synthetic | {"same": parts.real}), store, ["Basic Quality"], {"Basic Quality": ["New Row Synthesis"]})
    store.export_csv(f"{path}/results.csv")
    return tables.as_frame(spark, f"{path}/results.csv")


@query(f"WITH v AS (SELECT {MEAN_VALID} AS x) SELECT 'Data Structure' AS metric, 0.8::DOUBLE AS value UNION ALL SELECT 'Data Validity', round(x, 6) FROM v UNION ALL SELECT 'Overall Diagnostic', round((x + 0.8) / 2, 6) FROM v")
def overall_diagnostic(spark, sf_dir):
    """Validity and structure, whose mean is shown too: the real table has one of five columns more."""
    parts = _parts(spark, sf_dir)
    more = replace(parts, synthetic={"odd": parts.synthetic["odd"].withColumn("p_note", F.lit("x"))})
    return runs.compute(more, "Basic Quality", "odd", ["Data Structure", "Data Validity", "Overall Diagnostic"]).select("metric", "value")


@query("""WITH w AS (SELECT max(c_acctbal) - min(c_acctbal) AS aw, max(c_nationkey) - min(c_nationkey) AS nw FROM customer),
g AS (SELECT r.c_mktsegment AS truth, s.c_mktsegment AS guess, row_number() OVER (PARTITION BY r.c_custkey ORDER BY round((abs(r.c_acctbal - s.c_acctbal) / aw + abs(r.c_nationkey - s.c_nationkey) / nw) / 2, 12), s.c_custkey) AS k
FROM customer r, customer s, w WHERE r.c_custkey % 2 = 0 AND s.c_custkey % 2 = 1) SELECT truth AS "group", count(*) AS attacks, count(*) FILTER (truth = guess) AS successes FROM g WHERE k = 1 GROUP BY 1""")
def inference_by_group(spark, sf_dir):
    return attacks.inference_by_group(*halves(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], [], "c_mktsegment")


ORIGINAL = """WITH h AS (SELECT *, row_number() OVER (ORDER BY md5(p_partkey || ':42'), p_partkey) <= count(*) OVER () // 2 AS is_first FROM part WHERE p_partkey % 2 = 0),
k AS (SELECT p_brand, count(*) AS n FROM h WHERE NOT is_first GROUP BY 1), b AS (SELECT p_brand, p_type, count(*) AS m FROM h WHERE NOT is_first GROUP BY 1, 2),
c AS (SELECT CASE WHEN n IS NOT NULL THEN coalesce(m, 0) / n END AS cap FROM h LEFT JOIN k USING (p_brand) LEFT JOIN b USING (p_brand, p_type) WHERE is_first)"""


@query(f"{ORIGINAL} SELECT 'Original' AS model_name, 'CategoricalCAP' AS metric, round(1 - avg(cap), 6) AS value FROM c UNION ALL SELECT 'Original', 'CategoricalZeroCAP', round(1 - avg(coalesce(cap, 0)), 6) FROM c")
def original_attribution(spark, sf_dir):
    """The baseline of a run: metrics of one half of the real table against the other."""
    halved = runs.original_halves(_parts(spark, sf_dir))
    return runs.compute(halved, "Privacy Against Inference", "Original", ["CategoricalCAP", "CategoricalZeroCAP"]).select("model_name", "metric", "value")


SELF = """WITH r AS (SELECT * FROM part WHERE p_partkey % 2 = 0), root AS (SELECT p_brand, count(*) / (SELECT count(*) FROM r) AS p FROM r GROUP BY 1),
c AS (SELECT p_brand, p_type, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS p FROM r GROUP BY 1, 2), l AS (SELECT root.p * c.p AS p FROM r JOIN root USING (p_brand) JOIN c USING (p_brand, p_type))"""


@query(f"{SELF} SELECT 'part' AS model_name, 'likelihood' AS metric, round(avg(p), 6) AS value FROM l UNION ALL SELECT 'part', 'log_likelihood', round(avg(ln(p)), 6) FROM l")
def best_trial_run(spark, sf_dir):
    """A search whose best trial has all rows, and a whole evaluation of that trial's table."""
    parts, path = _parts(spark, sf_dir), _folder(spark, "search")
    one = TableSet(parts.real, {}, None, parts.roles)
    found = search.grid_search(one, search.Space({"part": Part}, {"part": {"most": [5, 50]}}), {"Basic Quality": ["Column Shapes"]}, path)
    return search.evaluate_best(one, found, path, ["Likelihood"]).select("model_name", "metric", "value")


@query(f"{PART_HALVES}, k AS (SELECT p_brand, count(*) AS n FROM r GROUP BY 1), b AS (SELECT p_brand, p_type, count(*) AS m FROM r GROUP BY 1, 2) SELECT 'CategoricalCAP' AS metric, round(1 - avg(m / n), 6) AS value FROM r JOIN k USING (p_brand) JOIN b USING (p_brand, p_type)")
def updated_family(spark, sf_dir):
    """A family that is stored, then computed again for another table of the same model."""
    parts, store = _parts(spark, sf_dir), runs.Store(spark, _folder(spark, "run"))
    runs.run_synthetic(parts, store, ["Privacy Against Inference"], {"Privacy Against Inference": ["CategoricalCAP"]})
    changed = replace(parts, synthetic={"odd": parts.real})
    return runs.run_synthetic(changed, store, ["Privacy Against Inference"], {"Privacy Against Inference": ["CategoricalCAP"]}).select("metric", "value")


@query("SELECT count(*) AS n_rows, count(*) AS n_ids FROM supplier")
def random_ids(spark, sf_dir):
    """New ids of a letter pair and eight digits for every row."""
    made = split.random_ids(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    return made.agg(F.count("*").alias("n_rows"), F.count_if(F.col("s_suppkey").rlike("^ID-[1-9][0-9]{7}$")).alias("n_ids"))


def _goals(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", "c_acctbal", "c_nationkey", (F.col("c_custkey") % 97).alias("age"))


@query("""WITH t AS (SELECT c_custkey, c_acctbal, c_nationkey, c_custkey % 97 AS age FROM customer)
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.c_acctbal >= t.c_acctbal AND o.c_nationkey <= t.c_nationkey AND o.age <= t.age AND (o.c_acctbal > t.c_acctbal OR o.c_nationkey < t.c_nationkey OR o.age < t.age))""")
def pareto_front_of_three(spark, sf_dir):
    return report.pareto_front(_goals(table(spark, sf_dir, "customer")), "c_custkey", ["c_acctbal"], ["c_nationkey", "age"])
