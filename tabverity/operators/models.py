"""Metrics that fit classifiers: propensity, train on synthetic and test on real, membership inference, random-forest guesses."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import report
from .split import stratified_split

SEED = 42
#: Rows that a task holds while trees grow, on average: their features are one-hot, and files of few bytes have many rows.
TASK_ROWS = 100_000


def features(numeric: list[str], categorical: list[str]) -> list:
    """Stages that give ``features``: numbers standardised, categories one-hot; unseen categories are one level."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categorical]
    one_hot = [OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], handleInvalid="keep")] if categorical else []
    numbers = [VectorAssembler(inputCols=numeric, outputCol="numbers", handleInvalid="keep"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)] if numeric else []
    return [*index, *one_hot, *numbers, VectorAssembler(inputCols=[*([] if not numeric else ["scaled"]), *(f"{c}_hot" for c in categorical)], outputCol="features")]


def prepared(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in categorical})


def spread(df: DataFrame) -> DataFrame:
    """Rows in as many parts as there are TASK_ROWS of them, and in no fewer than a shuffle has."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS)))


def classifiers() -> dict:
    """Stand-ins for boosted and linear models, named for what they are."""
    return {
        "gbt_accuracy": GBTClassifier(labelCol="label", maxIter=10, maxDepth=4, seed=SEED),
        "forest_accuracy": RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=6, seed=SEED),
        "logistic_accuracy": LogisticRegression(labelCol="label", maxIter=30),
    }


def propensity(real: DataFrame, synthetic: DataFrame, id_col: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Rows (metric, value): hold-out accuracy of telling synthetic rows from real ones; the id is no feature."""
    columns = [id_col, *numeric, *categorical]
    both = real.select(*columns).withColumn("label", F.lit(0.0)).unionByName(synthetic.select(*columns).withColumn("label", F.lit(1.0)))
    split = stratified_split(prepared(both, numeric, categorical).withColumn("_key", F.concat_ws(":", "label", id_col)), "label", "_key").persist()
    ready = Pipeline(stages=features(numeric, categorical)).fit(split)
    train, test = ready.transform(split.where("is_train")).persist(), ready.transform(split.where("not is_train")).persist()
    rows = [(name, model.fit(train).transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]) for name, model in classifiers().items()]
    for df in (split, train, test):
        df.unpersist()
    return real.sparkSession.createDataFrame(rows, "metric string, value double")


def train_classifier(train: DataFrame, target: str, numeric: list[str], categorical: list[str]):
    """A fitted pipeline that can be saved and loaded (PipelineModel)."""
    ready = prepared(train, numeric, categorical).withColumn("label", F.col(target).cast("double"))
    return Pipeline(stages=[*features(numeric, categorical), RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=6, seed=SEED)]).fit(spread(ready))


def load_classifier(path: str):
    """A pipeline that was saved with ``write().save(path)``."""
    return PipelineModel.load(path)


def utility_of_saved(paths: dict[str, str], test: DataFrame, target: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Rows (model_name, f1, ..., predicted_positive): classification reports of saved pipelines, and rows they call 1."""
    out = None
    for name, path in paths.items():
        guessed = load_classifier(path).transform(prepared(test, numeric, categorical)).select(F.col(target).cast("int").alias("truth"), F.col("prediction").cast("int").alias("guess"))
        one = report.f1_report(guessed, "truth", "guess").crossJoin(guessed.agg(F.count_if("guess = 1").alias("predicted_positive"))).select(F.lit(name).alias("model_name"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def utility(model, test: DataFrame, target: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Classification report of a fitted pipeline on real hold-out rows."""
    guessed = model.transform(prepared(test, numeric, categorical)).select(F.col(target).cast("int").alias("truth"), F.col("prediction").cast("int").alias("guess"))
    return report.f1_report(guessed, "truth", "guess")


def forest_guess(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    """1 - the share of real rows whose sensitive value a forest grown on synthetic rows guesses."""
    index = StringIndexer(inputCol=sensitive, outputCol="label", handleInvalid="keep")
    rows = lambda df: prepared(df, [], [*keys, sensitive])
    model = Pipeline(stages=[index, *features([], keys), RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=6, seed=SEED)]).fit(spread(rows(synthetic)))
    return model.transform(rows(real)).agg((1 - F.avg((F.col("prediction") == F.col("label")).cast("int"))).alias("score"))


def membership_attack(members: DataFrame, others: DataFrame, target: str, numeric: list[str], categorical: list[str], id_col: str) -> DataFrame:
    """Black-box attack on a forest trained on ``members``: confusion report of guessing who was a member.

    The attack model learns from half of members and others, by hash, and is tested on the rest.
    """
    model = train_classifier(members, target, numeric, categorical)

    def seen(df: DataFrame, label: int) -> DataFrame:
        scored = model.transform(prepared(df, numeric, categorical)).withColumn("p", vector_to_array("probability"))
        return scored.select(F.col(id_col).alias("key"), F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"), F.col(target).cast("double").alias("y"), F.lit(label).alias("truth"))

    return _attack(seen(members, 1).unionByName(seen(others, 0)))


def _attack(rows: DataFrame) -> DataFrame:
    half = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(2)) == 0
    vectors = VectorAssembler(inputCols=["p0", "p1", "y"], outputCol="features").transform(rows.withColumn("label", F.col("truth").cast("double")))
    model = RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=5, seed=SEED).fit(vectors.where(half))
    return report.confusion(model.transform(vectors.where(~half)).withColumn("guess", F.col("prediction").cast("int")), "truth", "guess")


def shadow_attack(members: DataFrame, others: DataFrame, synthetic: DataFrame, target: str, numeric: list[str], categorical: list[str], id_col: str, shadows: int = 3) -> DataFrame:
    """Shadow models on parts of the synthetic rows teach the attack; it is tested on real members and others."""
    parts = None
    columns = [id_col, target, *numeric, *categorical]
    for k in range(shadows):
        inside = F.pmod(F.xxhash64(id_col, F.lit(k)), F.lit(2)) == 0
        model = train_classifier(synthetic.where(inside), target, numeric, categorical)
        scored = model.transform(prepared(synthetic.select(*columns), numeric, categorical)).withColumn("p", vector_to_array("probability"))
        one = scored.select(F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"), F.col(target).cast("double").alias("y"), inside.cast("double").alias("label"))
        parts = one if parts is None else parts.unionByName(one)
    assemble = VectorAssembler(inputCols=["p0", "p1", "y"], outputCol="features")
    attack = RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=5, seed=SEED).fit(assemble.transform(parts))
    target_model = train_classifier(members, target, numeric, categorical)
    real = members.select(*columns).withColumn("truth", F.lit(1)).unionByName(others.select(*columns).withColumn("truth", F.lit(0)))
    scored = target_model.transform(prepared(real, numeric, categorical)).withColumn("p", vector_to_array("probability")).select(F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"), F.col(target).cast("double").alias("y"), "truth")
    return report.confusion(attack.transform(assemble.transform(scored)).withColumn("guess", F.col("prediction").cast("int")), "truth", "guess")
