"""Whole evaluations: modes, a result store that a run resumes from, the original baseline, and single updates.

A store is a folder that Spark can read and write from everywhere: ``results`` holds a Parquet folder for each family
and model, ``config`` the settings as JSON. Each family is written as soon as it is computed, so that a run
whose driver is lost goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import json
import logging
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import profile, report, split
from ..sources.tables import Options, TableSet, fingerprint
from . import evaluate as families

log = logging.getLogger(__name__)
SCHEMA = families.SCHEMA + ", inputs string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Status of a folder without results.
GONE = "gone"
MODES = ("synthetic", "onlyoriginal", "runall")
#: Roles that a family needs.
REQUIRED = {
    "Utility": ("target", "control"), "Membership Inference Attack": ("target", "control", "id"), "Privacy Against Inference": ("key_fields", "sensitive_fields"),
    "Linkability": ("id", "aux"), "Inference": ("id",), "Singling Out": ("id",), "Distance": ("id",), "Propensity Score": ("id",),
}


def parse_mode(mode: str | None) -> str:
    """A mode's name without case and spaces; none given means everything."""
    name = "runall" if mode is None else mode.lower().replace(" ", "")
    if name not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    return name


def of_family(prefix: str) -> Column:
    """Rows whose metric type is the family or one of its columns, as in "Inference | age"."""
    return F.col("metric_type").startswith(prefix)


def missing_roles(tables: TableSet, names: list[str]) -> dict[str, list[str]]:
    """For each family, the roles that it needs and the tables don't have."""
    have = {k: bool(getattr(tables.roles, k)) for k in ("id", "target", "key_fields", "sensitive_fields", "secret")} | {"control": tables.control is not None, "aux": all(tables.roles.aux)}
    return {n: gone for n in names if (gone := [r for r in REQUIRED.get(n, ()) if not have[r]])}


def validate(tables: TableSet, names: list[str]) -> None:
    """An error that names every role that a wanted family lacks."""
    if gone := missing_roles(tables, names):
        raise ValueError("; ".join(f"{n} needs {', '.join(roles)}" for n, roles in gone.items()))


@dataclass
class Store:
    """Results of families, models and metrics, and the run's configuration.

    A result has the inputs it was computed from (tables, roles and settings): it counts as done for the same inputs, and
    unless it failed.
    """

    spark: SparkSession
    path: str

    def _read(self, read):
        try:
            return read()
        except AnalysisException:  # the folder isn't there yet
            return None

    def results(self) -> DataFrame:
        """All stored rows (metric_type, metric, model_name, value, status, inputs)."""
        found = self._read(lambda: self.spark.read.schema(SCHEMA).parquet(f"{self.path}/results").select(*NAMES).where(F.col("status") != GONE))
        return found if found is not None else self.spark.createDataFrame([], SCHEMA)

    def put(self, rows: list[tuple], inputs: str) -> None:
        """Writes rows of one family and model; other metrics of the same inputs stay, those of other inputs go."""
        if not rows:
            return
        family, model = rows[0][0].split(" | ")[0], rows[0][2]
        new = {(r[0], r[1]): (*r, inputs) for r in rows}
        begun = {k for k in new if k[0] == k[1]}  # a family that couldn't begin
        old = {(r["metric_type"], r["metric"]): tuple(r) for r in self.results().where(of_family(family) & (F.col("model_name") == model)).collect()}  # a row a metric
        kept = {k: r for k, r in old.items() if r[5] == inputs and (k[0] != k[1] or k in begun)} | new
        # a folder that has nothing left of these inputs is told so: single folders are replaced, never deleted
        gone = [(kind, "", model, None, GONE, inputs) for kind in {k[0] for k in old} - {k[0] for k in kept}]
        one = self.spark.createDataFrame([*kept.values(), *gone], SCHEMA).coalesce(1)
        one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric_type", "model_name").parquet(f"{self.path}/results")

    def done(self, family: str, model: str, inputs: str) -> set[tuple[str, str]]:
        """(type, metric) of what needn't be computed again."""
        rows = self.results().where(of_family(family) & (F.col("model_name") == model) & (F.col("inputs") == inputs) & (F.col("status") == "ok"))
        return {(r["metric_type"], r["metric"]) for r in rows.collect()}  # a row a metric

    def has(self, family: str, model: str) -> bool:
        """Whether every stored metric of the family and model is one that didn't fail."""
        rows = [r["status"] for r in self.results().where(of_family(family) & (F.col("model_name") == model)).collect()]  # a row a metric
        return bool(rows) and all(x == "ok" for x in rows)

    def save_config(self, config: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.path}/config")

    def config(self) -> dict:
        found = self._read(lambda: self.spark.read.text(f"{self.path}/config").first())
        return json.loads(found[0]) if found else {}

    def pivoted(self, models: list[str] | None = None) -> DataFrame:
        """A row for each (metric_type, metric) in the order of families, a column for each model."""
        rows = self.results()
        models = models or [r[0] for r in rows.select("model_name").distinct().orderBy("model_name").collect()]
        wide = report.pivot_results(rows, models)
        return report.in_order(wide).orderBy("place", "metric_type", "metric").drop("place")

    def export_csv(self, path: str) -> None:
        """The pivoted results as one CSV file with a header."""
        self.pivoted().coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def compute(tables: TableSet, family: str, model: str, metrics: list[str] | None = None) -> DataFrame:
    """Rows (metric_type, metric, model_name, value, status) of one family and model, computed anew."""
    return families.compute(tables, family, model, metrics)


def inputs_of(tables: TableSet) -> dict[str, str]:
    """For each model a hash of all that its results depend on."""
    print_of = lambda df: None if df is None else fingerprint(df)
    shared = [print_of(tables.real), print_of(tables.control), print_of(tables.whole), repr(tables.roles), repr(tables.options)]
    return {m: hashlib.sha256(json.dumps([*shared, print_of(df)]).encode()).hexdigest() for m, df in tables.synthetic.items()}


def run_synthetic(tables: TableSet, store: Store, names: list[str] | None = None, metrics: dict[str, list[str]] | None = None) -> DataFrame:
    """All metrics of all models that the store doesn't have of these inputs; a family is stored when it is done.

    A run that asks for more metrics than one before computes those; metrics that failed are tried again.
    """
    inputs = inputs_of(tables)
    for family in names or list(families.REGISTRY):
        if family not in families.REGISTRY:
            log.warning("no metric family %s", family)
            continue
        for model in tables.synthetic:
            done = store.done(family, model, inputs[model])
            store.put(families.compute_rows(tables, family, model, metrics.get(family) if metrics else None, done), inputs[model])
    return store.results()


def original_halves(tables: TableSet, seed: int = 42) -> TableSet:
    """The real table's two halves as real table and as the synthetic table "Original", with half as many attacks."""
    halves = split.half_split(tables.real, tables.roles.id, seed)
    return replace(tables, real=halves.where("is_first").drop("is_first"), synthetic={"Original": halves.where("not is_first").drop("is_first")}, options=tables.options.halved(), whole=tables.real)


def run_original(tables: TableSet, store: Store, names: list[str] | None = None) -> DataFrame:
    """The baseline of half the real table against the other half: all families but Utility."""
    return run_synthetic(original_halves(tables), store, [n for n in names or list(families.REGISTRY) if n != "Utility"])


def update(tables: TableSet, store: Store, family: str) -> DataFrame:
    """Computes one family again for all models and replaces what is stored of it."""
    inputs = inputs_of(tables)
    for model in tables.synthetic:
        store.put(families.compute_rows(tables, family, model), inputs[model])
    return store.results()


@dataclass
class Settings:
    """What a whole run does; stored beside its results."""

    mode: str | None = None
    families: list[str] | None = None
    metrics: dict[str, list[str]] = field(default_factory=dict)
    train_share: float = 0.8
    seed: int = 42
    options: Options = Options()


def split_and_store(df: DataFrame, roles, path: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, stratified by the target (or halves of the hash order without one), written and read again."""
    spark = df.sparkSession
    marked = split.stratified_split(df, roles.target, roles.id, settings.train_share, settings.seed) if roles.target else split.take_first(df.withColumn("_all", F.lit(0)), F.round(F.col("group_rows") * settings.train_share).cast("long"), roles.id, settings.seed, ["_all"]).withColumnRenamed("taken", "is_train").drop("_all")
    marked.where("is_train").drop("is_train").write.mode("overwrite").parquet(f"{path}/train")
    marked.where("not is_train").drop("is_train").write.mode("overwrite").parquet(f"{path}/test")
    return spark.read.schema(df.schema).parquet(f"{path}/train"), spark.read.schema(df.schema).parquet(f"{path}/test")


def with_ids(rows: DataFrame, like: DataFrame, id_col: str) -> DataFrame:
    """Generated rows with ids that no row of ``like`` has: whole numbers beyond the largest, or texts of their own."""
    if id_col in rows.columns:
        return rows
    number = F.col("row_id") if "row_id" in rows.columns else F.monotonically_increasing_id()
    if isinstance(like.schema[id_col].dataType, T.NumericType):
        first = like.agg(F.max(F.col(id_col).cast("long"))).first()[0]
        return rows.withColumn(id_col, number + F.lit((first if first is not None else -1) + 1))
    return rows.withColumn(id_col, F.concat(F.lit("made-"), number.cast("string")))


def generate(synthesizer, train: DataFrame, roles, path: str) -> DataFrame:
    """A table as large as ``train``, with its classes' shares if the synthesizer knows the target, written and read again."""
    spark, rows = train.sparkSession, train.count()
    synthesizer.fit(train.drop(roles.id) if roles.id else train)
    quotas = None
    if roles.target and getattr(synthesizer, "target", None) == roles.target:
        quotas = {r["class"]: r["num_rows"] for r in profile.class_quota(train, roles.target, rows).where("class is not null").collect()}  # one row a class
    made = synthesizer.generate(rows, quotas) if quotas else synthesizer.generate(rows)
    made = with_ids(made, train, roles.id) if roles.id else made
    made.select(*(F.col(c).cast(train.schema[c].dataType) for c in train.columns if c in made.columns)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run(df: DataFrame, roles, synthesizers: list, path: str, settings: Settings | None = None) -> DataFrame:
    """Split, generate with every synthesizer, and evaluate by the mode; the store's rows.

    ``path`` is a folder in shared storage with ``train``, ``test``, ``synthetic`` (one folder a model) and the store. A run
    on the same table with the same settings goes on with the tables that are there. A synthesizer that fails is left out,
    with a row that says so.
    """
    settings = settings or Settings()
    mode = parse_mode(settings.mode)
    spark = df.sparkSession
    store = Store(spark, path)
    config = settings.__dict__ | {"mode": mode, "roles": roles.__dict__, "options": settings.options.__dict__}
    made = store.config().get("made", {})
    key = hashlib.sha256(json.dumps([fingerprint(df), repr(roles), settings.train_share, settings.seed]).encode()).hexdigest()
    if made.get("split") == key:
        train, test = (spark.read.schema(df.schema).parquet(f"{path}/{part}") for part in ("train", "test"))
    else:
        train, test = split_and_store(df, roles, path, settings)
        made = {"split": key}
    store.save_config(config | {"made": made})
    tables = TableSet(train, {}, test, roles, settings.options)
    if mode != "onlyoriginal":
        for s in synthesizers:
            folder, own = f"{path}/synthetic/{s.name}", f"{key}:{_settings_of(s)}"
            try:
                if made.get(s.name) != own:
                    generate(s, train, roles, folder)
                    made[s.name] = own
                    store.save_config(config | {"made": made})
                tables = replace(tables, synthetic=tables.synthetic | {s.name: spark.read.parquet(folder)})
            except families.FAILURES as failure:
                log.warning("synthesizer %s failed: %s", s.name, str(failure)[:200])
                store.put([("Generation", "Generation", s.name, None, f"failed: {str(failure)[:200]}")], key)
    names = settings.families or [n for n in families.REGISTRY if n not in missing_roles(tables, list(families.REGISTRY))]
    validate(tables, names)
    if mode != "onlyoriginal":
        run_synthetic(tables, store, names, settings.metrics or None)
    if mode != "synthetic":
        run_original(tables, store, names)
    return store.results()


def _settings_of(synthesizer) -> str:
    """What a synthesizer was made with: its plain attributes, before it is fitted."""
    plain = {k: v for k, v in vars(synthesizer).items() if isinstance(v, str | int | float | list | tuple | None)}
    return f"{type(synthesizer).__name__}:{json.dumps(plain, sort_keys=True, default=repr)}"
