"""Metric families by name: every family is a set of lazy metrics, of which only those that are wanted are computed.

A family is a function (tables, synthetic) -> {metric: a function that computes it}. What several metrics need is computed
once, by the first of them (``once``). A metric that fails has a row with its status; the others go on. Metrics of one
column are named "column | metric" and are stored under the type "family | column".
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Collection
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attacks, distance, divergence, encode, likelihood, models, privacy, quality, singling
from ..sources.tables import TableSet, kinds

log = logging.getLogger(__name__)
Metrics = dict[str, Callable[[], object]]
Family = Callable[[TableSet, DataFrame], Metrics | DataFrame]
REGISTRY: dict[str, Family] = {}
SCHEMA = "metric_type string, metric string, model_name string, value double, status string"
#: What makes a metric fail without ending the run.
FAILURES = (ValueError, TypeError, ArithmeticError, KeyError, PySparkException)


def family(name: str) -> Callable[[Family], Family]:
    """Registers a function (tables, synthetic) -> lazy metrics, or a table of rows (metric, value); users add their own."""

    def add(f: Family) -> Family:
        REGISTRY[name] = f
        return f

    return add


def once(compute: Callable[[], object]) -> Callable[[], object]:
    """The function, run by its first caller only; others get the same value or the same failure."""
    done: list = []

    def get() -> object:
        if not done:
            try:
                done.append((compute(), None))
            except FAILURES as failure:
                done.append((None, failure))
        value, failure = done[0]
        if failure is not None:
            raise failure
        return value

    return get


def _row(df: Callable[[], DataFrame]) -> Callable[[], dict]:
    return once(lambda: df().first().asDict())


def _fields(row: Callable[[], dict], names: Collection[str], prefix: str = "") -> Metrics:
    return {f"{prefix}{n}": (lambda n=n: row()[n]) for n in names}


def _one(df: Callable[[], DataFrame], column: str) -> Callable[[], object]:
    return lambda: df().agg(F.avg(column)).first()[0]


def _columns(tables: TableSet) -> tuple[list[str], list[str]]:
    found = kinds(tables.real, tables.roles.id)
    return [c for c, k in found.items() if k == "numerical"], [c for c, k in found.items() if k in ("categorical", "boolean")]


def _encoded(frames: list[DataFrame], columns: list[str]) -> list[DataFrame]:
    """Columns replaced by codes of their values in order, the same in all tables; null has the code after the last."""
    for c in columns:
        frames = [df.withColumn(c, F.col(c).cast("string")) for df in frames]
        codes = encode.label_codes(reduce(DataFrame.unionByName, [df.select(c) for df in frames]), c, c)
        frames = [encode.encode_labels(df, c, codes) for df in frames]
    return frames


def _target(tables: TableSet, synthetic: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str], list[str]]:
    """Real, control and synthetic rows with a target of numbers, and the numeric and categorical features."""
    target = tables.roles.target
    if target is None or tables.control is None:
        raise ValueError("a target column and a control table are needed")
    numeric, categorical = _columns(tables)
    frames = [tables.whole if tables.whole is not None else tables.real, tables.control, synthetic]
    frames = frames if target in numeric else _encoded(frames, [target])
    return (*frames, [c for c in numeric if c != target], [c for c in categorical if c != target])


#: Parts of a classification report, and of a membership attack's, by the names they are shown under.
REPORT = ("f1", "f1_weighted", "f1_macro", "precision_macro", "recall_macro", "accuracy", "support_0", "support_1")
CONFUSION = {"TPR": "tpr", "PPV": "ppv", "FPR": "fpr", "TNR": "tnr", "Acc": "accuracy", "Adv": "advantage"}


@family("Utility")
def utility(tables: TableSet, synthetic: DataFrame) -> Metrics:
    """Trained on synthetic rows, tested on the control table; the target has the values 0 and 1 or two levels."""
    _, control, synthetic, numeric, categorical = _target(tables, synthetic)
    target = tables.roles.target
    return _fields(_row(lambda: models.utility(models.train_classifier(synthetic, target, numeric, categorical), control, target, numeric, categorical)), REPORT)


@family("Membership Inference Attack")
def membership(tables: TableSet, synthetic: DataFrame) -> Metrics:
    """A black-box attack on a model of the synthetic rows, and one by shadow models on a model of the real rows.

    Others are the control table's rows. For the real table against itself there is the black-box attack alone.
    """
    real, control, synthetic, numeric, categorical = _target(tables, synthetic)
    rest = (tables.roles.target, numeric, categorical, tables.roles.id)
    black = _row(lambda: models.membership_attack(real if tables.whole is not None else synthetic, control, *rest))
    out = {f"BBox - {k}": (lambda c=c: black()[c]) for k, c in CONFUSION.items()}
    if tables.whole is None:
        shadow = _row(lambda: models.shadow_attack(real, control, synthetic, *rest))
        out |= {f"Shadow - {k}": (lambda c=c: shadow()[c]) for k, c in CONFUSION.items()}
    return out


@family("Basic Quality")
def basic_quality(tables: TableSet, synthetic: DataFrame) -> Metrics:
    numeric, categorical = _columns(tables)
    quality_ = once(lambda: {r["metric"]: r["score"] for r in quality.overall_quality(tables.real, synthetic, numeric, categorical).collect()})  # three rows
    validity = once(lambda: quality.data_validity(tables.real, synthetic, numeric, categorical, tables.roles.id).agg(F.avg("score")).first()[0])
    structure = once(lambda: quality.data_structure(tables.real, synthetic))
    return _fields(quality_, ["Column Shapes", "Column Pair Trends", "Overall Quality"]) | {
        "Data Validity": validity, "Data Structure": structure, "Overall Diagnostic": lambda: (validity() + structure()) / 2,
        "New Row Synthesis": _one(lambda: quality.new_row_synthesis(tables.real, synthetic, categorical, numeric), "score"),
    }


@family("Advanced Quality")
def advanced_quality(tables: TableSet, synthetic: DataFrame) -> Metrics:
    numeric, categorical = _columns(tables)
    out = {"CS Test": _one(lambda: divergence.chi_square_p(tables.real, synthetic, categorical), "p_value")}
    if len(categorical) > 1:
        out["Discrete KL Divergence"] = _one(lambda: divergence.discrete_kl(tables.real, synthetic, categorical), "score")
    if len(numeric) > 1:
        out["Continuous KL Divergence"] = _one(lambda: divergence.continuous_kl(tables.real, synthetic, numeric), "score")
    return out


@family("Likelihood")
def bayesian_network(tables: TableSet, synthetic: DataFrame) -> Metrics:
    return _fields(_row(lambda: likelihood.bn_likelihood(tables.real, synthetic, _columns(tables)[1])), ["likelihood", "log_likelihood"])


@family("Privacy Against Inference")
def against_inference(tables: TableSet, synthetic: DataFrame) -> Metrics:
    keys, sensitive = list(tables.roles.key_fields), list(tables.roles.sensitive_fields)
    found = kinds(tables.real)
    if len({found[c] for c in [*keys, *sensitive]} - {"boolean"}) > 1:
        raise ValueError("key and sensitive fields are of the same kind")
    together = {"CategoricalCAP": privacy.cap, "CategoricalZeroCAP": privacy.zero_cap, "CategoricalGeneralizedCAP": privacy.generalized_cap}
    # These guess one column: the mean over the sensitive ones.
    each = {"CategoricalNB": privacy.naive_bayes, "CategoricalKNN": privacy.categorical_knn, "CategoricalRF": models.forest_guess}
    mean = lambda f: reduce(DataFrame.unionByName, [f(tables.real, synthetic, keys, s).select("score") for s in sensitive])
    return {n: _one(lambda f=f: f(tables.real, synthetic, keys, sensitive), "score") for n, f in together.items()} | {n: _one(lambda f=f: mean(f), "score") for n, f in each.items()}


@family("Distance")
def closest_records(tables: TableSet, synthetic: DataFrame) -> Metrics:
    found = kinds(tables.real, tables.roles.id)
    columns = [c for c, k in found.items() if k != "id"]

    def rows() -> dict[str, dict]:
        real, other = _encoded([tables.real, synthetic], [c for c in columns if found[c] != "numerical"])
        return {r["pair"]: r.asDict() for r in distance.distance_metrics(real, other, tables.roles.id, columns, tables.options.distance_scaler).collect()}  # three rows

    shared = once(rows)
    score = lambda: None if not shared()["RR"]["mean_max"] or shared()["RS"]["mean"] is None else shared()["RS"]["mean"] / shared()["RR"]["mean_max"]
    return {f"{m} {p}": (lambda m=m, p=p: shared()[p][m]) for p in ("RR", "SS", "RS") for m in ("mean", "p05", "nndr_p05", "zero_cells", "removed_rows")} | {"Score": score}


@family("Propensity Score")
def propensity(tables: TableSet, synthetic: DataFrame) -> Metrics:
    shared = once(lambda: {r["metric"]: r["value"] for r in models.propensity(tables.real, synthetic, tables.roles.id, *_columns(tables)).collect()})  # a row a classifier
    return _fields(shared, list(models.classifiers()))


RISK = ("main_rate", "main_error", "baseline_rate", "baseline_error", "risk", "risk_low", "risk_high")


def _risk(tables: TableSet, counts: Callable[[], dict[str, tuple[int, int]]], prefix: str = "") -> Metrics:
    shared = once(lambda: attacks.rates(tables.real.sparkSession, counts()))
    return _fields(shared, [*RISK, *(("control_rate", "control_error") if tables.control is not None else ())], prefix)


def _counted(df: DataFrame) -> tuple[int, int]:
    row = df.select("attacks", "successes").first()
    return row["attacks"], row["successes"]


def _attacked(tables: TableSet, n: int | None) -> dict[str, DataFrame]:
    """Rows that are attacked: of the real table, and of the control table if there is one."""
    every = {"main": tables.real} | ({"control": tables.control} if tables.control is not None else {})
    return {kind: attacks.sample_attacks(df, tables.roles.id, n) for kind, df in every.items()}


@family("Linkability")
def linkability(tables: TableSet, synthetic: DataFrame) -> Metrics:
    numeric, categorical = _columns(tables)
    aux = tuple(([c for c in a if c in numeric], [c for c in a if c in categorical]) for a in tables.roles.aux)
    k, key = tables.options.linkability_neighbours, tables.roles.id

    def counts() -> dict[str, tuple[int, int]]:
        asked = _attacked(tables, tables.options.linkability_attacks)
        found = {kind: _counted(attacks.linkability(df, synthetic, key, aux, k)) for kind, df in asked.items()}
        return found | {"baseline": _counted(attacks.linkability_random(asked["main"], synthetic, key, k))}

    return _risk(tables, counts)


@family("Inference")
def inference(tables: TableSet, synthetic: DataFrame) -> Metrics:
    """Every column is the secret once, or the one that the roles name; guesses are a model's or the nearest row's."""
    numeric, categorical = _columns(tables)
    columns, options, key = [*numeric, *categorical], tables.options, tables.roles.id
    used = list(options.inference_columns) if options.inference_columns is not None else columns
    secrets = [tables.roles.secret] if tables.roles.secret else [c for c in used if c != key]
    if gone := [c for c in [*used, *secrets] if c not in columns and c != key]:
        raise ValueError(f"no such columns: {gone}")

    def counts(secret: str) -> dict[str, tuple[int, int]]:
        aux = [c for c in numeric if c in used and c != secret], [c for c in categorical if c in used and c != secret]
        asked = {kind: attacks.sample_attacks(df.where(F.col(secret).isNotNull()), key, options.inference_attacks) for kind, df in _attacked(tables, None).items()}
        guess = attacks.inference_by_model if options.inference_model else attacks.inference
        found = {kind: _counted(guess(df, synthetic, key, *aux, secret, secret in numeric)) for kind, df in asked.items()}
        return found | {"baseline": _counted(attacks.inference_baseline(asked["main"], synthetic, key, secret, secret in numeric))}

    out: Metrics = {}
    for secret in secrets:
        out |= _risk(tables, lambda secret=secret: counts(secret), f"{secret} | ")
    return out


@family("Singling Out")
def singling_out(tables: TableSet, synthetic: DataFrame) -> Metrics:
    """Predicates over drawn columns, or, in the mode "univariate", on single values that one synthetic row has."""
    numeric, categorical = _columns(tables)
    options, key = tables.options, tables.roles.id
    if options.singling_mode not in ("univariate", "multivariate"):
        raise ValueError(f"mode {options.singling_mode!r} is neither univariate nor multivariate")

    def univariate(df: DataFrame) -> DataFrame:
        parts = [f(df, synthetic, c).select("success") for f, c in ((attacks.singling_out_univariate, numeric), (attacks.singling_out_levels, categorical)) if c]
        return reduce(DataFrame.unionByName, parts).agg(F.count("*").alias("attacks"), F.count_if("success").alias("successes"))

    def counts() -> dict[str, tuple[int, int]]:
        if options.singling_mode == "multivariate":
            rows = singling.singling_out(tables.real, synthetic, tables.control, key, numeric, categorical, options.singling_attacks, options.singling_columns).collect()  # a row an attack
            return {r["kind"]: (r["attacks"], r["successes"]) for r in rows}
        naive = singling.naive_predicates(synthetic, key, numeric, categorical, options.singling_attacks, 1)
        found = {kind: _counted(univariate(df)) for kind, df in _attacked(tables, None).items()}
        return found | {"baseline": _counted(singling.tally(singling.count_matches(tables.real, naive, numeric, categorical)))}

    return _risk(tables, counts)


def _place(family: str, name: str) -> tuple[str, str]:
    """Type and metric under which a metric of a family is stored."""
    column, bar, metric = name.rpartition(" | ")
    return (f"{family} | {column}", metric) if bar else (family, name)


def _wanted(name: str, metrics: Collection[str] | None) -> bool:
    return metrics is None or name in metrics or name.rpartition(" | ")[2] in metrics


def lazy(tables: TableSet, family: str, model: str, metrics: Collection[str] | None, done: Collection[tuple[str, str]]) -> Metrics:
    """The metrics of a family, none computed yet; one that returns a table is computed as a whole, if anything is missing."""
    found = REGISTRY[family](tables, tables.synthetic[model])
    if isinstance(found, dict):
        return found
    if done and (metrics is None or all((family, m) in done for m in metrics)):
        return {}
    values = {r["metric"]: r["value"] for r in found.select("metric", "value").collect()}  # a row a metric
    return {m: (lambda v=v: v) for m, v in values.items()}


def compute_rows(tables: TableSet, family: str, model: str, metrics: Collection[str] | None = None, done: Collection[tuple[str, str]] = ()) -> list[tuple]:
    """Rows (metric_type, metric, model_name, value, status) of the wanted metrics that aren't ``done`` (type, metric).

    A metric that fails has no value and a status that says why; a family that can't begin is one such row.
    """
    failed = lambda f: f"failed: {str(f)[:200]}"
    if metrics is not None and not metrics:
        return []
    try:
        found = lazy(tables, family, model, metrics, done)
    except FAILURES as failure:
        log.warning("%s failed for %s: %s", family, model, str(failure)[:200])
        return [(family, family, model, None, failed(failure))]
    rows = []
    for name, value in found.items():
        place = _place(family, name)
        if not _wanted(name, metrics) or place in done:
            continue
        try:
            got = value()
            rows.append((*place, model, None if got is None else float(got), "ok"))
        except FAILURES as failure:
            log.warning("%s of %s failed for %s: %s", name, family, model, str(failure)[:200])
            rows.append((*place, model, None, failed(failure)))
    return rows


def compute(tables: TableSet, family: str, model: str, metrics: Collection[str] | None = None) -> DataFrame:
    return tables.real.sparkSession.createDataFrame(compute_rows(tables, family, model, metrics), SCHEMA)


def evaluate(tables: TableSet, families: list[str] | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Rows (metric_type, metric, model_name, value) of all families and models that ``stored`` doesn't have yet.

    A metric that fails is logged and has no value; unknown families are skipped with a warning. ``runs.run_synthetic``
    does the same with a store, so that a lost driver loses no finished family.
    """
    have = {(r["metric_type"].split(" | ")[0], r["model_name"]) for r in stored.select("metric_type", "model_name").distinct().collect()} if stored is not None else set()
    rows: list[tuple] = []
    for name in families or list(REGISTRY):
        if name not in REGISTRY:
            log.warning("no metric family %s", name)
            continue
        for model in tables.synthetic:
            if (name, model) not in have:
                rows += [r[:4] for r in compute_rows(tables, name, model)]
    return tables.real.sparkSession.createDataFrame(rows, "metric_type string, metric string, model_name string, value double")
