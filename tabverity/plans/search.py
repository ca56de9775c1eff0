"""Searches over synthesizers and their parameters; trials are scored by metric families and compared as a table.

What is searched is small: a trial fits and evaluates with Spark, only its scores and parameters stay on the driver. A
trial is stored as soon as it is scored; a search that was stopped makes the same proposals again and finds their scores.
"""

from __future__ import annotations

import hashlib
import json
import logging
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..sources.tables import TableSet, fingerprint
from . import runs

log = logging.getLogger(__name__)
#: Metrics of which less is better.
MINIMISED = ("risk", "Privacy Risk", "gbt_accuracy", "forest_accuracy", "logistic_accuracy")
#: Duplicate proposals in a row after which a search ends.
MOST_DUPLICATES = 5
TRIAL_SCHEMA = "number long, params string, scores string, inputs string"


@dataclass(frozen=True)
class Range:
    """Numbers between two ends, for whole numbers rounded; ``log``: spread by their logarithm."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def _in(self, x: float) -> float:
        return math.log(x) if self.log else float(x)

    def _out(self, x: float) -> float | int:
        x = min(max(math.exp(x) if self.log else x, self.low), self.high)
        return round(x) if self.whole else x

    def draw(self, rng: random.Random) -> float | int:
        return self._out(rng.uniform(self._in(self.low), self._in(self.high)))

    def cross(self, a: float, b: float, rng: random.Random, spread: float = 15.0) -> float | int:
        """One child of simulated binary crossover: as far from its parents as a bit string's would be."""
        u = rng.random()
        beta = (2 * u) ** (1 / (spread + 1)) if u <= 0.5 else (1 / (2 * (1 - u))) ** (1 / (spread + 1))
        side = 1 if rng.random() < 0.5 else -1
        return self._out(((1 + side * beta) * self._in(a) + (1 - side * beta) * self._in(b)) / 2)

    def mutate(self, x: float, rng: random.Random, spread: float = 20.0) -> float | int:
        """Polynomial mutation: mostly near, and always within the ends."""
        low, high, x = self._in(self.low), self._in(self.high), self._in(x)
        width = high - low or 1.0
        u = rng.random()
        if u < 0.5:
            step = (2 * u + (1 - 2 * u) * (1 - (x - low) / width) ** (spread + 1)) ** (1 / (spread + 1)) - 1
        else:
            step = 1 - (2 * (1 - u) + (2 * u - 1) * (1 - (high - x) / width) ** (spread + 1)) ** (1 / (spread + 1))
        return self._out(x + step * width)


@dataclass
class Space:
    """Builders of synthesizers by name, with the values, or the range, that each parameter may have."""

    build: dict[str, Callable]
    options: dict[str, dict[str, list | Range]] = field(default_factory=dict)

    def every(self) -> list[dict]:
        """All combinations, in order."""
        if any(isinstance(v, Range) for o in self.options.values() for v in o.values()):
            raise ValueError("a range has no end of combinations: give values, or search genetically")
        return [{"model": m} | dict(zip(self.options.get(m, {}), values)) for m in self.build for values in product(*self.options.get(m, {}).values())]

    def draw(self, rng: random.Random) -> dict:
        model = rng.choice(sorted(self.build))
        return {"model": model} | {k: self._draw(v, rng) for k, v in self.options.get(model, {}).items()}

    @staticmethod
    def _draw(values: list | Range, rng: random.Random) -> object:
        return values.draw(rng) if isinstance(values, Range) else rng.choice(values)

    def cross(self, a: dict, b: dict, rng: random.Random, mutation: float | None = None) -> dict:
        """A child of two proposals: the model of one, parameters of either or between them, and, now and then, changed."""
        model = rng.choice([a, b])["model"]
        child, options = {"model": model}, self.options.get(model, {})
        rate = mutation if mutation is not None else 1 / max(len(options), 1)
        for k, values in options.items():
            have = [p[k] for p in (a, b) if p["model"] == model and k in p]
            if isinstance(values, Range):
                child[k] = values.cross(have[0], have[1], rng) if len(have) == 2 else have[0] if have else values.draw(rng)
                child[k] = values.mutate(child[k], rng) if rng.random() < rate else child[k]
            else:
                child[k] = rng.choice(values) if not have or rng.random() < rate else rng.choice(have)
        return child

    def make(self, proposal: dict):
        return self.build[proposal["model"]](**{k: v for k, v in proposal.items() if k != "model"})


def trial_folder(path: str, number: int, proposal: dict) -> str:
    """One folder for each trial, named by its number, model and parameters."""
    parts = "_".join(f"{k}-{v}" for k, v in proposal.items() if k != "model")
    return f"{path}/trials/trial-{number}_{proposal['model']}" + (f"_{parts}" if parts else "")


def score_trial(tables: TableSet, proposal: dict, space: Space, wanted: dict[str, list[str]], path: str, number: int) -> dict[str, float | None]:
    """Fit, generate, store and evaluate one proposal; the wanted metrics by name, None where one failed."""
    spark = tables.real.sparkSession
    made = space.make(proposal)
    roles = tables.roles
    made.fit(tables.real.drop(roles.id) if roles.id else tables.real)
    rows = made.generate(tables.real.count())
    rows = runs.with_ids(rows, tables.real, roles.id) if roles.id else rows
    folder = trial_folder(path, number, proposal)
    rows.select(*(F.col(c).cast(tables.real.schema[c].dataType) for c in tables.real.columns if c in rows.columns)).write.mode("overwrite").parquet(folder)
    one = replace(tables, synthetic={"trial": spark.read.parquet(folder)})
    scores: dict[str, float | None] = {}
    for family, metrics in wanted.items():
        found = {r["metric"]: r["value"] for r in runs.compute(one, family, "trial", metrics).collect()}
        scores |= {m: found.get(m) for m in metrics}
    return scores


def as_table(spark: SparkSession, trials: list[dict], metrics: list[str]) -> DataFrame:
    """Rows (trial, model, params, metrics...); a failed metric counts as the worst value of its column.

    A metric that failed in every trial tells trials apart by nothing: it is left out, with a warning.
    """
    known = [m for m in metrics if any(t["scores"].get(m) is not None for t in trials)]
    for m in metrics:
        if m not in known:
            log.warning("%s failed in all trials and isn't compared", m)
    worst = {m: (max if m in MINIMISED else min)(t["scores"][m] for t in trials if t["scores"].get(m) is not None) for m in known}
    rows = [(t["number"], t["proposal"]["model"], _key(t["proposal"]), *(float(worst[m] if t["scores"].get(m) is None else t["scores"][m]) for m in known)) for t in trials]
    return spark.createDataFrame(rows, "trial long, model string, params string" + "".join(f", `{m}` double" for m in known))


def _key(proposal: dict) -> str:
    return json.dumps(proposal, sort_keys=True)


class Trials:
    """The table of trials in a folder: scores of proposals for the same tables and metrics."""

    def __init__(self, tables: TableSet, wanted: dict[str, list[str]], path: str) -> None:
        self.spark, self.path = tables.real.sparkSession, f"{path}/trial_table"
        marks = [fingerprint(tables.real), tables.control and fingerprint(tables.control), repr(tables.roles), repr(tables.options), wanted]
        self.inputs = hashlib.sha256(json.dumps(marks).encode()).hexdigest()
        try:
            rows = self.spark.read.schema(TRIAL_SCHEMA).parquet(self.path).where(F.col("inputs") == self.inputs).collect()  # a row a trial
        except AnalysisException:  # the folder isn't there yet
            rows = []
        self.known = {r["params"]: json.loads(r["scores"]) for r in rows}

    def scored(self, number: int, proposal: dict, score: Callable[[], dict]) -> dict:
        """The trial, scored now unless it was before."""
        if _key(proposal) not in self.known:
            self.known[_key(proposal)] = score()
            row = (number, _key(proposal), json.dumps(self.known[_key(proposal)]), self.inputs)
            self.spark.createDataFrame([row], TRIAL_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return {"number": number, "proposal": proposal, "scores": self.known[_key(proposal)]}


def best_of(trials: DataFrame, metrics: list[str]) -> DataFrame:
    """The Pareto front with its total score, the best first; ties go to the earlier trial."""
    down = [m for m in metrics if m in MINIMISED and m in trials.columns]
    up = [m for m in metrics if m not in MINIMISED and m in trials.columns]
    if not up and not down:
        raise ValueError("no metric could be computed for any trial")
    front = report.pareto_front(trials, "trial", up, down)
    return report.total_score(front, up, down).orderBy(F.desc("total_score"), "trial")


def grid_search(tables: TableSet, space: Space, wanted: dict[str, list[str]], path: str) -> DataFrame:
    """All combinations of the space; rows of the Pareto front, the best first."""
    runs.validate(tables, list(wanted))
    metrics = [m for names in wanted.values() for m in names]
    stored = Trials(tables, wanted, path)
    trials = [stored.scored(k, p, lambda k=k, p=p: score_trial(tables, p, space, wanted, path, k)) for k, p in enumerate(space.every())]
    return best_of(as_table(tables.real.sparkSession, trials, metrics), metrics)


def fronts(scores: list[list[float]]) -> list[int]:
    """Front of each row of scores (more is better), 0 for those that no other row dominates."""
    rank, left, level = [0] * len(scores), set(range(len(scores))), 0
    beats = lambda a, b: all(x >= y for x, y in zip(a, b)) and a != b
    while left:
        now = {i for i in left if not any(beats(scores[j], scores[i]) for j in left)}
        for i in now:
            rank[i] = level
        left, level = left - now, level + 1
    return rank


def crowding(scores: list[list[float]]) -> list[float]:
    """How far a row's neighbours are apart, summed over the goals; ends of a goal are infinitely far."""
    out = [0.0] * len(scores)
    for k in range(len(scores[0]) if scores else 0):
        order = sorted(range(len(scores)), key=lambda i: scores[i][k])
        span = scores[order[-1]][k] - scores[order[0]][k] or 1.0
        out[order[0]] = out[order[-1]] = float("inf")
        for a, i, b in zip(order, order[1:], order[2:]):
            out[i] += (scores[b][k] - scores[a][k]) / span
    return out


def genetic_search(tables: TableSet, space: Space, wanted: dict[str, list[str]], path: str, n_trials: int = 15, population: int = 6, seed: int = 42, score: Callable | None = None) -> DataFrame:
    """Non-dominated sorting search (NSGA-II) in generations; rows of the Pareto front of all trials, the best first.

    The first generation is drawn. Parents of the next one win tournaments by front and crowding; of parents and children
    the best by front, then by crowding, survive. Ends after ``n_trials`` trials or MOST_DUPLICATES duplicates in a row.
    """
    runs.validate(tables, list(wanted))
    metrics, rng = [m for names in wanted.values() for m in names], random.Random(seed)
    stored, score = Trials(tables, wanted, path), score or score_trial
    trials: list[dict] = []
    alive: list[dict] = []
    seen: set[str] = set()
    duplicates = 0
    while len(trials) < n_trials and duplicates < MOST_DUPLICATES:
        place = standing(alive, metrics)
        born: list[dict] = []
        while len(born) < population and len(trials) < n_trials and duplicates < MOST_DUPLICATES:
            win = lambda: min(rng.choices(range(len(alive)), k=2), key=place.__getitem__)
            proposal = space.cross(alive[win()]["proposal"], alive[win()]["proposal"], rng) if alive else space.draw(rng)
            if _key(proposal) in seen:
                duplicates += 1
                continue
            seen.add(_key(proposal))
            duplicates, number = 0, len(trials)
            trials.append(stored.scored(number, proposal, lambda: score(tables, proposal, space, wanted, path, number)))
            born.append(trials[-1])
        alive = survivors(alive + born, metrics, population)
    return best_of(as_table(tables.real.sparkSession, trials, metrics), metrics)


def standing(trials: list[dict], metrics: list[str]) -> list[tuple[int, float]]:
    """Front and, within it, crowding of each trial: the smaller, the better. A failed metric is the worst there is."""
    value = lambda t, m: float("-inf") if t["scores"].get(m) is None else -t["scores"][m] if m in MINIMISED else t["scores"][m]
    scores = [[value(t, m) for m in metrics] for t in trials]
    rank = fronts(scores)
    far = [0.0] * len(trials)
    for level in set(rank):
        own = [i for i, r in enumerate(rank) if r == level]
        for i, x in zip(own, crowding([[0.0 if v == float("-inf") else v for v in scores[i]] for i in own])):
            far[i] = x
    return [(r, -x) for r, x in zip(rank, far)]


def survivors(trials: list[dict], metrics: list[str], population: int) -> list[dict]:
    place = standing(trials, metrics)
    return [trials[i] for i in sorted(range(len(trials)), key=lambda i: (place[i], i))[:population]]


def keep_best(tables: TableSet, found: DataFrame, path: str) -> str:
    """Copies the best trial's table to ``best_model``, in a folder of the model's name, and returns that."""
    best = found.first()
    proposal = json.loads(best["params"])
    target = f"{path}/best_model/{proposal['model']}"
    tables.real.sparkSession.read.parquet(trial_folder(path, best["trial"], proposal)).write.mode("overwrite").parquet(target)
    return target


def evaluate_best(tables: TableSet, found: DataFrame, path: str, names: list[str] | None = None) -> DataFrame:
    """All families for the best trial's table, in a store of its own."""
    spark = tables.real.sparkSession
    target = keep_best(tables, found, path)
    model = target.rsplit("/", 1)[1]
    one = replace(tables, synthetic={model: spark.read.parquet(target)})
    from .evaluate import REGISTRY

    names = names or [n for n in REGISTRY if n not in runs.missing_roles(one, list(REGISTRY))]
    return runs.run_synthetic(one, runs.Store(spark, f"{path}/best_model_results"), names)
