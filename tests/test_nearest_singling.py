"""Nearest rows, singling out and exact quantiles against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabverity.operators import attacks, nearest, prefix, privacy, profile, singling, skyline


def mixed(spark, n, seed, first=0):
    rng = np.random.default_rng(seed)
    rows = [(first + i, float(np.round(rng.normal(), 1)) if rng.random() > 0.1 else None, int(rng.integers(0, 4)), None if rng.random() < 0.1 else "abc"[rng.integers(3)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, a double, b int, c string")


def gower(r, s, widths):
    gaps = [1.0 if p is None or q is None else abs(p - q) / w for p, q, w in zip(r[1:3], s[1:3], widths)]
    return round((sum(gaps) + (r[3] is None or r[3] != s[3])) / 3, 12)


@pytest.mark.parametrize("block", [None, 9])
def test_gower(spark, block):
    left, df = mixed(spark, 150, 1)
    right, other = mixed(spark, 260, 2, 1000)
    metric = nearest.Gower(("a", "b"), ("c",), (10.0, 3.0))
    index = nearest.build_index(other, "id", "long", metric, block)
    assert (index.pivots is None) == (block is None)
    for k in (1, 12):
        got = {r["id"]: r for r in nearest.search(df, other, "id", metric, k, index=index).collect()}
        assert len(got) == len(left)
        for r in left:
            want = sorted((gower(r, s, metric.widths), s[0]) for s in right)[:k]
            assert [(x["d"], x["id"]) for x in got[r[0]]["near"]] == want


@pytest.mark.parametrize("block", [None, 16])
def test_euclidean(spark, block):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(size=(300, 2)), rng.normal(5, 0.1, size=(150, 2))]), 1)
    df = spark.createDataFrame([(str(i), *map(float, r)) for i, r in enumerate(x)], "id string, u double, v double")
    metric = nearest.Euclidean(("u", "v"))
    found = nearest.search(df, df, "id", metric, 2, "string", farthest=True, not_itself=True, zero=1e-8, index=nearest.build_index(df, "id", "string", metric, block)).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.nan)
    got = {int(r["id"]): r for r in found}
    for i in range(len(x)):
        assert [n["d"] for n in got[i]["near"]] == pytest.approx(np.sort(d[i])[:2])
        assert (got[i]["far"], got[i]["zeros"]) == (pytest.approx(np.nanmax(d[i])), np.nansum(d[i] <= 1e-8))
    if block:
        assert sum(r["pairs"] for r in found) < 0.6 * len(x) ** 2


def test_nearest_of_nothing(spark):
    _, df = mixed(spark, 5, 1)
    metric = nearest.Gower(("a", "b"), ("c",), (1.0, 1.0))
    assert [r["near"] for r in nearest.search(df, df.limit(0), "id", metric, 3).collect()] == [[]] * 5
    assert nearest.search(df.limit(0), df, "id", metric, 3).collect() == []
    # all rows alike: one pivot, one ring, and pieces by hash
    same = spark.range(300).select("id", F.lit(1.0).alias("a"), F.lit(2).alias("b"), F.lit("x").alias("c"))
    index = nearest.build_index(same, "id", "long", metric, 8)
    assert [[n["id"] for n in r["near"]] for r in nearest.search(df, same, "id", metric, 3, index=index).collect()] == [[0, 1, 2]] * 5


def fits(row, terms):
    def one(t):
        cell = row[t["col"]]
        if t["op"] == singling.IS_NULL or cell is None:
            return t["op"] == singling.IS_NULL and cell is None
        return {singling.AT_LEAST: lambda: cell >= t["number"], singling.AT_MOST: lambda: cell <= t["number"], singling.EQUALS: lambda: str(cell) == t["text"]}[t["op"]]()

    return all(one(t) for t in terms)


@pytest.mark.parametrize("most", [1 << 16, 0])
def test_singling_out(spark, monkeypatch, most):
    monkeypatch.setattr(singling, "MOST_BROADCAST", most)
    monkeypatch.setattr(singling, "BLOCK_PREDICATES", 7)
    monkeypatch.setattr(singling, "BLOCK_ROWS", 40)
    real, df = mixed(spark, 130, 4)
    made, synthetic = mixed(spark, 120, 5, 500)
    numeric, categorical = ["a", "b"], ["c"]
    asks = singling.singling_predicates(synthetic, "id", numeric, categorical, 25, 2).collect()
    assert 0 < len(asks) <= 25 and len({str(a["terms"]) for a in asks}) == len(asks)
    for a in asks:
        assert len(a["terms"]) == 2 and sum(fits(r[1:], a["terms"]) for r in made) == 1
    naive = singling.naive_predicates(synthetic, "id", numeric, categorical, 60, 2)
    for predicates in (spark.createDataFrame(asks, f"attack string, terms {singling.TERMS}"), naive):
        for r in singling.count_matches(df, predicates, numeric, categorical).collect():
            assert r["matches"] == min(2, sum(fits(x[1:], r["terms"]) for x in real))
    rates = {r["kind"]: r for r in singling.singling_out(df, synthetic, df, "id", numeric, categorical, 20, 2).collect()}
    assert set(rates) == {"main", "baseline", "control"} and rates["main"]["successes"] == rates["control"]["successes"] and rates["baseline"]["attacks"] == 20


def test_shown_predicates(spark):
    terms = spark.createDataFrame([([(0, 1, 2.5, None), (1, 3, None, "x"), (0, 0, None, None)],)], f"t {singling.TERMS}")
    assert terms.select(singling.shown(F.col("t"), ["age", "sex"])).first()[0] == "age >= 2.5 & sex = x & age is null"


@pytest.mark.parametrize("small", [50_000, 0])
def test_quantiles_of_odd_shapes(spark, monkeypatch, small):
    monkeypatch.setattr(profile, "SMALL", small)
    monkeypatch.setattr(profile, "FEW", 3)
    rng = np.random.default_rng(6)
    columns = {
        "tail": np.exp(rng.normal(0, 30, 3000)), "same": np.full(3000, 7.0), "two": rng.integers(0, 2, 3000) * 1e300, "far": np.concatenate([rng.random(2999) * 1e-9, [1e308]]),
        "wide": rng.choice([-1.7e308, 1.7e308], 3000), "ties": rng.integers(0, 5, 3000).astype(float),
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns))
    shares = [0.0, 0.05, 0.333, 0.5, 0.999, 1.0]
    got = profile.exact_quantiles(df, list(columns), shares)
    for c, x in columns.items():
        if c == "wide":
            assert got[c][0] == x.min() and got[c][-1] == x.max()
        else:
            assert got[c] == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-9)


def test_nearest_cells(spark):
    """Seven key fields in one run, against all pairs of rows."""
    rng = np.random.default_rng(9)
    keys = [f"k{i}" for i in range(7)]

    def rows(n, first, far):
        return [(first + i, *(None if rng.random() < 0.05 else str(rng.integers(3) + (9 if far and i % 9 == 0 else 0)) for _ in keys), "xyz"[rng.integers(3)]) for i in range(n)]

    real, made = rows(40, 0, True), rows(50, 100, False)
    schema = ", ".join(["id long", *(f"{k} string" for k in keys), "s string"])
    df, synthetic = spark.createDataFrame(real, schema), spark.createDataFrame(made, schema)
    cap, right = [], 0
    for r in real:
        d = [sum(a != b for a, b in zip(r[1:8], m[1:8])) for m in made]
        near = [m[8] for m, x in zip(made, d) if x == min(d)]
        cap.append(near.count(r[8]) / len(near))
        right += min(set(near), key=lambda v: (-near.count(v), v)) == r[8]
    assert privacy.generalized_cap(df, synthetic, keys, ["s"]).first()["score"] == pytest.approx(1 - np.mean(cap))
    assert privacy.categorical_knn(df, synthetic, keys, "s").first()["correct"] == right


@pytest.mark.parametrize(("goals", "block"), [(2, 8192), (2, 50), (3, 50)])
def test_fronts_of_blocks(spark, monkeypatch, goals, block):
    """Anticorrelated vectors, most of which no other dominates, beside dominated and repeated ones."""
    monkeypatch.setattr(skyline, "BLOCK", block)
    rng = np.random.default_rng(goals)
    x = rng.dirichlet(np.ones(goals), 500).round(2)
    x = np.concatenate([x, x[:200] - rng.integers(0, 2, size=(200, goals)) * 0.01, x[:20]])
    df = spark.createDataFrame([(list(map(float, v)),) for v in x], "v array<double>").repartition(3)
    beaten = [any((y >= v).all() and (y > v).any() for y in x) for v in x]
    want = {tuple(v) for v, b in zip(x, beaten) if not b}
    got = [tuple(r["v"]) for r in skyline.undominated(df.distinct(), goals).collect()]
    assert sorted(got) == sorted(want)


def test_running_sums_and_intervals(spark):
    df = spark.createDataFrame([(f"v{k:03d}", k % 7) for k in range(200)], "name string, n long")
    found, totals = prefix.running(df, [F.desc("name")], {"upto": F.col("n"), "place": F.lit(1)})
    rows, upto = sorted(found.collect(), key=lambda r: r["place"]), 0
    for k, r in enumerate(rows):
        upto += r["n"]
        assert (r["name"], r["upto"], r["place"]) == (f"v{199 - k:03d}", upto, k + 1)
    assert totals == {"upto": upto, "place": 200}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    none, totals = prefix.running(df.limit(0), [F.col("name")], {"upto": F.col("n")})
    assert none.collect() == [] and totals == {"upto": 0}
    # a level a row: no array of levels
    n = 3000
    levels = spark.range(n).select(F.concat(F.lit("x"), "id").alias("value"), (F.col("id") / n).alias("lo"), ((F.col("id") + 1) / n).alias("hi"))
    points = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 0.5), (3, 2.0), (4, -1.0), (5, None), (6, 1 / n), (7, 0.50001)], "k long, u double")
    got = {r["k"]: r["value"] for r in prefix.in_interval(points, F.col("u"), levels, ["value"], n).collect()}
    assert got == {0: "x0", 1: "x2999", 2: "x1499", 3: "x2999", 4: "x0", 5: None, 6: "x0", 7: "x1500"}


@pytest.mark.parametrize("numeric", [[], ["a"], ["a", "b"]])
def test_singling_out_without_meeting_rows(spark, numeric):
    """Two running maxima against brute force: levels and numbers that are null, ties, and ranges that part a group."""
    rows, df = mixed(spark, 400, 11)
    asks, other = mixed(spark, 300, 12, 1000)
    middle = {c: np.median([r[k] for r in asks if r[k] is not None]) for k, c in ((1, "a"), (2, "b"))}

    def fit(s, r):
        far = lambda k, c: s[k] is not None and r[k] is not None and (r[k] >= s[k] if s[k] >= middle[c] else r[k] <= s[k])
        return s[3] == r[3] and all(far(k, c) for k, c in ((1, "a"), (2, "b")) if c in numeric)

    found = attacks.singling_out_multivariate(df, other, "id", numeric, ["c"])
    assert tuple(found.first()) == (300, sum(sum(fit(s, r) for r in rows) == 1 for s in asks))
    joins = [line for line in found._jdf.queryExecution().toString().splitlines() if "Join" in line]
    assert joins and not any(">=" in line for line in joins)


def test_rows_that_are_alike_are_asked_about_once(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ONE_BLOCK", 8)
    asked, meet = [], nearest._meet
    monkeypatch.setattr(nearest, "_meet", lambda rows, *args: asked.append(rows.count()) or meet(rows, *args))
    left, _ = mixed(spark, 30, 5)
    right, _ = mixed(spark, 40, 6, 1000)
    left, right = ([(i * 97 % 1000 + first, *r[1:]) for i, r in enumerate(rows * 7)] for first, rows in ((0, left), (1000, right)))
    df, other = (spark.createDataFrame(rows, "id long, a double, b int, c string") for rows in (left, right))
    widths = [max(v) - min(v) for v in ([r[k] for r in [*left, *right] if r[k] is not None] for k in (1, 2))]
    got = {r["id"]: r["neighbours"] for r in attacks.gower_neighbours(df, other, "id", ["a", "b"], ["c"], 9).collect()}
    assert len(got) == len(left)
    for r in left:
        assert [(x["d"], x["id"]) for x in got[r[0]]] == sorted((gower(r, s, widths), s[0]) for s in right)[:9]
    assert asked and max(asked) <= 30


def test_bounds_of_rows_together():
    """What bounds rows together bounds each of them, and leaves few rings of a line."""
    rng = np.random.default_rng(8)
    for metric in (nearest.Gower(("a", "b"), (), (10.0, 2.0)), nearest.Euclidean(("a", "b"))):
        y = np.column_stack([rng.uniform(0, 10, 2000), rng.uniform(0, 2, 2000)])
        none = lambda v: np.zeros((len(v), 0), dtype=int)
        pivots = y[:100]
        d = metric.distances(y, none(y), pivots, none(pivots))
        home, at = d.argmin(axis=1), d.min(axis=1)
        of = np.arange(100)
        boxes = tuple(np.array([f(y[home == p]) for p in of]) for f in (lambda v: v.min(axis=0), lambda v: v.max(axis=0), lambda v: np.zeros(2, dtype=bool)))
        rings = of, np.array([at[home == p].min() for p in of]), np.array([at[home == p].max() for p in of]), boxes
        rows = np.bincount(home, minlength=100)
        for p in range(0, 100, 9):
            x = y[home == p]
            low, high = nearest._chunk_bounds(metric, x, at[home == p].max(), metric.distances(pivots[p : p + 1], none(x[:1]), pivots, none(pivots))[0], rings)
            each = nearest._bounds(metric, x, d[home == p], rings)
            assert (low <= each[0].min(axis=0)).all() and (high >= each[1].max(axis=0)).all()
            kept = nearest._candidates(low, high, rows, 1, False)
            assert p in kept and len(kept) < 50
