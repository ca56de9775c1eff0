"""Hand-computed tables for the table operators."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabverity.functions import scalars
from tabverity.operators import attacks, distance, divergence, encode, likelihood, models, nearest, prepare, privacy, profile, quality, report, split, synthesis
from tabverity.plans import evaluate, runs, search
from tabverity.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first().asDict()


def test_sources(spark, tmp_path):
    df = frame(spark, [(1, "x")], "`a-b` int, `c.d` string")
    assert tables.clean_columns(df).columns == ["ab", "cd"]
    with pytest.raises(ValueError, match="collide"):
        tables.clean_columns(frame(spark, [(1, 2)], "`a-b` int, ab int"))
    with pytest.raises(TypeError):
        tables.as_frame(spark, 3)
    path = str(tmp_path / "t")
    tables.save_mapping(frame(spark, [("c", -1.5, 2)], "column string, value double, code long"), path)
    assert one(tables.load_mapping(spark, path)) == {"column": "c", "value": -1.5, "code": 2}
    with pytest.raises(ValueError, match="nulls"):
        tables.require_complete(frame(spark, [(None,)], "a int"), ["a"])


def test_profile(spark):
    df = frame(spark, [(1, 5.0, "b"), (2, 1.25, "a"), (3, None, None), (4, 0.5, "a"), (5, 2.0, "b")], "id int, x double, s string")
    assert profile.fill_values(df, ["x"], ["s"]) == {"x": 1.625, "s": "a"}  # the mode's tie goes to the smallest
    assert one(profile.null_rates(df, ["x"]))["null_rate"] == 0.2
    assert one(profile.decimal_places(df, ["x"]))["places"] == 2
    got = {r["column"]: r["is_continuous"] for r in profile.continuous(df, ["id", "x", "s"]).collect()}
    assert got == {"id": False, "x": True, "s": False}


def test_rounding_and_format(spark):
    got = one(spark.range(1).select(scalars.format_value(F.lit(3.0)).alias("a"), scalars.format_value(F.lit(0.5)).alias("b"), scalars.format_interval(F.lit(0.1), F.lit(0.25)).alias("c"), scalars.positive_zero(F.lit(-0.0)).alias("d")))
    assert (got["a"], got["b"], got["c"]) == ("3", "0.50000", "(0.1, 0.25)")
    assert math.copysign(1, got["d"]) == 1
    lengths = one(spark.range(1).select(*(scalars.word_length(F.lit(n)).alias(f"n{n}") for n in (1, 25, 26, 675, 676))))
    assert list(lengths.values()) == [1, 1, 2, 2, 3]


def test_label_codes_follow_first_appearance_and_null_is_last(spark):
    df = frame(spark, [(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, s string")
    codes = encode.label_codes(df, "s", "id")
    assert {r["id"]: r["s"] for r in encode.encode_labels(df, "s", codes).collect()} == {1: 0, 2: 2, 3: 1, 4: 0}
    new = frame(spark, [(1, "z"), (2, "a"), (3, "c")], "id int, s string")
    assert {r["value"]: r["code"] for r in encode.extend_codes(codes, new, "s").collect()} == {"b": 0, "a": 1, "c": 3, "z": 4}


def test_uniform_round_trip_and_edges(spark):
    df = frame(spark, [(k, "abbcccc"[k % 7] if k % 5 else None) for k in range(70)], "id int, s string")
    intervals = encode.uniform_intervals(df, "s")
    assert max(r["hi"] for r in intervals.collect()) == 1.0
    points = encode.uniform_encode(df, "s", intervals, F.lit(0.5))
    back = {r["id"]: r["s"] for r in encode.uniform_decode(points, "s", intervals).collect()}
    assert all(back[r["id"]] == (r["s"] or "NaN_Category") for r in df.collect())
    first = min(intervals.collect(), key=lambda r: r["hi"])
    edges = frame(spark, [(0.0,), (first["hi"],), (-3.0,), (9.0,)], "x double")
    last = max(intervals.collect(), key=lambda r: r["hi"])["value"]
    assert [r["x"] for r in encode.uniform_decode(edges, "x", intervals).collect()] == [first["value"], first["value"], first["value"], last]


def test_scaling_of_constants(spark):
    df = frame(spark, [(3.0,), (3.0,)], "x double")
    for f in (encode.minmax_scale, encode.standard_scale):
        assert {r["x"] for r in f(df, "x").collect()} == {0.0}


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1003).withColumn("y", F.when(F.col("id") % 10 == 0, "rare").otherwise("usual"))
    rows = split.stratified_split(df, "y", "id").collect()
    assert sum(r["is_train"] for r in rows if r["y"] == "rare") == round(0.8 * 101)
    assert sum(r["is_train"] for r in rows) == round(0.8 * 101) + round(0.8 * 902)
    assert {r["id"]: r["is_train"] for r in rows} == {r["id"]: r["is_train"] for r in split.stratified_split(df.repartition(7), "y", "id").collect()}
    assert split.exact_renull(df, "y", "usual", 17, "id").where("y is null").count() == 17
    assert split.ratio_adjust(df, "y", {"rare": 500, "usual": 100}, "id").count() == 600


def test_identity_and_disjoint_tables(spark):
    a = frame(spark, [(k, float(k), "xy"[k % 2]) for k in range(20)], "id long, x double, s string")
    b = frame(spark, [(k, 100.0 + k, "pq"[k % 2]) for k in range(20)], "id long, x double, s string")
    assert {r["score"] for r in quality.column_shapes(a, a, ["x"], ["s"]).collect()} == {1.0}
    assert {r["score"] for r in quality.column_shapes(a, b, ["x"], ["s"]).collect()} == {0.0}
    assert {r["score"] for r in quality.data_validity(a, b, ["x"], ["s"]).collect()} == {0.0}
    assert one(quality.new_row_synthesis(a, a, ["s"], ["x"]))["score"] == 0.0
    assert one(quality.new_row_synthesis(a, b, ["s"], ["x"]))["score"] == 1.0
    assert quality.data_structure(a, b) == 1.0


def test_bands_match_the_plain_comparison(spark):
    rng = random.Random(1)
    values = lambda n: [(rng.choice([0.0, rng.uniform(-5, 5), rng.uniform(90, 110)]),) for _ in range(n)]
    real, synthetic = values(60), values(80)
    real += [(1.0,), (1.01,), (-2.0,)]
    synthetic += [(1.0101,), (0.0,), (-2.02,), (1.0202,)]
    want = sum(not any(abs(x - y) <= 0.01 * abs(x) for (y,) in real) for (x,) in synthetic)
    assert one(quality.new_row_bands(frame(spark, real, "x double"), frame(spark, synthetic, "x double"), ["x"]))["new_rows"] == want


def test_chi_square_tail():
    for statistic, freedom, p in ((3.841459, 1, 0.05), (11.070498, 5, 0.05), (0.1, 4, 0.99879), (40.0, 10, 1.695e-5)):
        assert divergence.chi_square_tail(statistic, freedom) == pytest.approx(p, rel=1e-3)


def test_tree_likelihood(spark):
    df = frame(spark, [("a", "x", "p"), ("a", "x", "q"), ("b", "y", "p"), ("b", "y", "q")], "u string, v string, w string")
    assert likelihood.best_tree([("u", "v", 0.69), ("u", "w", 0.0), ("v", "w", 0.0)], ["u", "v", "w"]) == [("u", "v"), ("u", "w")]
    got = one(likelihood.bn_likelihood(df, df, ["u", "v", "w"]))
    assert got["likelihood"] == pytest.approx(0.25)
    assert got["log_likelihood"] == pytest.approx(math.log(0.25))


def test_attribution(spark):
    real = frame(spark, [("k1", "m", "s"), ("k1", "m", "t"), ("k2", "m", "s"), ("k9", "m", "s"), ("k8", "n", "s")], "a string, b string, z string")
    synthetic = frame(spark, [("k1", "m", "s"), ("k1", "m", "s"), ("k1", "m", "t"), ("k2", "m", "t")], "a string, b string, z string")
    assert one(privacy.cap(real, synthetic, ["a", "b"], ["z"]))["score"] == pytest.approx(1 - (2 / 3 + 1 / 3 + 0) / 3)
    assert one(privacy.zero_cap(real, synthetic, ["a", "b"], ["z"]))["score"] == pytest.approx(1 - (2 / 3 + 1 / 3) / 5)
    assert one(privacy.generalized_cap(real, synthetic, ["a", "b"], ["z"]))["score"] == pytest.approx(1 - (2 / 3 + 1 / 3 + 0 + 0.5 + 0.5) / 5)


def test_blocks_of_distances_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ONE_BLOCK", 0)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(0)
    x = rng.random((30, 2))
    x[3] = x[4]
    df = frame(spark, [(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, a double, b double")
    rows = {int(r["id"]): r for r in distance.row_distances(df, df, "id", ["a", "b"], True).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for k in range(30):
        own = np.sort(np.delete(d[k], k))
        assert (rows[k]["nearest"], rows[k]["second"], rows[k]["farthest"]) == pytest.approx((own[0], own[1], own[-1]))
        assert rows[k]["zeros"] == (own <= 1e-8).sum()
    assert one(distance.summary(distance.row_distances(df, df, "id", ["a", "b"], True)))["removed_rows"] == 2


def test_risk_matches_known_values(spark):
    counts = frame(spark, [(19, 500, 3, 500)], "successes long, attacks long, control_successes long, control_attacks long")
    got = one(attacks.risk_report(counts))
    assert got["main_rate"] == pytest.approx(0.04152244529323714)
    assert got["main_error"] == pytest.approx(0.017062327237406746)
    assert got["control_rate"] == pytest.approx(0.009766424188006807)
    assert got["control_error"] == pytest.approx(0.00772382791604657)


def test_reports(spark):
    df = frame(spark, [(1, 1), (1, 1), (0, 0), (0, 1)], "y int, p int")
    got = one(report.confusion(df, "y", "p"))
    assert (got["tp"], got["fp"], got["tn"], got["fn"], got["tnr"]) == (2, 1, 1, 0, 0.5)
    assert one(report.f1_report(df, "y", "p"))["f1"] == pytest.approx(0.8)
    empty = one(report.f1_report(frame(spark, [(0, 0)], "y int, p int"), "y", "p"))
    assert empty["f1"] == 0.0
    trials = frame(spark, [(1, 1.0, 5.0), (2, 2.0, 4.0), (3, 2.0, 6.0), (4, 0.5, 4.5), (5, 2.0, 4.0)], "t int, up double, down double")
    assert sorted(r["t"] for r in report.pareto_front(trials, "t", ["up"], ["down"]).collect()) == [2, 5]
    assert {r["total_score"] for r in report.total_score(frame(spark, [(1.0,), (1.0,)], "up double"), ["up"], []).collect()} == {0.5}


def test_leaf_statistics(spark):
    df = frame(spark, [(0, 1, 2.0), (0, 1, 4.0), (0, 2, 5.0)], "tree int, leaf int, x double")
    got = {r["leaf"]: r for r in synthesis.leaf_stats(df, ["tree", "leaf"], ["x"]).collect()}
    assert got[1]["sd"] == pytest.approx(math.sqrt(2))
    assert got[2]["sd"] is None


def test_copula_keeps_marginals(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 100).cast("double").alias("x"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("s"))
    model = synthesis.GaussianCopula(["x"], ["s"])
    model.fit(df)
    scores = {r["column"]: r["score"] for r in quality.column_shapes(df, model.generate(2000), ["x"], ["s"]).collect()}
    assert min(scores.values()) > 0.9


def test_evaluate_and_skip_what_is_stored(spark):
    rows = [(k, float(k % 7), "xy"[k % 2], "pqr"[k % 3]) for k in range(60)]
    real = frame(spark, rows, "id long, x double, s string, t string")
    roles = tables.Roles(id="id", key_fields=("s",), sensitive_fields=("t",))
    sets = tables.TableSet(real, {"identity": real}, roles=roles)
    found = evaluate.evaluate(sets, ["Basic Quality", "Likelihood", "nonsense"])
    values = {(r["metric_type"], r["metric"]): r["value"] for r in found.collect()}
    assert values["Basic Quality", "Overall Quality"] == 1.0
    assert values["Basic Quality", "New Row Synthesis"] == 0.0
    assert evaluate.evaluate(sets, ["Basic Quality"], stored=found).count() == 0


def test_distance_and_attacks_see_categories(spark):
    real = frame(spark, [(k, 1.0, f"s{k % 5}", "pq"[k % 2]) for k in range(10)], "id long, x double, s string, t string")
    other = frame(spark, [(k, 1.0, f"z{k % 5}", "r") for k in range(10)], "id long, x double, s string, t string")
    for columns in (real.columns, ["id", "s", "t"]):
        sets = tables.TableSet(real.select(*columns), {"other": other.select(*columns)}, roles=tables.Roles(id="id"))
        values = {r["metric"]: r["value"] for r in evaluate.evaluate(sets, ["Distance", "Singling Out"]).collect()}
        assert values["removed_rows RS"] == 0 and values["mean RS"] > 0
        assert {"main_rate", "baseline_rate", "risk"} <= set(values) and "control_rate" not in values
    unique = frame(spark, [(1, "a"), (2, "b"), (3, "b")], "id long, s string")
    assert [(r["value"], r["success"]) for r in attacks.singling_out_levels(unique, unique, ["s"]).collect()] == [("a", True)]


def test_every_family_is_registered(spark):
    assert set(evaluate.REGISTRY) == set(report.FAMILIES)
    rows = lambda a: [(k, float(k % 7), "xy"[k % 2], "no" if k % 7 < 3 else "yes") for k in range(a, a + 60)]
    real, control = (frame(spark, rows(a), "id long, x double, s string, t string") for a in (0, 60))
    sets = tables.TableSet(real, {"identity": real}, control, tables.Roles(id="id", target="t"))
    values = {(r["metric_type"], r["metric"]): r["value"] for r in evaluate.evaluate(sets, ["Utility", "Membership Inference Attack"]).collect()}
    assert values["Utility", "accuracy"] == 1.0
    assert 0 <= values["Membership Inference Attack", "BBox - Acc"] <= 1 and 0 <= values["Membership Inference Attack", "Shadow - Acc"] <= 1


def test_synthesis_keeps_rows_with_nulls(spark):
    rows = [(float(k % 10), 5.0 if k % 20 == 0 else None, None, None if k % 4 == 0 else "ab"[k % 2]) for k in range(400)]
    df = frame(spark, rows, "x double, y double, z double, s string")
    numeric = ["x", "y", "z"]
    assert synthesis.null_rates(df, numeric) == {"x": 0.0, "y": 0.95, "z": 1.0}
    for model in (synthesis.GaussianCopula(numeric, ["s"]), synthesis.ForestDensity(numeric, ["s"], trees=3, rounds=1)):
        model.fit(df)
        got = model.generate(400).toPandas()
        assert got["x"].nunique() > 5 and not got["x"].isna().any() and got["z"].isna().all()
        assert 0.9 < got["y"].isna().mean() < 1
        missing = got["s"].isna() | (got["s"] == "missed")
        assert 0.15 < missing.mean() < 0.35
    assert (synthesis.ForestDensity(numeric, []).trees, synthesis.ForestDensity(numeric, []).rounds) == (30, 10)


TREE = """DecisionTreeClassificationModel: depth=2, numNodes=5
  If (feature 0 <= 1.5)
   If (feature 1 in {0.0,2.0})
    Predict: 0.0
   Else (feature 1 not in {0.0,2.0})
    Predict: 1.0
  Else (feature 0 > 1.5)
   If (feature 0 <= 4.0)
    Predict: 0.0
   Else (feature 0 > 4.0)
    Predict: 1.0
"""


def test_leaves_of_a_printed_tree():
    paths = synthesis.leaf_paths(TREE)
    assert [len(p) for p in paths] == [2, 2, 2, 2]
    assert paths[0][1] == (1, "in", frozenset({0.0, 2.0})) and paths[1][1][1] == "not in"
    inf = float("inf")
    assert [synthesis.leaf_bounds(p, 2)[0] for p in paths] == [(-inf, 1.5), (-inf, 1.5), (1.5, 4.0), (4.0, inf)]
    assert synthesis.prune(paths, {0: 9, 1: 9, 2: 9, 3: 2}, 5) == {0: 0, 1: 1, 2: 2, 3: 2}
    assert synthesis.prune(paths, {0: 1, 1: 1, 2: 9, 3: 9}, 5) == {0: 0, 1: 0, 2: 0, 3: 0}
    assert synthesis.prune(paths, {0: 9, 1: 9, 2: 9, 3: 9}, 5) == {0: 0, 1: 1, 2: 2, 3: 3}


def test_classes_are_drawn_as_such(spark):
    rows = [(float(k % 50) + (500 if k % 500 == 0 else 0), "rare" if k % 500 == 0 else "usual" if k % 3 else "other", "xy"[k % 2]) for k in range(2000)]
    df = frame(spark, rows, "x double, c string, s string")
    for model in (synthesis.GaussianCopula(["x"], ["c", "s"], target="c"), synthesis.ForestDensity(["x"], ["c", "s"], trees=4, rounds=1, target="c")):
        model.fit(df)
        made = model.generate(0, {"rare": 70, "usual": 20, "other": 0}).toPandas()
        assert made["c"].value_counts().to_dict() == {"rare": 70, "usual": 20} and sorted(made["row_id"]) == list(range(90))
        assert made.groupby("c")["x"].median()["rare"] > made.groupby("c")["x"].median()["usual"]
        with pytest.raises(ValueError, match="no rows of"):
            model.generate(0, {"absent": 1})
    with pytest.raises(ValueError, match="target"):
        model = synthesis.GaussianCopula(["x"], ["c"])
        model.fit(df)
        model.generate(5, {"rare": 1})


def test_votes_of_trees_that_left_a_row_out(spark):
    weights = spark.range(20000).select(*(synthesis.bag_weight(F.col("id"), bag, 7).alias(f"w{bag}") for bag in range(2))).toPandas()
    shares = weights["w0"].value_counts(normalize=True)
    assert [shares[float(k)] for k in range(4)] == pytest.approx([math.exp(-1), math.exp(-1), math.exp(-1) / 2, math.exp(-1) / 6], abs=0.01)
    assert abs(weights["w0"].corr(weights["w1"])) < 0.03
    rows = [(k, float(k % 2), round(0.37 * k % 1, 3), 1 + k % 3) for k in range(40) for _ in range(1 + k % 2)]
    votes = {}
    for i, label, p, trees in rows:
        a, b = votes.get((i, label), (0.0, 0))
        votes[i, label] = (a + p * trees, b + trees)
    right = [(a / b > 0.5) == bool(label) for (_, label), (a, b) in votes.items()]
    assert synthesis.out_of_bag(frame(spark, rows, "id long, label double, p double, trees int")) == pytest.approx(np.mean(right))
    df = frame(spark, [(float(k % 9), "ab"[k % 9 > 4]) for k in range(300)], "x double, s string")
    model = synthesis.ForestDensity(["x"], ["s"], trees=5, rounds=4, bags=2)
    model.fit(df)
    assert 1 <= len(model.accuracies) <= 4 and all(0 <= a <= 1 for a in model.accuracies)


def test_draws_do_not_depend_on_batches(spark):
    df = frame(spark, [(float(k % 17), "ab"[k % 2]) for k in range(300)], "x double, s string")
    for model in (synthesis.GaussianCopula(["x"], ["s"]), synthesis.ForestDensity(["x"], ["s"], trees=3, rounds=1)):
        model.fit(df)
        got = []
        for size, parts in (("10000", "4"), ("7", "2")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", parts)
            got.append(sorted(map(tuple, model.generate(200).collect())))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        assert got[0] == got[1]


def test_levels_that_splits_leave(spark):
    paths = synthesis.leaf_paths(TREE)
    assert [synthesis.leaf_levels(p, 1, 4) for p in paths] == [{0, 2}, {1, 3}, None, None]
    rows = frame(spark, [(0, 0, "a"), (0, 0, "a"), (0, 1, "b")], "tree int, leaf int, c string")
    allowed = frame(spark, [(0, 0, "a")], "tree int, leaf int, value string")
    got = {(r["leaf"], r["value"]): r["prob"] for r in synthesis.level_probability(rows, ["tree", "leaf"], "c", 1.0, allowed).collect()}
    assert got == {(0, "a"): 1.0, (1, "a"): pytest.approx(1 / 3), (1, "b"): pytest.approx(2 / 3)}


def test_normal_scores(spark):
    from statistics import NormalDist

    from tabverity.functions import draws

    u = np.array([1e-12, 1e-6, 0.01, 0.3, 0.5, 0.9, 1 - 1e-6])
    assert draws.quantile(u) == pytest.approx([NormalDist().inv_cdf(x) for x in u], abs=1e-5)
    assert draws.cdf(np.array([-3.0, 0.0, 1.5])) == pytest.approx([NormalDist().cdf(x) for x in (-3.0, 0.0, 1.5)], abs=1e-7)
    df = frame(spark, [(float(k),) for k in range(101)], "x double")
    fitted = prepare.Imputer(normal=True).fit(df)
    scored = fitted.transform(df)
    z = sorted(r["x"] for r in scored.collect())
    assert z[50] == pytest.approx(0, abs=1e-6) and z[0] == pytest.approx(-z[-1]) and z[0] < -5
    assert sorted(r["x"] for r in fitted.inverse(scored).collect()) == pytest.approx(list(range(101)), abs=1e-3)


def test_all_nulls_come_back(spark):
    df = frame(spark, [(k, None if k < 15 else 0.5 + k) for k in range(22)], "k long, x double")
    fitted = prepare.ContinuousTransformer("k").fit(df)
    assert fitted.inverse(fitted.transform(df)).where("x is null").count() == 15


def test_searches_by_fronts():
    assert search.fronts([[1, 1], [2, 2], [2, 1], [0, 3]]) == [2, 0, 1, 0]
    assert search.crowding([[0.0], [1.0], [3.0]])[1] == 1.0
    space = search.Space({"a": dict, "b": dict}, {"a": {"x": [1, 2], "y": [3]}})
    assert space.every() == [{"model": "a", "x": 1, "y": 3}, {"model": "a", "x": 2, "y": 3}, {"model": "b"}]
    assert search.trial_folder("p", 3, {"model": "a", "x": 1, "y": 3}) == "p/trials/trial-3_a_x-1_y-3"


def test_ranges_cross_and_mutate():
    rng = random.Random(1)
    for r in (search.Range(1, 9), search.Range(1, 64, whole=True, log=True)):
        drawn = [r.draw(rng) for _ in range(200)]
        assert all(r.low <= x <= r.high for x in drawn) and (not r.whole or all(isinstance(x, int) for x in drawn))
        children = [r.cross(2, 8, rng) for _ in range(400)]
        assert all(r.low <= x <= r.high for x in children) and sum(abs(x - 2) < 1 or abs(x - 8) < 1.5 for x in children) > 250
        changed = [r.mutate(5, rng) for _ in range(300)]
        assert all(r.low <= x <= r.high for x in changed) and len(set(changed)) > 3
    with pytest.raises(ValueError, match="range"):
        search.Space({"a": dict}, {"a": {"x": search.Range(0, 1)}}).every()


def test_a_stopped_search_goes_on(spark, tmp_path):
    """The front of a small space is the one of all combinations; a search that was killed scores no trial twice."""
    space = search.Space({"a": dict}, {"a": {"x": list(range(5)), "y": list(range(4))}})
    goals = lambda p: {"f1": float(p["x"]), "risk": float((p["x"] - p["y"]) ** 2 + p["y"])}
    sets = tables.TableSet(frame(spark, [(k, "ab"[k % 2]) for k in range(4)], "k long, c string"), {}, None, tables.Roles(id="k"))
    wanted, made = {"Basic Quality": ["f1", "risk"]}, []

    def score(tables_, proposal, *rest):
        if len(made) == 9:
            made.append(None)
            raise RuntimeError("killed")
        made.append(proposal)
        return goals(proposal)

    ask = lambda: search.genetic_search(sets, space, wanted, str(tmp_path), n_trials=20, population=5, score=score)
    search_limit, search.MOST_DUPLICATES = search.MOST_DUPLICATES, 500
    try:
        with pytest.raises(RuntimeError, match="killed"):
            ask()
        found = ask().collect()
    finally:
        search.MOST_DUPLICATES = search_limit
    proposals = [json.dumps(p, sort_keys=True) for p in made if p is not None]
    assert len(proposals) == len(set(proposals)) == 20
    every = [{"model": "a", "x": x, "y": y} for x in range(5) for y in range(4)]
    beaten = lambda p: any(goals(q)["f1"] >= goals(p)["f1"] and goals(q)["risk"] <= goals(p)["risk"] and goals(q) != goals(p) for q in every)
    assert {r["params"] for r in found} == {json.dumps(p, sort_keys=True) for p in every if not beaten(p)}


def test_metrics_that_never_succeed(spark):
    trials = [{"number": k, "proposal": {"model": "a", "x": k}, "scores": {"f1": float(k), "risk": None}} for k in range(3)]
    found = search.as_table(spark, trials, ["f1", "risk"])
    assert found.columns == ["trial", "model", "params", "f1"] and [r["trial"] for r in search.best_of(found, ["f1", "risk"]).collect()] == [2]


def test_modes_and_roles(spark):
    assert runs.parse_mode("Only Original") == "onlyoriginal" and runs.parse_mode(None) == "runall"
    with pytest.raises(ValueError, match="none of"):
        runs.parse_mode("some")
    bare = tables.TableSet(frame(spark, [(1,)], "k long"))
    assert runs.missing_roles(bare, ["Linkability", "Basic Quality"]) == {"Linkability": ["id", "aux"]}
    with pytest.raises(ValueError, match="Inference needs id"):
        runs.validate(bare, ["Inference"])


def test_a_run_resumes_and_updates(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setitem(evaluate.REGISTRY, "Counted", lambda t, s: {"rows": lambda: calls.append(1) or s.count()})
    monkeypatch.setitem(evaluate.REGISTRY, "Broken", lambda t, s: (_ for _ in ()).throw(ValueError("no such column")))
    real = frame(spark, [(k, "a" if k % 2 else "b") for k in range(10)], "k long, c string")
    one = tables.TableSet(real, {"m": real.limit(4)}, None, tables.Roles(id="k"))
    store = runs.Store(spark, str(tmp_path / "store"))
    first = {r["metric_type"]: (r["value"], r["status"]) for r in runs.run_synthetic(one, store, ["Counted", "Broken"]).collect()}
    assert first == {"Counted": (4.0, "ok"), "Broken": (None, "failed: no such column")}
    runs.run_synthetic(one, store, ["Counted", "Broken"])
    assert len(calls) == 1
    more = tables.TableSet(real, {"m": real.limit(6)}, None, one.roles)
    assert {r["metric_type"]: r["value"] for r in runs.update(more, store, "Counted").collect()} == {"Counted": 6.0, "Broken": None}
    runs.run_synthetic(more, store, ["Counted"])
    assert len(calls) == 2
    original = runs.run_original(one, store, ["Counted"]).where("model_name = 'Original'").collect()
    assert [r["value"] for r in original] == [5.0]
    store.save_config({"mode": "runall"})
    assert runs.Store(spark, str(tmp_path / "store")).config() == {"mode": "runall"}
    store.export_csv(str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["metric_type", "metric", "Original", "m"]
    done = runs.run(frame(spark, [(k, "a" if k % 2 else "b", float(k)) for k in range(60)], "k long, c string, x double"), tables.Roles(id="k", target=None), [synthesis.GaussianCopula(["x"], ["c"])], str(tmp_path / "whole"), runs.Settings(families=["Counted"]))
    assert {r["model_name"]: r["value"] for r in done.collect()} == {"gaussian_copula": 48.0, "Original": 24.0}


def test_forest_grows_on_cells_of_rows(spark, monkeypatch):
    """What trees learn from is bounded by intervals and levels; leaves hold all rows with their exact moments."""
    from pyspark.ml.classification import RandomForestClassifier

    learned, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: learned.append(df.count()) or fit(self, df))
    x = np.random.default_rng(3).lognormal(3, 1, 6000)
    df = frame(spark, [(float(v), "abc"[int(v) % 3] if v > 20 else "a") for v in x], "x double, s string")
    model = synthesis.ForestDensity(["x"], ["s"], trees=4, rounds=2)
    model.fit(df)
    assert learned and max(learned) <= 2 * synthesis.BINS * 3
    for _, leaves in model.stats.toPandas().groupby("tree"):
        assert leaves["n"].sum() == len(x) and leaves["n"].min() >= 5
        assert (leaves["n"] * leaves["mean"]).sum() == pytest.approx(x.sum())
        assert ((leaves["n"] - 1) * leaves["sd"] ** 2 + leaves["n"] * leaves["mean"] ** 2).sum() == pytest.approx((x**2).sum())
    assert model.probabilities["s"].groupBy("tree", "leaf").agg(F.sum("prob").alias("p")).agg(F.max(F.abs(F.col("p") - 1))).first()[0] < 1e-9


def test_ranks_look_up_sorted_points(spark):
    points = [0.0, 1.0, 1.0, 2.0, 4.0]
    df = frame(spark, [(v,) for v in (-1.0, 0.0, 0.5, 1.0, 1.5, 3.0, 4.0, 9.0, None)], "x double")
    ranked = df.select("x", prepare._rank(F.col("x"), points).alias("u"))
    assert {r["x"]: r["u"] for r in ranked.collect()} == {-1.0: 0.0, 0.0: 0.0, 0.5: 0.125, 1.0: 0.375, 1.5: 0.625, 3.0: 0.875, 4.0: 1.0, 9.0: 1.0, None: None}
    assert "lambda" not in ranked._jdf.queryExecution().toString()  # no row goes through all points


def test_forests_grow_in_parts_of_bounded_rows(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    parts, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(models, "TASK_ROWS", 50)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: parts.append(df.rdd.glom().map(len).collect()) or fit(self, df))
    df = frame(spark, [("ab"[k % 2], "xy"[k % 2]) for k in range(500)], "k string, s string").coalesce(1)
    assert models.forest_guess(df, df, ["k"], "s").first()[0] == 0
    assert len(parts[0]) == 10 and max(parts[0]) <= 60
