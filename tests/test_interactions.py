"""Interaction and regime models, memories, direction chances and ties, against plain loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import interactions, linear
from tidemark.plans import research, suites

SF = "/root/testdata/sf0.01"
TERMS = {"a_x_b": ("a", "b")}
MINIMUM = (100, 20, 10)
REGIMES = [("a_regime", "a", 0.0, "hi", "lo")]


def days(kind):
    rng = np.random.default_rng(1234)
    d = pd.bdate_range("2012-01-01", "2026-12-31")
    a, b, c = rng.choice([-1.0, 1.0], len(d)), rng.choice([-1.0, 1.0], len(d)), rng.normal(size=len(d))
    y = a * b + rng.normal(scale=0.02, size=len(d)) if kind == "xor" else rng.normal(size=len(d))
    return pd.DataFrame({"d": d.date, "y_end": (d + pd.Timedelta(days=1)).date, "a": a, "b": b, "c": c, "y": y, "target": "1d"})


def parts(rows, year):
    first, before, last = dt.date(year, 1, 1), dt.date(year - 1, 1, 1), dt.date(year, 12, 31)
    of = lambda y: rows.d.map(lambda x: x.year == y)
    return {"train": rows[rows.y_end < before], "validation": rows[of(year - 1) & (rows.y_end < first)], "fit": rows[rows.y_end < first], "test": rows[of(year) & (rows.y_end <= last)]}


def plain(rows, columns, penalty):
    x, y = rows[columns].to_numpy(float), rows.y.to_numpy(float)
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd * sd <= 1e-18, 1.0, sd)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + penalty * np.eye(len(columns)), z.T @ (y - y.mean())) if columns else np.empty(0)
    return (lambda other: y.mean() + (other[columns].to_numpy(float) - mean) / sd @ w), w


def chosen(p, columns, penalties):
    scored = [(np.mean((p["validation"].y - plain(p["train"], columns, a)[0](p["validation"])) ** 2), i, a) for i, a in enumerate(penalties)]
    return min(scored)[2]


@pytest.mark.parametrize("kind", ["xor", "noise"])
def test_interaction_models_equal_a_plain_loop(spark, kind):
    rows = days(kind)
    features, penalties = ["a", "b", "c"], (0.1, 10.0)
    folds = linear.folds(spark.createDataFrame(rows), "d", "y_end", 6)
    stats = linear.gram(interactions.with_terms(folds, TERMS), ["target", "year", "role"], [*features, "term__a_x_b"], "y").cache()
    models = interactions.interaction_models(stats, features, TERMS, penalties, MINIMUM).cache()
    rows = rows.assign(term__a_x_b=rows.a * rows.b)
    every = interactions.variants(features, TERMS) | {"joint": [*features, "term__a_x_b"]}
    got = {(r.year, r.variant): r for r in models.collect()}
    assert {y for y, _ in got} == set(range(2018, 2027)) and len(got) == 9 * len(every)
    for year in range(2018, 2027):
        p = parts(rows, year)
        for name, columns in every.items():
            best = chosen(p, columns, penalties)
            mse = np.mean((p["test"].y - plain(p["fit"], columns, best)[0](p["test"])) ** 2)
            assert got[year, name].penalty == best and math.isclose(got[year, name].mse, mse, rel_tol=1e-9, abs_tol=1e-12)
    table = {r.variant: r for r in interactions.paired(models, 5, 100).collect()}
    term, joint = table["term__a_x_b"], table["joint"]
    marginal = {r.feature: r.r for r in interactions.marginal_correlations(stats, models, features, 6).collect()}
    test = pd.concat([parts(rows, y)["test"] for y in range(2018, 2027)])
    assert all(math.isclose(marginal[c], np.corrcoef(test[c], test.y)[0, 1], abs_tol=1e-9) for c in features)
    if kind == "xor":
        assert abs(marginal["a"]) < 0.15 > abs(marginal["b"])
        base = np.mean([got[y, "baseline"].mse for y in range(2018, 2027)])
        assert term.delta < -0.5 * base and joint.delta < -0.5 * base and term.low <= term.delta <= term.high
        assert term.in_favour == term.folds == 9 and math.isclose(term.p, 2 / 2**9, rel_tol=1e-9) and term.significant
        assert not any(table[f"loo__{c}"].significant for c in features)
    else:
        assert not any(r.significant for r in table.values())


def test_regime_models_equal_a_plain_loop(spark):
    rows = days("xor")
    folds = linear.folds(spark.createDataFrame(rows), "d", "y_end", 6)
    models = interactions.regime_models(folds, ["b", "c"], REGIMES, (0.1, 1.0), (50, 10, 5)).cache()
    got = {(r.level, r.year): r for r in models.collect()}
    assert len(got) == 18
    coefficients = {"hi": [], "lo": []}
    for year in range(2018, 2027):
        for level, of in (("hi", rows.a > 0), ("lo", rows.a <= 0)):
            p = parts(rows[of], year)
            best = chosen(p, ["b", "c"], (0.1, 1.0))
            predict, w = plain(p["fit"], ["b", "c"], best)
            coefficients[level].append(w)
            assert math.isclose(got[level, year].mse, np.mean((p["test"].y - predict(p["test"])) ** 2), rel_tol=1e-8)
            assert math.isclose(got[level, year].mse_mean, np.mean((p["test"].y - p["fit"].y.mean()) ** 2), rel_tol=1e-8)
    for r in interactions.regime_summary(models, folds, ["b", "c"], REGIMES).collect():
        assert (r.folds, r.skipped_folds) == (9, 0) and r.skill > 0.9
        assert np.allclose([c.coefficient for c in r.coefficients], np.mean(coefficients[r.level], axis=0), atol=1e-8)
    starved = interactions.regime_summary(interactions.regime_models(folds, ["b", "c"], REGIMES, (0.1,), (10**6, 10, 5)), folds, ["b", "c"], REGIMES).collect()
    assert {(r.level, r.folds, r.skipped_folds, r.mse) for r in starved} == {("hi", 0, 9, None), ("lo", 0, 9, None)}


def test_equal_errors_take_the_stronger_penalty(spark):
    """Two columns of noise: several penalties give no weight at all, and the strongest of them must stay."""
    rng = np.random.default_rng(8)
    d = pd.bdate_range("2010-01-01", "2015-12-31")
    rows = pd.DataFrame({"d": d.date, "y_end": d.date, "x": rng.normal(size=len(d)), "z": rng.normal(size=len(d)), "y": rng.normal(scale=0.01, size=len(d)), "target": "t"})
    stats = linear.gram(linear.folds(spark.createDataFrame(rows), "d", "y_end", 3), ["target", "year", "role"], ["x", "z"], "y")
    out = linear.walk_forward(stats, ["x", "z"], (0.1, 0.003, 0.01, 0.03), kind="elastic_net", l1_ratios=(1.0, 0.5), minimum=(100, 20, 20)).collect()
    assert len(out) == 3
    assert all((r.penalty, r.l1_ratio) == (0.1, 1.0) and r.coefficients[1:] == [0.0, 0.0] for r in out)


def test_direction_chances_use_residuals_of_unseen_rows(spark):
    got = {(r.year, r.d): r for r in research.direction_probabilities(spark, SF).collect()}
    rows = research.matrix(spark, SF).orderBy("d").toPandas()
    checked = 0
    for year in range(rows.d.min().year + 3, rows.d.max().year + 1):
        p = parts(rows, year)
        if len(p["fit"]) < 200 or len(p["validation"]) < 40 or len(p["test"]) < 20:
            continue
        best = chosen(p, research.FEATURES, research.PENALTIES)
        residuals = (p["validation"].y - plain(p["train"], research.FEATURES, best)[0](p["validation"])).to_numpy()
        lo, hi = np.quantile(p["fit"].y, [1 / 3, 2 / 3])
        for day, forecast, y in zip(p["test"].d, plain(p["fit"], research.FEATURES, best)[0](p["test"]), p["test"].y, strict=True):
            r = got[year, str(day)]
            assert math.isclose(r.down, np.mean(forecast + residuals < lo), abs_tol=1e-9) and math.isclose(r.up, np.mean(forecast + residuals > hi), abs_tol=1e-9)
            assert math.isclose(r.down + r.flat + r.up, 1) and r.actual == ("down" if y < lo else "up" if y > hi else "flat")
            checked += 1
    assert checked == len(got) > 500


def test_memory_suite_equals_a_plain_loop(spark):
    matrix = suites.memory_matrix(spark, SF).cache()
    rows = matrix.orderBy("d").toPandas()
    base = suites.base_matrix(spark, SF).orderBy("d").toPandas()
    p = 2.0 ** (-1 / 10)
    memory, at = base.z1[0], {}
    for day, x in zip(base.d, base.z1, strict=True):
        memory = p * memory + (1 - p) * x
        at[day] = memory
    assert np.allclose(rows.memory_z1, [at[day] for day in rows.d], atol=1e-9)
    assert np.allclose(rows.fade_dealer_z52, rows.dealer_z52 * 2.0 ** (-rows.flow_age / 14)) and np.allclose(rows.fade_stocks_z52, rows.stocks_z52 * 2.0 ** (-rows.energy_age / 30))
    assert len(suites.OBSERVED) == len(set(suites.OBSERVED)) == 16 and len(suites.REMEMBERED) == len(set(suites.REMEMBERED)) == 13
    for r in suites.memory_suite(spark, SF).collect():
        own = rows.assign(y=rows[f"target_return_{r.target}"], y_end=rows[f"target_end_{r.target}"])
        errors = {"observed": [], "memory": []}
        sizes = []
        for year in range(own.d.min().year + 3, own.d.max().year + 1):
            part = parts(own, year)
            if len(part["fit"]) < 200 or len(part["validation"]) < 40 or len(part["test"]) < 20:
                continue
            sizes.append(len(part["test"]))
            for name, columns in (("observed", suites.OBSERVED), ("memory", [*suites.OBSERVED, *suites.REMEMBERED])):
                best = chosen(part, columns, suites.RIDGE)
                errors[name].append(np.mean((part["test"].y - plain(part["fit"], columns, best)[0](part["test"])) ** 2))
        assert (r.folds, r.n) == (len(sizes), sum(sizes))
        assert math.isclose(r.observed_mse, np.average(errors["observed"], weights=sizes), rel_tol=1e-8) and math.isclose(r.memory_mse, np.average(errors["memory"], weights=sizes), rel_tol=1e-8)
        better = np.array(errors["observed"]) - np.array(errors["memory"])
        assert r.in_favour == (better > 0).sum() and math.isclose(r.improvement, better.mean(), abs_tol=1e-9)


def test_every_regime_level_is_listed(spark):
    out = suites.regime_models(spark, SF)
    assert out.count() == 16 and out.where(F.col("folds") + F.col("skipped_folds") < 1).count() == 0
