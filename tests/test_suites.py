"""Model suites against plain loops over the same days."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, linear
from tidemark.plans import suites, timing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def days(spark):
    return suites.base_matrix(spark, SF).orderBy("d").toPandas()


def parts(days, h, year):
    first, before, last = dt.date(year, 1, 1), dt.date(year - 1, 1, 1), dt.date(year, 12, 31)
    end, d = days[f"target_end_{h}d"], days.d
    in_year = lambda y: d.map(lambda x: x.year == y)
    return {"train": days[end < before], "validation": days[in_year(year - 1) & (end < first)], "fit": days[end < first], "test": days[in_year(year) & (end <= last)]}


def plain_ridge(rows, columns, target, penalty):
    x, y = rows[columns].to_numpy(), rows[target].to_numpy()
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + penalty * np.eye(len(columns)), z.T @ (y - y.mean()))
    return lambda other: y.mean() + (other[columns].to_numpy() - mean) / sd @ w


def test_features_partition():
    assert len(suites.BASE) == len(set(suites.BASE)) == 16 and len(suites.BLOCKS) == 7 and len(suites.WIDE) == len(set(suites.WIDE)) == 24


def test_market_forecast(spark, days):
    got = {(r.target, r.variant): r for r in suites.market_forecast(spark, SF).collect()}
    assert len(got) == 20
    for h in suites.HORIZONS:
        target, said, errors = f"target_return_{h}d", {"zero": [], "mean": [], "momentum": [], "full": []}, []
        for year in range(days.d.min().year + 3, days.d.max().year + 1):
            p = parts(days, h, year)
            if len(p["fit"]) < 200 or len(p["validation"]) < 40 or len(p["test"]) < 20:
                continue
            check, test = p["validation"], p["test"]
            errors.append(test[target].to_numpy())
            said["zero"].append(np.zeros(len(test)))
            said["mean"].append(np.full(len(test), p["fit"][target].mean()))
            for name, columns in (("momentum", ["own"]), ("full", suites.BASE)):
                tried = [(np.mean((check[target].to_numpy() - plain_ridge(p["train"], columns, target, a)(check)) ** 2), -a) for a in suites.RIDGE]
                said[name].append(plain_ridge(p["fit"], columns, target, -min(tried)[1])(test))
        y = np.concatenate(errors)
        mean_mse = np.mean((y - np.concatenate(said["mean"])) ** 2)
        for name, forecast in said.items():
            p, r = np.concatenate(forecast), got[(f"{h}d", name)]
            mse = np.mean((y - p) ** 2)
            assert r.n == len(y) and r.years == len(errors) and math.isclose(r.mse, mse, rel_tol=1e-8)
            assert math.isclose(r.skill, 1 - mse / mean_mse, abs_tol=1e-8) and math.isclose(r.sign_accuracy, np.mean((y >= 0) == (p >= 0)), abs_tol=1e-9)
            better = sum(np.mean((a - b) ** 2) < np.mean((a - m) ** 2) for a, b, m in zip(errors, forecast, said["mean"], strict=True))
            assert r.years_better == better
            if name not in ("zero",):
                assert math.isclose(r.r, np.corrcoef(y, p)[0, 1], abs_tol=1e-8)


def test_positions_are_known_on_their_day(spark):
    m = suites.wide_matrix(spark, SF).select("d", "flow_out", "flow_age", "known", "dealer_z52").toPandas()
    released = suites.flow_releases(spark, SF).orderBy("out_at", "report_date").toPandas()
    out = released.out_at.tolist()
    for r in m.itertuples():
        last = max(i for i, day in enumerate(out) if day <= r.d)
        assert r.flow_out == out[last] and r.flow_age == (r.d - out[last]).days >= 0
        assert math.isclose(r.dealer_z52, released.dealer_z52[last]) and r.known == released.known[last]


def test_anchor(spark):
    one = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.25)], "target string, year int, mse double")
    assert [r.difference for r in linear.anchored(one, one, ["target", "year"], "mse").collect()] == [0.0, 0.0]
    for other in (one.withColumn("mse", F.col("mse") + 1e-6), one.where("target = 'a'")):
        with pytest.raises(Exception, match="differs from its parent"):
            linear.anchored(one, other, ["target", "year"], "mse").collect()


def slow_split(b, residual, l2, least, bins):
    found = (-math.inf, 0, 0)
    for c in range(b.shape[1]):
        for k in range(bins):
            left, right = residual[b[:, c] <= k], residual[b[:, c] > k]
            if min(len(left), len(right)) >= least:
                gain = left.sum() ** 2 / (len(left) + l2) + right.sum() ** 2 / (len(right) + l2) - residual.sum() ** 2 / (len(b) + l2)
                if gain > found[0] + 1e-9:
                    found = (gain, c, k)
    return found


def test_trees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).round(1)
    y = np.where(x[:, 1] > 0.2, 2.0, -1.0) + np.where((x[:, 3] > 0) & (x[:, 1] > 0.2), 1.5, 0.0) + rng.normal(scale=0.1, size=300)
    ends = boosting.edges(x)
    b = boosting.binned(x, ends)
    assert b.max() < boosting.BINS and all((c[:, None] > e[None, :]).sum(1).tolist() == k.tolist() for c, e, k in zip(x.T, ends, b.T, strict=True))
    gain, column, last = boosting.best_split(b, y, 0.1, 30, boosting.BINS)
    expected = slow_split(b, y, 0.1, 30, boosting.BINS)
    assert math.isclose(gain, expected[0]) and (column, last) == expected[1:]
    assert boosting.best_split(b[:40], y[:40], 0.1, 30, boosting.BINS)[0] == -math.inf
    s = boosting.Setting(1.0, 7, 0.0001)
    tree = boosting.grow(b, y, s, 30)
    leaf = tree.leaf_of(b)
    assert len(tree.values) <= 7 and min(np.bincount(leaf)) >= 30
    for i, v in enumerate(tree.values):
        assert math.isclose(v, y[leaf == i].sum() / ((leaf == i).sum() + 0.0001))
    p = boosting.boost(x, y, x, boosting.Setting(0.06, 7, 0.1), 100, 30)
    assert np.mean((y - p) ** 2) < 0.05 < np.var(y)
    assert np.allclose(boosting.boost(x, np.ones(300), x[:3], s, 3, 30), 1.0)


def test_boosting_folds(spark):
    """Settings are chosen by the validation year and predictions are those of the chosen setting."""
    rng = np.random.default_rng(6)
    first, rows = dt.date(2000, 1, 1), []
    for i in range(1400):
        x = float(rng.normal())
        day = first + dt.timedelta(days=i)
        rows.append((day, "t", day + dt.timedelta(days=1), x, (1.0 if x > 0 else -1.0) + float(rng.normal(scale=0.3))))
    df = spark.createDataFrame(rows, "d date, target string, y_end date, x double, y double").repartition(5)
    grid = (boosting.Setting(0.01, 2, 1.0), boosting.Setting(0.3, 2, 1.0))
    folds = linear.folds(df, "d", "y_end", 2)
    got = boosting.walk_forward(folds, ["x"], "d", (100, 50, 20), grid, 15, 10).toPandas()
    assert set(got.year) == {2002, 2003} and set(got.rate) == {0.3} and ((got.y - got.prediction) ** 2).mean() < 0.3
    parts = folds.where("year = 2002").toPandas().sort_values("d")
    fit, test = parts[parts.role == "fit"], parts[parts.role == "test"]
    own = boosting.boost(fit[["x"]].to_numpy(), fit.y.to_numpy(), test[["x"]].to_numpy(), grid[1], 15, 10)
    assert np.allclose(got[got.year == 2002].sort_values("d").prediction.to_numpy(), own)


def test_verdict(spark):
    def word(*rows):
        return timing.verdict(spark.createDataFrame(rows, "kind string, cutoff int, stable boolean, passes boolean")).first().verdict

    strict, late, naive, placebo = (("cutoff", timing.STRICT, True), ("cutoff", timing.EVENING[0], True), ("naive", 0, True), ("placebo", 0, None))
    assert word((*strict, True), (*naive, True), (*placebo, False)) == "robust"
    assert word((*strict, True), (*naive, True), (*placebo, True)) == "not_reproducible"
    assert word(("cutoff", timing.STRICT, False, True), (*placebo, False)) == "not_reproducible"
    assert word((*strict, False), (*late, True), (*naive, True)) == "timing_artifact"
    assert word((*strict, False), (*late, True), (*naive, False)) == word((*strict, False), (*late, False), (*naive, True)) == "not_reproducible"
