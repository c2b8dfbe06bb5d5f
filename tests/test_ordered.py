"""Order within groups by ranges, against pandas; bootstrap weights; sign tests of many trials."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import sign_test
from tidemark.operators import events, inference, ordered


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    return pd.DataFrame({"g": rng.choice(["a", "b", "c"], 900, p=[0.8, 0.15, 0.05]), "k": rng.permutation(900), "t": rng.integers(0, 60, 900), "v": rng.normal(size=900).round(1)})


def frame(spark, pdf):
    return spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)


@pytest.mark.parametrize("slices", [0, 100_000])
def test_places_running_maxima_and_lags(spark, rows, monkeypatch, slices):
    monkeypatch.setattr(ordered, "MOST_SLICES", slices)
    monkeypatch.setattr(ordered, "STRETCH", 7)
    df = frame(spark, rows)
    want = rows.sort_values(["g", "t", "k"]).reset_index(drop=True)
    want["pos"] = want.groupby("g").cumcount()
    got = ordered.placed(df, ["g"], ["t", "k"]).orderBy("g", "_pos").toPandas()
    assert got[["g", "t", "k"]].equals(want[["g", "t", "k"]]) and (got._pos.to_numpy() == want.pos.to_numpy()).all()
    top = want.groupby("g").v.transform(lambda s: s.cummax().shift())
    got = ordered.running_max_before(df, ["g"], ["t", "k"], "v", "top").orderBy("g", "t", "k").toPandas()
    assert np.allclose(got.top, top, equal_nan=True)
    got = ordered.with_lags(df, ["g"], ["t", "k"], "v", 3).orderBy("g", "t", "k").toPandas()
    assert len(got) == 900 and all(np.allclose(got[f"_l{n}"], want.groupby("g").v.shift(n), equal_nan=True) for n in (1, 2, 3))


def test_quantiles_are_exact(spark, rows):
    some = pd.concat([rows, pd.DataFrame({"g": ["one", "two", "two", "none"], "k": [1, 2, 3, 4], "t": [0] * 4, "v": [5.0, 1.0, 2.0, None]})])
    got = {r.g: r for r in ordered.quantiles(frame(spark, some), ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 0.95, "end": 1.0}).collect()}
    assert set(got) == {"a", "b", "c", "one", "two"}
    for g, own in some.dropna().groupby("g"):
        assert all(math.isclose(got[g][name], own.v.quantile(q), abs_tol=1e-12) for name, q in (("low", 0.1), ("mid", 0.5), ("top", 0.95), ("end", 1.0)))
    empty = frame(spark, some).limit(0)
    assert ordered.quantiles(empty, ["g"], "v", {"mid": 0.5}).collect() == [] and ordered.placed(empty, ["g"], ["t"]).count() == 0


def test_overlaps_and_summary_over_ranges(spark, rows):
    df = frame(spark, rows.assign(e=rows.t + 2))
    out = events.overlapping(df, ["g"], "t", "e", ["k"])
    want = rows.assign(e=rows.t + 2).sort_values(["g", "t", "e", "k"])
    before = want.groupby("g").e.transform(lambda s: s.cummax().shift())
    assert out.orderBy("g", "t", "e", "k").toPandas().overlaps.tolist() == (want.t < before).tolist()
    got = {r.g: r for r in events.summary(out, ["g"], "v").collect()}
    for g, own in want.groupby("g"):
        assert got[g].n == len(own) and math.isclose(got[g]["median"], own.v.median()) and got[g].n_overlapping == (want.t < before)[own.index].sum()


def test_hac_error_equals_its_formula(spark, rows):
    (r,) = [x for x in inference.hac_mean(frame(spark, rows), ["g"], ["t", "k"], "v", 3).collect() if x.g == "a"]
    v = rows[rows.g == "a"].sort_values(["t", "k"]).v.to_numpy()
    e = v - v.mean()
    long_run = (e @ e + 2 * sum((1 - k / 4) * (e[k:] @ e[:-k]) for k in (1, 2, 3))) / len(v)
    assert r.n == len(v) and math.isclose(r["mean"], v.mean()) and math.isclose(r.se, math.sqrt(long_run / len(v)), rel_tol=1e-9)


def test_bootstrap_weights_are_poisson_and_do_not_depend_on_partitions(spark, rows):
    w = inference.poisson_weights(np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64), 200, 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    bounds = lambda df: sorted((r.g, r.n, r.low, r.high) for r in inference.bootstrap_mean(df, ["g"], ["k"], "v", 300).collect())
    assert bounds(frame(spark, rows)) == bounds(frame(spark, rows).repartition(1))
    (r,) = [x for x in inference.bootstrap_mean(frame(spark, rows), ["g"], ["k"], "v", 2000).collect() if x.g == "a"]
    own = rows[rows.g == "a"].v
    half = 1.96 * own.std() / math.sqrt(len(own))
    assert abs((r.high - r.low) / 2 - half) < 0.15 * half and r.low < own.mean() < r.high


def test_sign_tests_of_many_trials(spark):
    cases = [(9800, 20000), (14900, 30000), (15000, 30000), (5_000_500_000, 10_000_000_000), (0, 0), (12, 12)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", sign_test(F.col("k"), F.col("n")).alias("p")).collect()

    def exact(k, n):
        low = min(k, n - k)
        if n > 10**6:
            return math.erfc((abs(n - 2 * k) - 1) / math.sqrt(2 * n))
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(max(0, low - 3000), low + 1)]
        return min(1.0, 2 * sum(map(math.exp, logs)))

    for r in got:
        assert math.isclose(r.p, exact(r.k, r.n), rel_tol=2e-3)
