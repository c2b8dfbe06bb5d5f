"""Operators on values worked out by hand."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns
from tidemark.operators import audits, bars, events, features, graph, inference, linear, quality, spectral, temporal
from tidemark.plans import research
from tidemark.plans.knowledge import cut
from tidemark.streaming import bars as streaming

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
T = dt.datetime
D = dt.date


def test_delta_candles_run_through_rejected_rows(spark):
    base = 1_800_000_000_000 // 3_600_000 * 3_600_000
    blob = spark.createDataFrame([(1, base, 1e-4, 2.0, 2.0, 2.0, 2.0, [1, 2, 1, 4], [0, 10, -5, 20], [30, 0, 40, 10], [-20, 0, -90, 5], [10, 5, 0, 200], [1.0] * 4)], "id long, timestamp long, multiplier double, open double, high double, low double, close double, times array<int>, opens array<int>, highs array<int>, lows array<int>, closes array<int>, volumes array<double>")
    rows = bars.quarantine(bars.explode_candles(blob)).orderBy("pos").collect()
    start = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=base)
    assert [r.bar_start for r in rows] == [start + dt.timedelta(hours=h) for h in (1, 3, 4, 8)]
    assert [round(r.open, 6) for r in rows] == [2.0, 2.001, 2.0005, 2.0025] and [round(r.close, 6) for r in rows] == [2.001, 2.0015, 2.0015, 2.0215]
    assert [r.reject for r in rows] == ["", "", "", "invalid_ohlc"]


def test_sessions_follow_new_york(spark):
    times = ["2024-03-08 21:59:00", "2024-03-08 22:00:00", "2024-03-11 20:59:00", "2024-03-11 21:00:00", "2024-11-01 20:59:00", "2024-11-04 22:00:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").select("i", columns.session_date(F.col("t").cast("timestamp_ntz")).alias("d"))
    assert [r.d for r in df.orderBy("i").collect()] == [D(2024, 3, 8), D(2024, 3, 9), D(2024, 3, 11), D(2024, 3, 12), D(2024, 11, 1), D(2024, 11, 5)]


def test_expected_hours_merge_holidays(spark):
    days = spark.createDataFrame([(D(2024, 1, 3),), (D(2024, 1, 6),)], "session_date date")
    holidays = spark.createDataFrame([(T(2024, 1, 3, 1), T(2024, 1, 3, 2, 30)), (T(2024, 1, 3, 2, 15), T(2024, 1, 3, 3))], "from_ts timestamp_ntz, till_ts timestamp_ntz")
    left = bars.expected_hours(days, holidays)
    assert left.count() == 22 and left.where("session_date = date'2024-01-06'").count() == 0


def test_as_of_of_weekly_releases(spark):
    grid = spark.createDataFrame([(D(2024, 1, d),) for d in (4, 5, 11, 12)], "d date")
    rel = spark.createDataFrame([(D(2024, 1, 5), 1), (D(2024, 1, 12), 2)], "a date, v int")
    got = [(r.v, (r.d - r.matched_at).days if r.matched_at else None) for r in temporal.as_of(grid, rel, "d", "a", ["v"]).orderBy("d").collect()]
    assert got == [(None, None), (1, 0), (1, 6), (2, 0)]
    assert [r.v for r in temporal.as_of(grid, rel, "d", "a", ["v"], strict=True).orderBy("d").collect()] == [None, None, 1, 1]
    assert [r.v for r in temporal.as_of(grid, rel, "d", "a", ["v"], direction="forward").orderBy("d").collect()] == [1, 1, 2, 2]
    assert [r.v for r in temporal.as_of(grid, rel, "d", "a", ["v"], direction="forward", strict=True).orderBy("d").collect()] == [1, 2, 2, None]


def test_as_of_forward_over_buckets(spark):
    grid = spark.createDataFrame([(D(y, m, 9),) for y in range(2020, 2026) for m in (1, 6, 12)], "d date")
    rel = spark.createDataFrame([(D(2021, 6, 9), 1), (D(2021, 6, 10), 2), (D(2024, 2, 1), 3)], "a date, v int")
    for strict in (False, True):
        for direction in ("backward", "forward"):
            plain = temporal.as_of(grid, rel, "d", "a", ["v"], direction=direction, strict=strict)
            got = temporal.as_of_bucketed(grid, rel, "d", "a", ["v"], F.year, direction=direction, strict=strict)
            assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_next_scheduled(spark):
    days = spark.createDataFrame([(D(2023, 12, 20),), (D(2023, 12, 24),), (D(2024, 1, 3),), (D(2024, 2, 1),)], "day date")
    schedule = spark.createDataFrame([(D(2024, 1, 3),), (D(2024, 1, 5),), (None,)], "release date")
    assert [r.release for r in temporal.next_scheduled(days, schedule).orderBy("day").collect()] == [None, D(2024, 1, 3), D(2024, 1, 5), None]


def test_ema_of_many_blocks(spark):
    rng = random.Random(3)
    for half_life in (0.4, 5.0, 300.0):
        rows = [(s, i, rng.gauss(0, 1) if i % 50 else None) for s in ("a", "b") for i in range(900)]
        df = spark.createDataFrame(rows, "s string, i int, x double").repartition(5)
        got = {(r.s, r.i): r.m for r in features.ema(df, "s", "i", "x", half_life, "m", lambda c: F.floor(c / 400)).collect()}
        p = 2 ** (-1 / half_life)
        expected, m = {}, {}
        for s, i, x in rows:
            if x is not None:
                m[s] = x if s not in m else p * m[s] + (1 - p) * x
                expected[s, i] = m[s]
        assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_revisions_and_unknown_availability(spark):
    rows = spark.createDataFrame([("gdp", 1.6, T(2024, 4, 25, 12, 30), 0), ("gdp", 1.3, T(2024, 5, 30, 12, 30), 1), ("cpi", 3.0, None, 0)], "k string, v double, available_at timestamp_ntz, rev int")

    def at(t):
        return [r.v for r in temporal.latest_known(rows, F.lit(t).cast("timestamp_ntz"), ["k"], ["rev"]).collect()]

    assert at("2024-04-25 12:29:00") == [] and at("2024-05-01 00:00:00") == [1.6] and at("2024-06-01 00:00:00") == [1.3]


def test_memory_and_decay(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([0.0, 1.0, 1.0])], "s string, i int, x double")
    assert [r.m for r in features.ema(df, "s", "i", "x", 1.0, "m", lambda c: F.floor(c / 2)).orderBy("i").collect()] == [0.0, 0.5, 0.75]
    ages = spark.createDataFrame([(a,) for a in (0, 14, 28, -1)], "a int").select((2.5 * columns.age_decay(F.col("a"), 14)).alias("v"))
    assert [r.v for r in ages.collect()] == [2.5, 1.25, 0.625, None]


def test_zscore_waits_and_is_flat_on_constants(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 1.0, 1.0, 4.0])], "i int, x double")
    z = [r.z for r in df.withColumn("z", features.zscore(F.col("x"), Window.orderBy("i"), 3)).orderBy("i").collect()]
    assert z[:2] == [None, None] and z[2] == 0.0 and z[3] == pytest.approx(math.sqrt(2))


def test_session_targets_stop_at_an_incomplete_session(spark):
    sessions = spark.createDataFrame([(D(2024, 1, d), float(d), d != 4) for d in range(1, 9)], "day date, close double, complete boolean")
    e = spark.createDataFrame([(1, D(2024, 1, 1), 1.0), (2, D(2024, 1, 4), 1.0)], "event_id int, anchor_day date, anchor_price double")
    got = {(r.event_id, r.horizon): r.status for r in events.session_targets(e, sessions, (1, 5, 20)).collect()}
    assert got == {(1, 1): "complete", (1, 5): "incomplete_market_path", (1, 20): "insufficient_future_sessions", (2, 1): "complete", (2, 5): "insufficient_future_sessions", (2, 20): "insufficient_future_sessions"}


def test_position_regimes(spark):
    history = spark.createDataFrame([(D(2024, 1, 1 + i), i, float(i)) for i in range(9)], "available_at date, obs_id int, share double")
    at = spark.createDataFrame([(1, D(2023, 12, 31)), (2, D(2024, 1, 6)), (3, D(2024, 1, 8))], "event_id int, at date")
    got = {r.event_id: (r.history, r.regime) for r in events.trailing_percentile(at, history, "share").collect()}
    assert got == {1: (None, "no_available_position"), 2: (6, "insufficient_position_history"), 3: (8, "long_crowded")}


def test_tests_by_hand(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (0, 0), (9, 9)], "k int, n int").select(columns.sign_test(F.col("k"), F.col("n")).alias("p"))
    assert [r.p for r in df.collect()] == pytest.approx([2 / 1024, 1, 1, 2 / 512])
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None)], "k int, p double")
    assert [r.q for r in inference.benjamini_hochberg(p, "p", ["k"]).orderBy("k").collect()] == [0.02, 0.04, None]
    x = spark.createDataFrame([(float(i) / 4,) for i in range(20)], "x double").select("x", columns.erfc(F.col("x")).alias("e")).collect()
    assert all(abs(r.e - math.erfc(r.x)) < 2e-7 for r in x)


def test_bootstrap_and_permutation(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(rng.normal(1, 1, 300))], "g string, i int, v double")
    r = inference.bootstrap_mean(rows, ["g"], ["i"], "v", 400).first()
    assert r.low < r.mean < r.high and r.high - r.low == pytest.approx(2 * 1.96 / math.sqrt(300), rel=0.25)
    assert inference.bootstrap_mean(rows.repartition(5), ["g"], ["i"], "v", 400).first() == r
    shuffled = inference.permuted(rows, ["g"], "i", ["v"], 3)
    sums = {x.rep: x.s for x in shuffled.groupBy("rep").agg(F.sum("v_permuted").alias("s")).collect()}
    assert len(sums) == 3 and max(sums.values()) - min(sums.values()) < 1e-9


def test_bootstrap_interval_takes_every_order(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    theirs = duck.sql(f"WITH {research.TARGETS} SELECT kind, count(*), avg(r) FROM tg WHERE status = 'complete' AND horizon = 20 GROUP BY kind").fetchall()
    mine = {r.kind: r for r in research.bootstrap_interval(spark, SF).collect()}
    assert {k: (r.n, round(r.mean, 8)) for k, r in mine.items()} == {k: (n, round(m, 8)) for k, n, m in theirs}
    assert all(r.low < r.mean < r.high for r in mine.values())


def test_resampling_gathers_no_group_and_has_the_replicates(spark, monkeypatch):
    rows = spark.createDataFrame([("a", i, float(i % 7), float(i % 5)) for i in range(90)], "g string, i int, v double, w double")
    for df in (inference.bootstrap_mean(rows, ["g"], ["i"], "v", 50), inference.block_bootstrap_p(rows, ["g"], "i", "v", "w", 50)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(struct" not in plan and "posexplode" not in plan
    # a group of one row, equal values, and one null
    few = spark.createDataFrame([("one", 1, 3.0), ("flat", 1, 0.0), ("flat", 2, 0.0), ("flat", 3, None)], "g string, i int, v double")
    assert {r.g: (r.n, r.mean, r.low, r.high) for r in inference.bootstrap_mean(few, ["g"], ["i"], "v", 50).collect()} == {"one": (1, 3.0, 3.0, 3.0), "flat": (2, 0.0, 0.0, 0.0)}
    asked = {}
    for name, at in (("bootstrap_mean", 4), ("block_bootstrap_p", 5), ("permuted", 4)):
        f = getattr(inference, name)
        monkeypatch.setattr(inference, name, lambda *a, f=f, name=name, at=at: asked.update({name: a[at]}) or f(*a))
    for q in (research.bootstrap_interval, research.block_bootstrap, research.permutation_importance):
        q(spark, SF)
    assert asked == {"bootstrap_mean": 1000, "block_bootstrap_p": 1000, "permuted": 200}


def test_block_bootstrap_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=70)
    y = 0.2 * x + rng.normal(size=70)
    rows = spark.createDataFrame([("a", i, float(x[i]), float(y[i])) for i in range(70)], "g string, i int, x double, y double")
    got = inference.block_bootstrap_p(rows.repartition(3), ["g"], "i", "x", "y", 60, 8).first()
    starts = {(r.rep, r.b): r.h % 70 for r in spark.range(60).selectExpr("int(id) AS rep", "explode(sequence(0L, 8L)) AS b").selectExpr("rep", "b", "xxhash64(7, rep, b) AS h").collect()}
    r = np.corrcoef(x, y)[0, 1]
    slope, intercept = np.polyfit(x, y, 1)
    left = y - intercept - slope * x
    over = sum(abs(np.corrcoef(x, [left[(starts[k, i // 8] + i % 8) % 70] for i in range(70)])[0, 1]) >= abs(r) for k in range(60))
    assert got.n == 70 and got.r == pytest.approx(r) and got.p == pytest.approx((over + 1) / 61)
    few = inference.block_bootstrap_p(rows.where("i < 29"), ["g"], "i", "x", "y", 20, 8).first()
    assert few.n == 29 and few.r is not None and few.p is None


def test_ridge_walk_forward_against_plain_loops(spark):
    """Every year of the query from the rows themselves: standardise, solve, choose the penalty, score."""
    rows = research._folds(spark, LARGER).select("year", "role", *research.FEATURES, "y").dropna().toPandas()
    got = {r.year: r for r in research.ridge_walk_forward(spark, LARGER).where("variant = 'full'").collect()}

    def fit(part, penalty):
        x, y = part[research.FEATURES].to_numpy(), part["y"].to_numpy()
        scale = np.where(x.var(0) <= 1e-18, 1.0, x.std(0))
        z = (x - x.mean(0)) / scale
        w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
        return lambda other: y.mean() + (other[research.FEATURES].to_numpy() - x.mean(0)) @ w

    def error(part, predict):
        return float(np.mean((part["y"].to_numpy() - predict(part)) ** 2))

    expected = {}
    for year, own in rows.groupby("year"):
        part = {r: own[own.role == r] for r in ("train", "validation", "fit", "test")}
        if len(part["fit"]) >= research.SMALL[0] and len(part["validation"]) >= research.SMALL[1] and len(part["test"]) >= research.SMALL[2]:
            best = min(research.PENALTIES, key=lambda p: error(part["validation"], fit(part["train"], p)))
            expected[year] = error(part["test"], fit(part["fit"], best))
    assert got.keys() == expected.keys() and expected
    assert all(got[y].mse == pytest.approx(e, rel=1e-6) for y, e in expected.items())


def test_gram_models_equal_row_models(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 100, 3]
    y = x @ [0.5, -0.1, 4] + rng.normal(size=400)
    data = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    flat = linear.gram(data.withColumn("g", F.lit(1)), ["g"], ["a", "b", "c"], "y").first().gram
    m = linear.Moments(flat, 5)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 7 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    got = linear.ridge(m, [1, 2, 3], 7.0)
    assert got[1:] == pytest.approx(w) and got[0] == pytest.approx(y.mean() - w @ x.mean(0))
    assert linear.mse(linear.full_matrix(flat, 5), got) == pytest.approx(np.mean((y - got[0] - x @ got[1:]) ** 2))
    lasso = linear.elastic_net(m, [1, 2, 3], 0.3, 0.5)
    gradient = z.T @ (y - lasso[0] - x @ lasso[1:]) / 400 - 0.15 * lasso[1:] * x.std(0)
    assert all(abs(g - 0.15 * np.sign(c)) < 1e-6 if c else abs(g) <= 0.15 + 1e-6 for g, c in zip(gradient, lasso[1:], strict=True))
    v, share = linear.first_component(m, [1, 2, 3])
    assert v.sum() > 0 and 1 / 3 <= share <= 1
    with pytest.raises(ValueError):
        linear.leave_out(["a", "b"], {"one": ["a"]})


def test_purged_folds(spark):
    rows = spark.createDataFrame([(D(y, m, 15), D(y + (m == 12), m % 12 + 1, 20)) for y in range(2010, 2018) for m in range(1, 13)], "d date, e date")
    f = linear.folds(rows, "d", "e", 6)
    assert {r.year for r in f.select("year").distinct().collect()} == {2016, 2017}
    one = {r.role: (r.lo, r.hi) for r in f.where("year = 2016").groupBy("role").agg(F.min("d").alias("lo"), F.max("e").alias("hi")).collect()}
    assert one["train"][1] < D(2015, 1, 1) and one["validation"][0] >= D(2015, 1, 1) and one["validation"][1] < D(2016, 1, 1) and one["fit"][1] < D(2016, 1, 1) and one["test"] == (D(2016, 1, 15), D(2016, 12, 20))


def test_spectra_find_the_lead(spark):
    n = 512
    rows = spark.createDataFrame([(0, i, math.sin(2 * math.pi * i / 16), math.sin(2 * math.pi * (i - 4) / 16)) for i in range(n)], "s int, i int, f double, t double")
    best = spectral.welch(rows, ["s"], "f", "t", 128, 64).orderBy(F.desc("pf")).first()
    assert best.period == 16 and best.coherence == pytest.approx(1) and best.lead == pytest.approx(4, abs=0.05)
    noise = np.random.default_rng(4).normal(size=n)
    shifted = spark.createDataFrame([(0, i, float(noise[i]), float(noise[i - 4])) for i in range(4, n)], "s int, i int, f double, t double")
    assert spectral.best_lag(spectral.lag_correlations(shifted, ["s"], "f", "t", 8), ["s"]).first().lag == 4
    haar = spectral.haar_energy(rows, ["s"], "f", 6).collect()
    assert len(haar) == 6 and all(0 <= r.share <= 1 for r in haar)
    assert spectral.rolling_windows(10, 4, 3) == [(0, 4), (3, 7), (6, 10)] and spectral.rolling_windows(11, 4, 3)[-1] == (7, 11)


def test_guarded_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, 5.0), (3.0, 3.5, 5.0)], "a double, b double, c double")
    r = df.agg(columns.guarded_corr(F.col("a"), F.col("b")).alias("x"), columns.guarded_corr(F.col("a"), F.col("c")).alias("y")).first()
    assert r.x == pytest.approx(np.corrcoef([1, 2, 3], [1, 2, 3.5])[0, 1]) and r.y is None
    assert df.limit(2).agg(columns.guarded_corr(F.col("a"), F.col("b")).alias("x")).first().x is None


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e")], "source string, target string")
    assert {r.node for r in graph.cyclic_nodes(e, cut).collect()} == {"b", "c", "d"}
    assert graph.cyclic_nodes(e.where("target <> 'b'"), cut).count() == 0


def test_limits_and_assertions(spark):
    df = spark.range(5)
    assert quality.latest(df, ["id"], 2).count() == 2
    with pytest.raises(ValueError):
        quality.latest(df, ["id"], 0)
    with pytest.raises(ValueError):
        quality.assert_empty(df, "rows")


def test_streamed_memory(spark, tmp_path):
    spark.createDataFrame([(i, T(2024, 1, 1, i), 1, "a", x, None) for i, x in enumerate([0.0, 1.0, 1.0])], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "in"))
    out = []
    q = streaming.memory(streaming.tick_stream(spark, str(tmp_path / "in")), 1.0).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _: out.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_type, r.m, r.n) for r in out] == [("a", 0.75, 3)]


def test_graphml(spark, tmp_path):
    n = spark.createDataFrame([("a",), ("b<",)], "id string")
    e = spark.createDataFrame([("e", "a", "b<")], "id string, source string, target string")
    graph.write_graphml(n, e, str(tmp_path / "g.xml"))
    import xml.etree.ElementTree as ET

    found = list(ET.parse(tmp_path / "g.xml").getroot().iter())
    assert [x.attrib.get("id") for x in found if x.tag.endswith(("node", "edge"))] == ["a", "b<", "e"]
    with pytest.raises(ValueError):
        graph.write_graphml(n, e, str(tmp_path / "g.xml"), most=1)


def test_quarantine_and_interval_text(spark):
    rows = spark.createDataFrame([(T(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 1.0), (T(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 1.0), (T(2024, 1, 2), 1.0, 0.9, 0.5, 0.7, 1.0), (T(2024, 1, 3), -1.0, 2.0, -2.0, 1.0, -1.0), (T(2024, 1, 4), 1.0, 2.0, 0.5, 1.5, 0.0)], "bar_start timestamp_ntz, open double, high double, low double, close double, volume double")
    got = sorted((r.bar_start.day, r.reject) for r in bars.quarantine(rows).collect())
    assert got == [(1, "duplicate_timestamp"), (1, "duplicate_timestamp"), (2, "invalid_ohlc"), (3, "non_positive,negative_volume"), (4, "")]


def test_mixed_fractions_and_softmax(spark):
    df = spark.createDataFrame([("5-1/4",), ("1/2",), ("5.25",), ("x",)], "t string").select(columns.mixed_fraction(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [5.25, 0.5, 5.25, None]
    p = spark.createDataFrame([([1000.0, 1000.0, 999.0],)], "s array<double>").select(columns.softmax(F.col("s")).alias("p")).first().p
    assert sum(p) == pytest.approx(1) and p[0] == p[1] > p[2]
    text = spark.createDataFrame([("abcdefghij" * 30,)], "t string").select(columns.compact(F.col("t"), 100).alias("c")).first().c
    assert len(text) == 100 and "[...]" in text


def test_prediction_modes(spark):
    e = spark.createDataFrame([(1, T(2024, 1, 1, 13, 30), None), (2, T(2024, 1, 1, 13, 30), T(2024, 1, 1, 13, 31))], "id int, reference_at timestamp_ntz, available_at timestamp_ntz")
    got = sorted((r.id, r.prediction_mode, r.prediction_time) for r in temporal.prediction_modes(e).collect())
    assert got == [(1, "pre_event", T(2024, 1, 1, 13, 30)), (2, "post_release", T(2024, 1, 1, 13, 31)), (2, "pre_event", T(2024, 1, 1, 13, 30)), (2, "reaction_confirmed", T(2024, 1, 1, 14, 31))]


def test_as_of_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    grid = spark.createDataFrame([(int(k), int(t)) for k, t in zip(rng.integers(0, 5, 300), rng.integers(0, 100, 300), strict=True)], "k int, t int").distinct()
    rec = spark.createDataFrame([(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 5, 200), rng.integers(0, 100, 200), strict=True))], "k int, a int, v int")
    rows = rec.collect()
    seen = None
    for parts in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted((r.k, r.t, r.v if r.v is not None else -1) for r in temporal.as_of(grid, rec, "t", "a", ["v"], ["k"], order=["v"]).collect())
        assert seen in (None, got)
        seen = got
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen == sorted((g.k, g.t, max(((r.a, r.v) for r in rows if r.k == g.k and r.a <= g.t), default=(0, -1))[1]) for g in grid.collect())


def test_bucketed_as_of_equals_the_plain_one(spark):
    rng = np.random.default_rng(6)
    grid = spark.createDataFrame([(int(k), int(t)) for k, t in zip(rng.integers(0, 3, 200), rng.integers(0, 1000, 200), strict=True)], "k int, t int").distinct()
    rec = spark.createDataFrame([(int(k), int(t), i if i % 5 else None) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(100, 1000, 60), strict=True))], "k int, a int, v int").dropDuplicates(["k", "a"])
    for strict in (False, True):
        plain = temporal.as_of(grid, rec, "t", "a", ["v"], ["k"], strict=strict)
        dealt = temporal.as_of_bucketed(grid, rec, "t", "a", ["v"], lambda c: F.floor(c / 50), ["k"], strict=strict)
        assert dealt.columns == plain.columns
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


def test_checks_fail_closed(spark):
    rows = spark.createDataFrame([(1, "EUR", "UTC"), (2, "EUR", None)], "k int, unit string, zone string")
    peers = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no peer for"):
        audits.with_peer(rows, peers, ["k"], ["v"]).collect()
    assert [r.v for r in audits.with_peer(rows.where("k = 1"), peers, ["k"], ["v"]).collect()] == ["x"]
    assert audits.require_contract(rows, {"unit": "EUR"}).count() == 2
    with pytest.raises(ValueError, match="zone"):
        audits.require_contract(rows, {"unit": "EUR", "zone": "UTC"})
    same = audits.set_relation(rows, rows.unionByName(rows), ["k"]).first()
    assert (same.only_a, same.only_b, same.shared, same.is_equal, same.is_subset, same.is_disjoint) == (0, 0, 2, True, True, False)
    frames, status = audits.isolated(spark, {"good": lambda: rows, "empty": lambda: rows.limit(0), "gone": lambda: spark.read.parquet("/nowhere/at/all")})
    assert set(frames) == {"good"} and {(r.source, r.status, r.rows) for r in status.collect()} == {("good", "READY", 2), ("empty", "UNAVAILABLE", 0), ("gone", "UNAVAILABLE", 0)}


def test_chronological_windows_end_with_the_series(spark):
    numbered = spark.range(23).select(F.col("id").cast("int").alias("i"))
    found = {(r["mode"], r["first"], r["past"]): r["count"] for r in audits.chronological_windows(numbered, 10, 6, 8, 9).groupBy("mode", "first", "past").count().collect()}
    assert found == {("rolling", 0, 10): 10, ("rolling", 6, 16): 10, ("rolling", 12, 22): 10, ("rolling", 13, 23): 10, ("expanding", 0, 8): 8, ("expanding", 0, 17): 17, ("expanding", 0, 23): 23}
    assert audits.chronological_windows(numbered.limit(5), 10, 6, 8, 9).count() == 0


def test_archive_plan(spark):
    spans = spark.createDataFrame([(D(2004, 1, 1), D(2008, 5, 1)), (D(2008, 1, 1), D(2007, 1, 1)), (D(2001, 1, 1), D(2002, 1, 1))], "start date, end date")
    assert sorted(r.period for r in audits.archive_plan(spans, 2005, 2006).collect()) == ["2005-2006", "2007", "2008"]
