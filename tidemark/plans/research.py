"""Queries on event studies, tests, walk-forward models and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import cut
from ..functions.columns import guarded_corr, sign_test, softmax, tercile
from ..operators import events, features, heads, inference, linear
from . import data
from .data import DAILY, GRID
from .registry import query, table

# ---- event studies: orders as events, the daily mean price as the market

SESSIONS = DAILY + ", sessions AS (SELECT d AS day, v AS close, n % 17 <> 0 AS complete, row_number() OVER (ORDER BY d) AS i, sum(CASE WHEN n % 17 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY d) AS broken FROM daily)"
ANCHORS = SESSIONS + ", ev AS (SELECT o_orderkey AS event_id, o_orderpriority AS kind, CAST(o_orderdate AS DATE) AS anchor_day, o_totalprice AS anchor_price FROM orders)"
TARGETS = ANCHORS + """, tg AS (SELECT ev.event_id, ev.kind, ev.anchor_day, h AS horizon, CASE WHEN b.day IS NULL THEN 'insufficient_future_sessions' WHEN b.broken <> a.broken THEN 'incomplete_market_path' ELSE 'complete' END AS status, b.day AS day, ln(b.close / ev.anchor_price) AS r
    FROM ev JOIN sessions a ON a.day = ev.anchor_day, (VALUES (1), (5), (20)) z(h) LEFT JOIN sessions b ON b.i = a.i + h)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.daily(spark, sf_dir).select(F.col("d").alias("day"), F.col("v").alias("close"), (F.col("n") % 17 != 0).alias("complete"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an event."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").cast("date").alias("anchor_day"), F.col("o_totalprice").alias("anchor_price"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return events.session_targets(e, _sessions(spark, sf_dir), (1, 5, 20)).join(e.select("event_id", "kind", "anchor_day"), "event_id")


@query(f"WITH {TARGETS} SELECT event_id, CAST(horizon AS INTEGER) AS horizon, status, CASE WHEN status = 'complete' THEN CAST(day AS VARCHAR) END AS end_day, CASE WHEN status = 'complete' THEN round(r, 8) END AS log_ret FROM tg")
def event_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).select("event_id", "horizon", "status", F.col("end_day").cast("string").alias("end_day"), F.round("log_ret", 8).alias("log_ret"))


OVERLAP = TARGETS + ", c AS (SELECT * FROM tg WHERE status = 'complete'), ov AS (SELECT *, coalesce(anchor_day < max(day) OVER (PARTITION BY kind, horizon ORDER BY anchor_day, day, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_overlap FROM c)"


def _with_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.overlapping(_targets(spark, sf_dir).where("status = 'complete'"), ["kind", "horizon"], "anchor_day", "end_day", ["event_id"])


@query(f"""WITH {OVERLAP} SELECT kind, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, round(avg(r), 8) AS mean, round(quantile_cont(r, 0.5), 8) AS median, round(stddev_samp(r), 8) AS sd, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 8) AS positive_share, round(avg(abs(r)), 8) AS mae_zero,
    round(sqrt(avg(r * r)), 8) AS rmse_zero, count(*) FILTER (WHERE is_overlap) AS n_overlapping, CASE WHEN count(*) < 8 THEN 'insufficient' ELSE 'diagnostic' END AS status FROM ov GROUP BY kind, horizon""")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.summary(_with_overlap(spark, sf_dir), ["kind", "horizon"], "log_ret")
    return out.select("kind", "horizon", "n", *(F.round(c, 8).alias(c) for c in ("mean", "median", "sd", "positive_share", "mae_zero", "rmse_zero")), "n_overlapping", "status")


@query(f"""WITH {OVERLAP}, m AS (SELECT *, CASE WHEN anchor_day < DATE '1998-01-01' THEN 'below' ELSE 'above' END AS regime FROM ov) SELECT kind, regime, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, round(avg(r), 8) AS mean, round(quantile_cont(r, 0.5), 8) AS median, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 8) AS positive_share,
    count(*) FILTER (WHERE is_overlap) AS n_overlapping FROM m GROUP BY ALL""")
def regime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_overlap(spark, sf_dir).withColumn("regime", F.when(F.col("anchor_day") < F.lit("1998-01-01").cast("date"), "below").otherwise("above"))
    return events.summary(rows, ["kind", "regime", "horizon"], "log_ret").select("kind", "regime", "horizon", "n", *(F.round(c, 8).alias(c) for c in ("mean", "median", "positive_share")), "n_overlapping")


HISTORY = DAILY + """, hist AS (SELECT d AS available_at, CAST(row_number() OVER (ORDER BY d) AS BIGINT) AS obs_id, v AS share FROM daily),
    e AS (SELECT d AS at, CAST(row_number() OVER (ORDER BY d) AS BIGINT) AS event_id FROM daily),
    k AS (SELECT a.obs_id, a.available_at, count(*) AS history, (count(*) FILTER (b.share < a.share) + 0.5 * count(*) FILTER (b.share = a.share)) / count(*) AS percentile FROM hist a JOIN hist b ON b.obs_id <= a.obs_id AND b.obs_id > a.obs_id - 52 GROUP BY 1, 2)"""


@query(f"""WITH {HISTORY} SELECT CAST(e.at AS VARCHAR) AS at, round(k.percentile, 8) AS percentile, CASE WHEN k.history IS NULL THEN 'no_available_position' WHEN k.history < 8 THEN 'insufficient_position_history' WHEN k.percentile <= 1.0::DOUBLE / 3 THEN 'short_crowded' WHEN k.percentile >= 2.0::DOUBLE / 3 THEN 'long_crowded' ELSE 'neutral' END AS regime
    FROM e ASOF LEFT JOIN k ON e.at >= k.available_at""")
def position_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = data.daily(spark, sf_dir)
    number = F.row_number().over(Window.orderBy("d")).cast("long")
    history = d.select(F.col("d").alias("available_at"), number.alias("obs_id"), F.col("v").alias("share"))
    e = d.select(F.col("d").alias("at"), number.alias("event_id"))
    return events.trailing_percentile(e, history, "share").select(F.col("at").cast("string").alias("at"), F.round("percentile", 8).alias("percentile"), "regime")


@query(f"""WITH {DAILY}, b AS (SELECT d, v / lag(v, 20) OVER (ORDER BY d) - 1 AS trend FROM daily WHERE n % 17 <> 0), e AS (SELECT d AS at FROM daily)
    SELECT CAST(e.at AS VARCHAR) AS at, round(trend, 8) AS trend, CASE WHEN trend IS NULL THEN 'insufficient' WHEN trend > 0 THEN 'up' ELSE 'down' END AS regime FROM e ASOF LEFT JOIN b ON e.at >= b.d""")
def trend_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.temporal import as_of_bucketed

    d = data.daily(spark, sf_dir)
    b = d.where("n % 17 <> 0").select("d", (F.col("v") / F.lag("v", 20).over(Window.orderBy("d")) - 1).alias("trend"))
    out = as_of_bucketed(d.select(F.col("d").alias("at")), b, "at", "d", ["trend"], F.year)
    return out.select(F.col("at").cast("string").alias("at"), F.round("trend", 8).alias("trend"), F.when(F.col("trend").isNull(), "insufficient").when(F.col("trend") > 0, "up").otherwise("down").alias("regime"))


# ---- tests

HAC = OVERLAP + """, x AS (SELECT kind, anchor_day, event_id, r - avg(r) OVER (PARTITION BY kind) AS e, r FROM ov WHERE horizon = 5), y AS (SELECT *, lag(e, 1) OVER w AS l1, lag(e, 2) OVER w AS l2, lag(e, 3) OVER w AS l3 FROM x WINDOW w AS (PARTITION BY kind ORDER BY anchor_day, event_id)),
    g AS (SELECT kind, count(*) AS n, avg(r) AS mean, (sum(e * e) + 2 * (0.75 * coalesce(sum(e * l1), 0) + 0.5 * coalesce(sum(e * l2), 0) + 0.25 * coalesce(sum(e * l3), 0))) / count(*) AS lr FROM y GROUP BY kind)"""


@query(f"WITH {HAC} SELECT kind, n, round(mean, 8) AS mean, round(CASE WHEN n > 4 AND lr > 0 THEN sqrt(lr / n) END, 8) AS se, round(mean / CASE WHEN n > 4 AND lr > 0 THEN sqrt(lr / n) END, 6) AS t FROM g")
def hac_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.hac_mean(_with_overlap(spark, sf_dir).where("horizon = 5"), ["kind"], ["anchor_day", "event_id"], "log_ret", 3)
    return out.select("kind", "n", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"), F.round("t", 6).alias("t"))


@query("""WITH p AS (SELECT l_suppkey % 25 AS k, CASE WHEN l_suppkey % 25 <> 3 THEN round(avg(l_discount) * 0.9, 8) END AS p FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, k) AS rk, count(p) OVER () AS m FROM p)
    SELECT CAST(k AS BIGINT) AS k, p, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 8) END AS q, CASE WHEN p IS NOT NULL THEN round(least(1.0, p * 25), 8) END AS bonferroni FROM r""")
def multiple_testing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("l_suppkey") % 25).cast("long").alias("k")
    p = table(spark, sf_dir, "lineitem").groupBy(k).agg(F.avg("l_discount").alias("m")).select("k", F.when(F.col("k") != 3, F.round(F.col("m") * 0.9, 8)).alias("p"))
    out = inference.benjamini_hochberg(p, "p", ["k"])
    return out.select("k", "p", F.round("q", 8).alias("q"), F.when(F.col("p").isNotNull(), F.round(inference.bonferroni(F.col("p"), 25), 8)).alias("bonferroni"))


@query("""WITH n AS (SELECT CAST(user_id % 40 AS BIGINT) AS g, count(*) FILTER (value > 30) AS k, count(*) AS n FROM events GROUP BY 1), t AS (SELECT *, unnest(range(0, least(k, n - k) + 1)) AS i FROM n)
    SELECT g, k, n, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE)))), 8) AS p FROM t GROUP BY g, k, n""")
def sign_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).cast("long").alias("g")).agg(F.count_if(F.col("value") > 30).alias("k"), F.count("*").alias("n"))
    return n.select("g", "k", "n", F.round(sign_test(F.col("k"), F.col("n")), 8).alias("p"))


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _targets(spark, sf_dir).where("status = 'complete' and horizon = 20")
    return inference.bootstrap_mean(rows, ["kind"], ["anchor_day", "event_id"], "log_ret", 1000)


@query()
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spectra import changes

    return inference.block_bootstrap_p(changes(spark, sf_dir), ["s"], "i", "f", "t", 1000)


# ---- walk-forward models on the common grid

FEATURES = ["f1", "f2", "f3", "f4"]
BLOCKS = {"front": ["f1", "f2"], "back": ["f3", "f4"]}
PENALTIES = (0.1, 1.0, 10.0, 100.0)
SMALL = (200, 40, 20)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and a five-row target of the common grid: d, f1..f4, y, y_end."""
    line = Window.partitionBy(F.lit(0)).orderBy("d")
    g = data.grid(spark, sf_dir)
    own = [features.zscore(F.col(f"s{i}"), line, 20).alias(f"f{i}") for i in range(1, 5)]
    return g.select("d", *own, F.log(F.lead("s0", 5).over(line) / F.col("s0")).alias("y"), F.lead("d", 5).over(line).alias("y_end")).dropna()


MATRIX = GRID + ", mx AS (SELECT d, " + ", ".join(f"CASE WHEN count(s{i}) OVER z < 20 THEN NULL WHEN var_pop(s{i}) OVER z <= 1e-18 THEN 0.0 ELSE (s{i} - avg(s{i}) OVER z) / sqrt(var_pop(s{i}) OVER z) END AS f{i}" for i in range(1, 5)) + ", ln(lead(s0, 5) OVER w / s0) AS y, lead(d, 5) OVER w AS y_end FROM grid WINDOW w AS (ORDER BY d), z AS (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), m AS (SELECT * FROM mx WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AND f4 IS NOT NULL AND y IS NOT NULL AND y_end IS NOT NULL)"
FOLDS = MATRIX + """, ys AS (SELECT CAST(unnest(range(min(year(d)) + 3, max(year(d)) + 1)) AS INTEGER) AS year FROM m),
    fo AS (SELECT m.*, ys.year, unnest(list_filter([CASE WHEN y_end < make_date(ys.year - 1, 1, 1) THEN 'train' END, CASE WHEN year(d) = ys.year - 1 AND y_end < make_date(ys.year, 1, 1) THEN 'validation' END, CASE WHEN y_end < make_date(ys.year, 1, 1) THEN 'fit' END, CASE WHEN year(d) = ys.year AND y_end <= make_date(ys.year, 12, 31) THEN 'test' END], lambda r: r IS NOT NULL)) AS role FROM m, ys)"""


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.folds(matrix(spark, sf_dir), "d", "y_end", 3)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.gram(_folds(spark, sf_dir).withColumn("target", F.lit("y")), ["target", "year", "role"], FEATURES, "y")


@query(f"WITH {FOLDS} SELECT year, role, count(*) AS n, CAST(min(d) AS VARCHAR) AS first, CAST(max(y_end) AS VARCHAR) AS last, round(avg(y), 8) AS mean FROM fo GROUP BY year, role")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir).groupBy("year", "role").agg(F.count("*").alias("n"), F.min("d").cast("string").alias("first"), F.max("y_end").cast("string").alias("last"), F.round(F.avg("y"), 8).alias("mean"))


@query(f"WITH {FOLDS} SELECT year, role, count(*) AS n, round(sum(f1 * f2), 5) AS f1_f2, round(sum(f3 * f3), 5) AS f3_f3, round(sum(f4 * y), 5) AS f4_y, round(sum(y * y), 6) AS y_y FROM fo GROUP BY year, role")
def gram_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some entries of the Gram matrices; the triangle goes row by row over 1, f1..f4, y."""
    g = _stats(spark, sf_dir)
    pick = {"f1_f2": 7, "f3_f3": 15, "f4_y": 19, "y_y": 20}
    return g.select("year", "role", "n", *(F.round(F.get("gram", F.lit(i)), 6 if name == "y_y" else 5).alias(name) for name, i in pick.items()))


@query(f"""WITH {FOLDS}, b AS (SELECT year, avg(y) FILTER (role = 'fit') AS mean, count(*) FILTER (role = 'fit') AS nf, count(*) FILTER (role = 'validation') AS nv, count(*) FILTER (role = 'test') AS nt FROM fo GROUP BY year)
    SELECT fo.year, count(*) AS n_test, round(avg((y - mean) ** 2), 10) AS mse_mean, round(avg(y * y), 10) AS mse_zero, round(avg(abs(y - mean)), 8) AS mae_mean, round(avg(CASE WHEN (y >= 0) = (mean >= 0) THEN 1.0 ELSE 0.0 END), 8) AS sign_accuracy FROM fo JOIN b ON b.year = fo.year WHERE role = 'test' AND nf >= 200 AND nv >= 40 AND nt >= 20 GROUP BY fo.year""")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical mean and zero against the test years of folds that are large enough."""
    rows = _folds(spark, sf_dir)
    fit = rows.groupBy("year").agg(F.avg(F.when(F.col("role") == "fit", F.col("y"))).alias("mean"), *(F.count_if(F.col("role") == r).alias(r) for r in ("fit", "validation", "test")))
    test = rows.where("role = 'test'").join(fit.where(f"fit >= {SMALL[0]} and validation >= {SMALL[1]} and test >= {SMALL[2]}"), "year")
    y, mean = F.col("y"), F.col("mean")
    return test.groupBy("year").agg(F.count("*").alias("n_test"), F.round(F.avg((y - mean) ** 2), 10).alias("mse_mean"), F.round(F.avg(y * y), 10).alias("mse_zero"), F.round(F.avg(F.abs(y - mean)), 8).alias("mae_mean"), F.round(F.avg(((y >= 0) == (mean >= 0)).cast("double")), 8).alias("sign_accuracy"))


@query()
def ridge_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.walk_forward(_stats(spark, sf_dir), FEATURES, PENALTIES, linear.leave_out(FEATURES, {c: [c] for c in FEATURES}), minimum=SMALL)


@query()
def block_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each block of features is worth: the rise of the error without it, its years, and the sign test with Bonferroni."""
    models = linear.walk_forward(_stats(spark, sf_dir), FEATURES, PENALTIES, linear.leave_out(FEATURES, BLOCKS), minimum=SMALL)
    full = models.where("variant = 'full'").select("target", "year", F.col("mse").alias("full_mse"))
    delta = models.where("variant <> 'full'").join(full, ["target", "year"]).withColumn("delta", F.col("mse") - F.col("full_mse"))
    out = delta.groupBy("target", "variant").agg(F.avg("delta").alias("delta"), F.count("*").alias("years"), F.count_if(F.col("delta") > 0).alias("better"))
    return out.withColumn("p", sign_test(F.col("better"), F.col("years"))).withColumn("p_family", inference.bonferroni(F.col("p"), len(BLOCKS)))


@query()
def block_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge forecasts from one principal component a block, with its explained share."""
    return linear.block_states(_stats(spark, sf_dir), FEATURES, BLOCKS, PENALTIES, minimum=SMALL)


@query()
def memory_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exponential memories of the features add to them: errors of both models by year."""
    m = matrix(spark, sf_dir).withColumn("s", F.lit(0))
    memories = ["m1", "m2"]
    for name, c in zip(memories, FEATURES[:2], strict=True):
        m = m.join(features.ema(m.select("s", "d", c), "s", "d", c, 10.0, name, F.year).select("d", name), "d")
    stats = linear.gram(linear.folds(m, "d", "y_end", 3).withColumn("target", F.lit("y")), ["target", "year", "role"], [*FEATURES, *memories], "y")
    out = linear.walk_forward(stats, [*FEATURES, *memories], PENALTIES, {"without_memory": FEATURES}, minimum=SMALL)
    return out.groupBy("variant").agg(F.avg("mse").alias("mse"), F.count("*").alias("years"), F.count_if(F.col("mse") < F.col("mse_mean")).alias("better_than_mean"))


@query()
def direction_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of down, flat and up for each test row: the forecast plus the validation year's residuals against terciles of the fit rows.

    The residuals are those of the model that the training rows gave under the chosen penalty, which has not seen the validation year.
    """
    folds = cut(_folds(spark, sf_dir))
    stats = linear.gram(folds.withColumn("target", F.lit("y")), ["target", "year", "role"], FEATURES, "y")
    models = cut(linear.walk_forward(stats, FEATURES, PENALTIES, minimum=SMALL, details=True))
    bounds = folds.where("role = 'fit'").groupBy("year").agg(F.percentile("y", F.lit(1.0 / 3)).alias("lo"), F.percentile("y", F.lit(2.0 / 3)).alias("hi"))
    selected = models.withColumn("coefficients", F.col("selection"))
    residuals = linear.predict(folds.where("role = 'validation'"), selected, FEATURES).groupBy("year").agg(F.collect_list(F.col("y") - F.col("prediction")).alias("residuals"))
    rows = linear.predict(folds.where("role = 'test'"), models, FEATURES).join(bounds, "year").join(residuals, "year")
    n = F.size("residuals")
    down = F.size(F.filter("residuals", lambda r: r + F.col("prediction") < F.col("lo"))) / n
    up = F.size(F.filter("residuals", lambda r: r + F.col("prediction") > F.col("hi"))) / n
    return rows.select("year", F.col("d").cast("string").alias("d"), down.alias("down"), (1 - down - up).alias("flat"), up.alias("up"), tercile(F.col("y"), F.col("lo"), F.col("hi")).alias("actual"))


@query()
def embedding_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A softmax head over embeddings with a chronological split by id: its temperature is chosen on the validation part."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label").cast("long") % 3).cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    low, high = e.agg(F.percentile_approx("vec_id", [0.6, 0.8])).first()[0] or (0, 0)
    e = e.withColumn("part", F.when(F.col("vec_id") <= low, "train").when(F.col("vec_id") <= high, "validation").otherwise("test"))
    model = LogisticRegression(regParam=0.1, maxIter=50, family="multinomial").fit(e.where("part = 'train'"))
    scored = model.transform(e.where("part <> 'train'")).select("part", "label", vector_to_array("rawPrediction").alias("s"))
    tried = scored.select("part", "label", "s", F.explode(F.array(*(F.lit(t) for t in (0.5, 1.0, 2.0, 4.0)))).alias("temperature"))
    top = F.array_max("s")
    powers = F.transform("s", lambda x: F.exp((x - top) / F.col("temperature")))
    own = F.get(powers, F.col("label").cast("int")) / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    split = F.col("part")
    right = (F.array_position("s", top) - 1 == F.col("label")).cast("double")
    each = tried.groupBy("temperature").agg(*(F.avg(F.when(split == p, -F.log(F.greatest(own, F.lit(1e-12))))).alias(f"{p}_log_loss") for p in ("validation", "test")), F.avg(F.when(split == "test", right)).alias("accuracy"))
    return each.orderBy("validation_log_loss", "temperature").limit(1)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in order of their ids: the first three fifths to learn from, the next to choose by, the last to test."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label").cast("long") % 3).cast("int").alias("label"), "embedding")
    bounds = e.agg(F.max("vec_id").alias("last")).withColumn("one", F.lit(1))
    place = F.col("vec_id") / (F.col("last") + 1)
    return e.withColumn("one", F.lit(1)).join(F.broadcast(bounds), "one").withColumn("part", F.when(place < 0.6, "train").when(place < 0.8, "validation").otherwise("test")).drop("one", "last")


def _width(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("embedding"))).first()[0] or 0


@query()
def ridge_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge head on the embeddings: penalty and temperature from the validation part, refit, probabilities for each test row."""
    rows = _parts(spark, sf_dir)
    width = _width(rows)
    head = heads.fit_head(rows, "embedding", "label", "part", 3, width)
    out = heads.predict_head(rows.where("part = 'test'"), "embedding", head, width)
    return out.select("vec_id", "label", "predicted", *(F.get("probabilities", F.lit(k)).alias(f"p{k}") for k in range(3)))


@query()
def ridge_head_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ridge head chose and how it does on the test part, beside always naming the most frequent class."""
    rows = _parts(spark, sf_dir)
    width = _width(rows)
    head = heads.fit_head(rows, "embedding", "label", "part", 3, width)
    report = heads.head_report(heads.predict_head(rows.where("part = 'test'"), "embedding", head, width), "label", 3)
    return report.select(F.lit(head.penalty).alias("penalty"), F.lit(head.temperature).alias("temperature"), F.lit(head.validation_loss).alias("validation_loss"), "*")


@query()
def elastic_net_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linear.walk_forward(_stats(spark, sf_dir), FEATURES, (0.0001, 0.001, 0.01), kind="elastic_net", l1_ratios=(0.1, 0.5, 0.9), minimum=SMALL)
    return out.withColumn("nonzero", F.size(F.filter(F.slice("coefficients", 2, len(FEATURES)), lambda c: F.abs(c) > 1e-12)))


@query()
def model_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled metrics of the ridge forecasts: every test row once, against the mean of errors by year."""
    models = linear.walk_forward(_stats(spark, sf_dir), FEATURES, PENALTIES, minimum=SMALL)
    rows = linear.predict(_folds(spark, sf_dir).where("role = 'test'"), models, FEATURES)
    y, p = F.col("y"), F.col("prediction")
    pooled = rows.groupBy("variant").agg(F.count("*").alias("n"), F.avg((y - p) ** 2).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), guarded_corr(y, p).alias("r"), F.avg(((y >= 0) == (p >= 0)).cast("double")).alias("sign_accuracy"))
    by_year = models.groupBy("variant").agg(F.avg("mse").alias("mean_year_mse"), F.avg(1 - F.col("mse") / F.col("mse_mean")).alias("mean_year_skill"), F.count_if(F.col("mse") < F.col("mse_mean")).alias("years_better"), F.count("*").alias("years"))
    return pooled.join(by_year, "variant")


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rise of the squared error when a feature is shuffled within its test year; the model is linear, so the new prediction is the old one plus c (z' - z)."""
    models = linear.walk_forward(_stats(spark, sf_dir), FEATURES, PENALTIES, minimum=SMALL)
    rows = linear.predict(_folds(spark, sf_dir).where("role = 'test'"), models, FEATURES)
    each = rows.select("year", "d", "y", "prediction", "coefficients", F.posexplode(F.array(*FEATURES)).alias("k", "z"))
    shuffled = inference.permuted(each, ["year", "k"], "d", ["z"], 200).select("year", "k", "d", "rep", "z_permuted")
    moved = each.join(shuffled, ["year", "k", "d"]).withColumn("p2", F.col("prediction") + F.get("coefficients", F.col("k") + 1) * (F.col("z_permuted") - F.col("z")))
    out = moved.groupBy("k").agg(F.avg((F.col("y") - F.col("p2")) ** 2 - (F.col("y") - F.col("prediction")) ** 2).alias("importance"), F.count("*").alias("rows"))
    return out.select(F.get(F.array(*map(F.lit, FEATURES)), F.col("k")).alias("feature"), "importance", "rows")


@query(f"WITH {MATRIX} SELECT 'f1*f2' AS term, count(*) AS n, round(avg(f1 * f2), 6) AS mean, round(corr(f1 * f2, y), 6) AS r FROM m HAVING count(*) > 2")
def interaction_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir).withColumn("x", F.col("f1") * F.col("f2"))
    return m.agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(guarded_corr(F.col("x"), F.col("y")), 6).alias("r")).where("n > 2").select(F.lit("f1*f2").alias("term"), "n", "mean", "r")


# ---- forecast tracks and their scores

TRACK = "tr AS (SELECT vec_id, CAST(label AS BIGINT) % 3 AS actual, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)"
SOFT = TRACK + ", ex AS (SELECT vec_id, actual, exp((a - greatest(a, b, c)) / 2) AS x, exp((b - greatest(a, b, c)) / 2) AS y, exp((c - greatest(a, b, c)) / 2) AS z FROM tr), pr AS (SELECT vec_id, actual, x / (x + y + z) AS p0, y / (x + y + z) AS p1, z / (x + y + z) AS p2 FROM ex)"


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(*(F.get("embedding", F.lit(i)).cast("double") for i in range(3)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label").cast("long") % 3).alias("actual"), scores.alias("scores"))
    return rows.select("vec_id", "actual", softmax(F.col("scores"), 2.0).alias("p"))


@query(f"WITH {SOFT} SELECT vec_id, round(p0, 8) AS p0, round(p1, 8) AS p1, round(p2, 8) AS p2 FROM pr")
def choice_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(spark, sf_dir).select("vec_id", *(F.round(F.get("p", F.lit(i)), 8).alias(f"p{i}") for i in range(3)))


@query(f"""WITH {SOFT} SELECT count(*) AS n, round(avg(-ln(greatest(CASE actual WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-12))), 8) AS log_loss, round(avg((p0 - CASE WHEN actual = 0 THEN 1 ELSE 0 END) ** 2 + (p1 - CASE WHEN actual = 1 THEN 1 ELSE 0 END) ** 2 + (p2 - CASE WHEN actual = 2 THEN 1 ELSE 0 END) ** 2), 8) AS brier,
    round(max(k)::DOUBLE / count(*), 8) AS majority_accuracy FROM (SELECT *, count(*) OVER (PARTITION BY actual) AS k FROM pr)""")
def probability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probabilities(spark, sf_dir)
    own = F.greatest(F.get("p", F.col("actual").cast("int")), F.lit(1e-12))
    brier = F.aggregate(F.transform("p", lambda x, i: (x - (i == F.col("actual")).cast("double")) ** 2), F.lit(0.0), lambda a, b: a + b)
    sums = p.groupBy("actual").agg(F.count("*").alias("k"), F.sum(-F.log(own)).alias("l"), F.sum(brier).alias("b"))
    return sums.agg(F.sum("k").alias("n"), F.round(F.sum("l") / F.sum("k"), 8).alias("log_loss"), F.round(F.sum("b") / F.sum("k"), 8).alias("brier"), F.round(F.max("k") / F.sum("k"), 8).alias("majority_accuracy"))


@query(f"""WITH {SOFT}, q AS (SELECT vec_id, 'up' AS direction FROM pr WHERE p0 > 0.34), r AS (SELECT vec_id, CASE WHEN p1 > p2 THEN 'up' ELSE 'down' END AS direction FROM pr WHERE vec_id % 3 <> 0), a AS (SELECT vec_id, CASE WHEN actual = 0 THEN 'up' ELSE 'down' END AS direction FROM pr)
    SELECT count(*) AS n, count(*) FILTER (q.direction = a.direction) AS first_right, count(*) FILTER (r.direction = a.direction) AS second_right, count(*) FILTER (q.direction = r.direction) AS agree FROM q JOIN r USING (vec_id) JOIN a USING (vec_id)""")
def track_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forecast tracks on the keys that both and the outcome have; no combined score."""
    p = _probabilities(spark, sf_dir)
    at = [F.get("p", F.lit(i)) for i in range(3)]
    one = p.where(at[0] > 0.34).select("vec_id", F.lit("up").alias("q"))
    two = p.where("vec_id % 3 <> 0").select("vec_id", F.when(at[1] > at[2], "up").otherwise("down").alias("r"))
    actual = p.select("vec_id", F.when(F.col("actual") == 0, "up").otherwise("down").alias("a"))
    return one.join(two, "vec_id").join(actual, "vec_id").agg(F.count("*").alias("n"), F.count_if(F.col("q") == F.col("a")).alias("first_right"), F.count_if(F.col("r") == F.col("a")).alias("second_right"), F.count_if(F.col("q") == F.col("r")).alias("agree"))


@query(f"""WITH {MATRIX}, b AS (SELECT quantile_cont(y, 1.0 / 3) AS lo, quantile_cont(y, 2.0 / 3) AS hi FROM m WHERE d < DATE '1999-01-01') SELECT CAST(d AS VARCHAR) AS d, CASE WHEN y < lo THEN 'down' WHEN y > hi THEN 'up' ELSE 'flat' END AS direction FROM m, b WHERE d >= DATE '1999-01-01'""")
def tercile_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of later targets by terciles of the earlier ones; the bounds are one row."""
    m = matrix(spark, sf_dir)
    split = F.lit("1999-01-01").cast("date")
    bounds = m.where(F.col("d") < split).agg(F.percentile("y", F.lit(1.0 / 3)).alias("lo"), F.percentile("y", F.lit(2.0 / 3)).alias("hi"))
    later = m.where(F.col("d") >= split).withColumn("one", F.lit(1)).join(F.broadcast(bounds.withColumn("one", F.lit(1))), "one")
    return later.select(F.col("d").cast("string").alias("d"), tercile(F.col("y"), F.col("lo"), F.col("hi")).alias("direction"))
