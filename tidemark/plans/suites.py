"""Model suites: sixteen features in seven blocks and four horizons on one set of complete days, eight more features from weekly releases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import cut
from ..functions.columns import age_decay, guarded_corr, sign_test
from ..operators import boosting, features, inference, interactions, linear
from ..operators.temporal import as_of_bucketed
from ..sources import releases
from . import data
from .registry import query, table

HORIZONS = (1, 5, 20, 60)
BLOCKS = {
    "front": ["z1", "z2"], "back": ["z3", "z4"], "energy": ["a5", "a6"], "own": ["own"], "spreads": ["spread12", "spread34"], "shares": ["share5", "share6", "share7"],
    "returns": ["r1", "r2", "r4", "r7"],
}
BASE = [c for members in BLOCKS.values() for c in members]
FLOWS = [f"{g}_{kind}" for kind in ("z52", "change4") for g in ("dealer", "manager", "fund")][:5] + ["interest_change4"]
ENERGY = ["stocks_z52", "output_z52"]
WIDE = [*BASE, *FLOWS, *ENERGY]
KEYS = ["target", "year"]
RIDGE = (0.01, 0.1, 1.0, 10.0)
ALPHAS, RATIOS = (0.0001, 0.0003, 0.001, 0.003, 0.01, 0.03, 0.1), (0.25, 0.5, 0.75, 1.0)
SMALL = (200, 40, 20)
REPS = 1000


def base_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen features and the forward returns of s0: days on which all of them are known. Written once for all folds and models, one row a day."""
    line = Window.partitionBy(F.lit(0)).orderBy("d")
    g = data.grid(spark, sf_dir)
    s = {i: F.col(f"s{i}") for i in range(data.SERIES)}
    total = s[5] + s[6] + s[7] + s[1]
    own = {f"z{i}": features.zscore(s[i], line, 60) for i in (1, 2, 3, 4)}
    own |= {f"a{i}": features.asinh_change(s[i], line, 20) for i in (5, 6)}
    own |= {"own": features.log_return(s[0], line, 20), "spread12": features.zscore(s[1] - s[2], line, 60), "spread34": features.zscore(s[3] - s[4], line, 60)}
    own |= {f"share{i}": features.zscore(s[i] / total, line, 60) for i in (5, 6, 7)}
    own |= {f"r{i}": features.log_return(s[i], line, 20) for i in (1, 2, 4, 7)}
    targets = features.forward_targets(g.select("d", "s0", *(c.alias(name) for name, c in own.items())), "s0", "d", line, HORIZONS)
    return cut(targets.drop("s0", "target_start")).dropna()


def stacked(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each day and horizon: d, target, y, y_end and the features; all horizons share the same days."""
    each = F.explode(F.array(*(F.struct(F.lit(f"{h}d").alias("target"), F.col(f"target_return_{h}d").alias("y"), F.col(f"target_end_{h}d").alias("y_end")) for h in HORIZONS)))
    return matrix.select("d", *columns, each.alias("_t")).select("d", *columns, "_t.*")


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.folds(stacked(base_matrix(spark, sf_dir), BASE), "d", "y_end", 3)


def _ridge(folds: DataFrame, columns: list[str], variants: dict[str, list[str]]) -> DataFrame:
    return linear.walk_forward(linear.gram(folds, [*KEYS, "role"], columns, "y"), columns, RIDGE, variants, minimum=SMALL, stronger=True)


def competitors(folds: DataFrame, columns: list[str], variants: dict[str, list[str]]) -> DataFrame:
    """Models of each fold: ridge on all columns ('full') and on each variant's, the elastic net, the historical mean and zero."""
    stats = linear.gram(folds, [*KEYS, "role"], columns, "y")
    ridge = linear.walk_forward(stats, columns, RIDGE, {**variants, "mean": []}, minimum=SMALL, stronger=True)
    sparse = linear.walk_forward(stats, columns, ALPHAS, kind="elastic_net", l1_ratios=RATIOS, minimum=SMALL).withColumn("variant", F.lit("elastic_net"))
    zero = ridge.where("variant = 'mean'").withColumns({"variant": F.lit("zero"), "coefficients": F.transform("coefficients", lambda c: F.lit(0.0)), "mse": F.col("mse_zero")})
    return cut(ridge.unionByName(sparse).unionByName(zero))


def scores(folds: DataFrame, models: DataFrame, columns: list[str], against: str) -> DataFrame:
    """Metrics of each model over all test rows of a horizon, its skill over the historical mean, its improvement on ``against``, and in how many years it beat that."""
    test = linear.predict(folds.where("role = 'test'"), models, columns, KEYS)
    y, p = F.col("y"), F.col("prediction")
    pooled = test.groupBy("target", "variant").agg(F.count("*").alias("n"), F.avg((y - p) ** 2).alias("mse"), guarded_corr(y, p).alias("r"), F.avg(((y >= 0) == (p >= 0)).cast("double")).alias("sign_accuracy"))
    horizon = Window.partitionBy("target")
    of = lambda name: F.max(F.when(F.col("variant") == name, F.col("mse"))).over(horizon)
    pooled = pooled.withColumns({"skill": 1 - F.col("mse") / of("mean"), "improvement": 1 - F.col("mse") / of(against)})
    rival = models.where(F.col("variant") == against).select(*KEYS, F.col("mse").alias("_rival"))
    years = models.join(F.broadcast(rival), KEYS).groupBy("target", "variant").agg(F.count_if(F.col("mse") < F.col("_rival")).alias("years_better"), F.count("*").alias("years"))
    return pooled.join(years, ["target", "variant"])


@query()
def market_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five forecasts of four horizons: zero, historical mean, ridge on the own momentum, ridge on sixteen features, elastic net."""
    folds = _folds(spark, sf_dir)
    return scores(folds, competitors(folds, BASE, {"momentum": ["own"]}), BASE, "mean")


# ---- weekly releases: positions and energy

WEEKS = """wk AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 1 AS report_date, l_returnflag AS f, l_linestatus = 'O' AS o, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
    rp AS (SELECT report_date, sum(q) AS open_interest, """ + ", ".join(f"coalesce(sum(q) FILTER (f = '{f}' AND {'o' if side == 'long' else 'NOT o'}), 0) AS {f.lower()}_{side}" for f in "ANR" for side in ("long", "short")) + " FROM wk GROUP BY 1)"
GROUPS = {"dealer": "a", "manager": "n", "fund": "r"}


def weekly_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuesday reports: quantities by return flag are the groups, the line status tells long from short."""
    lines = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    sides = [F.coalesce(F.sum(F.when((F.col("l_returnflag") == f) & ((F.col("l_linestatus") == "O") == (side == "long")), q)), F.lit(0)).alias(f"{f.lower()}_{side}") for f in "ANR" for side in ("long", "short")]
    return lines.groupBy(F.date_add(F.date_trunc("week", "l_shipdate").cast("date"), 1).alias("report_date")).agg(F.sum(q).alias("open_interest"), *sides)


def weekly_positions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions; the schedule has the Friday of each report from 1998 on, so what came before has no known release."""
    reports = weekly_reports(spark, sf_dir)
    schedule = reports.where("report_date >= date'1998-01-01'").select(F.date_add("report_date", 3).alias("release"))
    return releases.positions(reports, schedule, GROUPS)


@query(f"""WITH {WEEKS}, p AS (SELECT report_date + 3 AS release FROM rp WHERE report_date >= DATE '1998-01-01'), s AS (SELECT rp.*, (SELECT min(release) FROM p WHERE release > report_date AND release <= report_date + 10) AS release FROM rp)
    SELECT CAST(report_date AS VARCHAR) AS report_date, CAST(open_interest AS BIGINT) AS open_interest, CAST(a_long - a_short AS BIGINT) AS dealer_net, round((a_long - a_short)::DOUBLE / open_interest, 8) AS dealer_net_share,
    round((n_long - n_short)::DOUBLE / open_interest, 8) AS manager_net_share, round((r_long - r_short)::DOUBLE / open_interest, 8) AS fund_net_share, CAST(timezone('UTC', timezone('America/New_York', release::TIMESTAMP + INTERVAL '15 hours 30 minutes')) AS VARCHAR) AS scheduled_at,
    CAST(timezone('UTC', timezone('America/New_York', (release + 1)::TIMESTAMP)) AS VARCHAR) AS available_at, CASE WHEN release IS NOT NULL THEN 'inferred_conservative' ELSE 'unknown' END AS time_quality FROM s""")
def weekly_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = weekly_positions_of(spark, sf_dir)
    shares = [F.round(f"{g}_net_share", 8).alias(f"{g}_net_share") for g in GROUPS]
    instants = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("scheduled_at", "available_at")]
    return p.select(F.col("report_date").cast("string").alias("report_date"), "open_interest", "dealer_net", *shares, *instants, "time_quality")


def flow_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six features of the positions from the day on which they may be used: the known one, else ten days after the report."""
    p = weekly_positions_of(spark, sf_dir).where("reject = ''")
    line = Window.partitionBy(F.lit(0)).orderBy("report_date")
    out = [features.zscore(F.col(f"{g}_net_share"), line, 52).alias(f"{g}_z52") for g in GROUPS]
    out += [(F.col(f"{g}_net_share") - F.lag(f"{g}_net_share", 4).over(line)).alias(f"{g}_change4") for g in ("dealer", "manager")]
    out.append(features.log_return(F.col("open_interest"), line, 4).alias("interest_change4"))
    return p.select("report_date", F.coalesce(F.to_date("available_at"), F.date_add("report_date", 10)).alias("out_at"), F.col("available_at").isNotNull().alias("known"), *out).dropna()


def energy_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly totals of two order priorities as stocks and output: z-scores of their changes over one and four weeks, out a week later."""
    week = F.date_trunc("week", "o_orderdate").cast("date").alias("w")
    sums = [F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))).alias(name) for name, p in (("stocks", "1-URGENT"), ("output", "5-LOW"))]
    line = Window.partitionBy(F.lit(0)).orderBy("w")
    w = table(spark, sf_dir, "orders").groupBy(week).agg(*sums).dropna()
    w = w.select("w", (F.col("stocks") - F.lag("stocks", 1).over(line)).alias("s"), (F.col("output") - F.lag("output", 4).over(line)).alias("o"))
    z = [F.when(F.count(c).over(line.rowsBetween(-51, 0)) == 52, features.zscore(F.col(c), line, 52)).alias(name) for c, name in (("s", "stocks_z52"), ("o", "output_z52"))]
    return w.select(F.date_add("w", 7).alias("out_at"), *z).dropna()


def wide_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base matrix with the last positions and energy figures that were out on each day; days before the first ones are left out."""
    m = base_matrix(spark, sf_dir)
    m = as_of_bucketed(m, flow_releases(spark, sf_dir), "d", "out_at", [*FLOWS, "known"], F.year, order=["report_date"]).withColumnRenamed("matched_at", "flow_out")
    m = as_of_bucketed(m, energy_releases(spark, sf_dir), "d", "out_at", ENERGY, F.year).withColumnRenamed("matched_at", "energy_out")
    return cut(m).where("flow_out is not null and energy_out is not null").withColumns({"flow_age": F.date_diff("d", "flow_out"), "energy_age": F.date_diff("d", "energy_out")})


@query()
def flow_energy_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether eight features of positions and energy improve on the sixteen: ridge on both sets, elastic net on all, mean and zero."""
    folds = linear.folds(stacked(wide_matrix(spark, sf_dir), WIDE), "d", "y_end", 3)
    return scores(folds, competitors(folds, WIDE, {"base": BASE}), WIDE, "base")


@query()
def flow_energy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year: the days of the joined matrix, those whose positions had a known release, and the ages of the figures."""
    m = wide_matrix(spark, sf_dir).groupBy(F.year("d").alias("year"))
    return m.agg(F.count("*").alias("days"), F.count_if("known").alias("known_release"), F.max("flow_age").alias("oldest_flow"), F.avg("flow_age").alias("mean_flow_age"), F.max("energy_age").alias("oldest_energy"))


# ---- blocks, single features, regimes


def _deltas(models: DataFrame) -> DataFrame:
    full = models.where("variant = 'full'").select(*KEYS, F.col("mse").alias("full_mse"))
    return models.where("variant <> 'full'").join(F.broadcast(full), KEYS).withColumn("delta", F.col("mse") - F.col("full_mse"))


@query()
def grouped_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of seven blocks is worth at each horizon: the rise of the yearly error without it with its interval, the years, the sign test and Bonferroni over the blocks."""
    models = cut(_ridge(_folds(spark, sf_dir), BASE, linear.leave_out(BASE, BLOCKS)))
    delta = _deltas(models)
    interval = inference.bootstrap_mean(delta, ["target", "variant"], ["year"], "delta", REPS)
    k = delta.groupBy("target", "variant").agg(F.count_if(F.col("delta") > 0).alias("in_favour"), F.count("*").alias("years"))
    out = interval.drop("n").join(k, ["target", "variant"]).withColumn("p", sign_test(F.col("in_favour"), F.col("years")))
    return out.withColumn("p_family", inference.bonferroni(F.col("p"), len(BLOCKS)))


@query()
def grouped_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rise of the squared error when a block's features are shuffled together within the test year, 200 times."""
    folds = _folds(spark, sf_dir)
    models = _ridge(folds, BASE, {})
    rows = linear.predict(folds.where("role = 'test'"), models, BASE, KEYS)
    share = {b: reduce(lambda x, y: x + y, (F.get("coefficients", F.lit(BASE.index(c) + 1)) * F.col(c) for c in members)) for b, members in BLOCKS.items()}
    rows = rows.select(*KEYS, "d", "y", "prediction", *(c.alias(b) for b, c in share.items()))
    shuffled = inference.permuted(rows, KEYS, "d", list(BLOCKS), 200).select(*KEYS, "d", *(f"{b}_permuted" for b in BLOCKS))
    moved = rows.join(shuffled, [*KEYS, "d"])
    rise = lambda b: (F.col("y") - F.col("prediction") - F.col(f"{b}_permuted") + F.col(b)) ** 2 - (F.col("y") - F.col("prediction")) ** 2
    sums = moved.groupBy("target").agg(F.count("*").alias("rows"), F.array(*(F.struct(F.lit(b).alias("block"), F.avg(rise(b)).alias("importance")) for b in BLOCKS)).alias("_b"))
    return sums.select("target", F.explode("_b").alias("_b"), "rows").select("target", "_b.*", "rows")


@query()
def state_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint model and one model a feature: errors by horizon, skill over the mean, years better than it, the sign test with Bonferroni over the features."""
    models = _ridge(_folds(spark, sf_dir), BASE, {f"only_{c}": [c] for c in BASE})
    n = F.sum("n_test")
    out = models.groupBy("target", "variant").agg(n.alias("n"), (F.sum(F.col("mse") * F.col("n_test")) / n).alias("mse"), (1 - F.sum(F.col("mse") * F.col("n_test")) / F.sum(F.col("mse_mean") * F.col("n_test"))).alias("skill"), F.count_if(F.col("mse") < F.col("mse_mean")).alias("years_better"), F.count("*").alias("years"))
    return out.withColumn("p", sign_test(F.col("years_better"), F.col("years"))).withColumn("p_family", inference.bonferroni(F.col("p"), len(BASE)))


@query()
def state_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint model and the mean on calm and on stressed test days: those up to and above the fit rows' median of one risk feature."""
    folds = _folds(spark, sf_dir)
    models = cut(_ridge(folds, BASE, {"mean": []}))
    median = folds.where("role = 'fit'").groupBy(*KEYS).agg(F.percentile("z3", F.lit(0.5)).alias("_median"))
    rows = linear.predict(folds.where("role = 'test'"), models, BASE, KEYS).join(F.broadcast(median), KEYS)
    regime = F.when(F.col("z3") > F.col("_median"), "stressed").otherwise("calm").alias("regime")
    y, p = F.col("y"), F.col("prediction")
    return rows.groupBy("target", regime).agg(F.count_if(F.col("variant") == "full").alias("n"), *(F.avg(F.when(F.col("variant") == v, (y - p) ** 2)).alias(f"{v}_mse") for v in ("full", "mean"))).withColumn("skill", 1 - F.col("full_mse") / F.col("mean_mse"))


@query()
def suite_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint model's yearly errors from Gram matrices against those over its predicted rows; a difference over 1e-9 ends the job."""
    folds = _folds(spark, sf_dir)
    models = cut(_ridge(folds, BASE, {}))
    rows = linear.predict(folds.where("role = 'test'"), models, BASE, KEYS)
    child = rows.groupBy(*KEYS).agg(F.avg((F.col("y") - F.col("prediction")) ** 2).alias("mse"))
    return linear.anchored(child, models, KEYS, "mse")


# ---- interactions, regimes with models of their own, memories

SIX = ["z1", "z3", "a5", "a6", "z2", "own"]
TERMS = {"energy_risk": ("a5", "z2"), "energy_rates": ("a5", "z1"), "risk_rates": ("z2", "z1"), "trend_risk": ("own", "z2"), "level_slope": ("z1", "z3")}
REGIMES: list[interactions.Regime] = [("risk", "z2", 0.0, "elevated", "calm"), ("rates", "z1", 0.0, "wide", "narrow")]
REGIME_ROWS = (100, 20, 10)


def _term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions.with_terms(_folds(spark, sf_dir), TERMS)
    return linear.gram(rows, [*KEYS, "role"], [*SIX, *(f"term__{t}" for t in TERMS)], "y")


@query()
def interaction_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six features at four horizons: what each of five products adds, all of them together, and what is lost without each feature."""
    models = cut(interactions.interaction_models(_term_stats(spark, sf_dir), SIX, TERMS, RIDGE, SMALL))
    return interactions.paired(models, len(SIX) + len(TERMS) + 1, REPS)


@query()
def marginal_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature alone against the target over the test years, beside which the interaction models are read."""
    stats = cut(_term_stats(spark, sf_dir))
    models = interactions.interaction_models(stats, SIX, TERMS, RIDGE, SMALL)
    return interactions.marginal_correlations(stats, models, SIX, len(SIX) + len(TERMS) + 2)


@query()
def regime_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six features fitted anew inside each level of two regimes."""
    folds = _folds(spark, sf_dir)
    return interactions.regime_summary(interactions.regime_models(folds, SIX, REGIMES, RIDGE, REGIME_ROWS), folds, SIX, REGIMES)


#: Sixteen observed features, seven of them from releases, which have an age.
OBSERVED = ["z1", "z2", "z3", "a5", "a6", "own", "spread12", "r1", "r4", *FLOWS[:5], *ENERGY]
#: Exponential memories of features, and released features that fade with their age: name, value, age, half-life in days.
MEMORIES = {f"memory_{c}": (c, 10.0) for c in SIX}
DECAYS = [(f"fade_{c}", c, "flow_age", 14.0) for c in FLOWS[:5]] + [(f"fade_{c}", c, "energy_age", 30.0) for c in ENERGY]
REMEMBERED = [*MEMORIES, *(d[0] for d in DECAYS)]


def memory_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide matrix with six memories, which run over all days of the base matrix, and seven fading features."""
    base = base_matrix(spark, sf_dir).withColumn("s", F.lit(0))
    m = wide_matrix(spark, sf_dir)
    for name, (c, half_life) in MEMORIES.items():
        m = m.join(features.ema(base.select("s", "d", c), "s", "d", c, half_life, name, F.year).select("d", name), "d")
    return cut(m.withColumns({name: F.col(c) * age_decay(F.col(age), half_life) for name, c, age, half_life in DECAYS}))


@query()
def memory_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What thirteen memory columns add to sixteen observed features at four horizons: both models' errors, the yearly improvement with its interval, the sign test with Bonferroni over the horizons."""
    folds = linear.folds(stacked(memory_matrix(spark, sf_dir), [*OBSERVED, *REMEMBERED]), "d", "y_end", 3)
    models = cut(linear.walk_forward(linear.gram(folds, [*KEYS, "role"], [*OBSERVED, *REMEMBERED], "y"), [*OBSERVED, *REMEMBERED], RIDGE, {"observed": OBSERVED}, minimum=SMALL))
    both = models.groupBy(*KEYS, "n_test", "mse_mean").agg(*(F.max(F.when(F.col("variant") == v, F.col("mse"))).alias(name) for v, name in (("observed", "observed_mse"), ("full", "memory_mse"))))
    both = both.withColumn("improvement", F.col("observed_mse") - F.col("memory_mse"))
    interval = inference.bootstrap_mean(both, ["target"], ["year"], "improvement", REPS).select("target", F.col("mean").alias("improvement"), "low", "high")
    pooled = lambda c: F.sum(F.col(c) * F.col("n_test")) / F.sum("n_test")
    out = both.groupBy("target").agg(F.count("*").alias("folds"), F.sum("n_test").alias("n"), *(pooled(c).alias(c) for c in ("observed_mse", "memory_mse", "mse_mean")), F.count_if(F.col("improvement") > 0).alias("in_favour")).join(interval, "target")
    p = sign_test(F.col("in_favour"), F.col("folds"))
    return out.withColumns({"observed_skill": 1 - F.col("observed_mse") / F.col("mse_mean"), "memory_skill": 1 - F.col("memory_mse") / F.col("mse_mean"), "p": p, "threshold": F.lit(0.05 / len(HORIZONS)), "significant": p < 0.05 / len(HORIZONS)})


# ---- trees


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees against the elastic net in every test year of four horizons: the setting chosen on the validation year, both errors, and by horizon the mean improvement with its interval and sign test."""
    folds = _folds(spark, sf_dir)
    trees = boosting.walk_forward(folds, BASE, "d", SMALL)
    mine = trees.groupBy(*KEYS, "rate", "leaves", "l2").agg(F.count("*").alias("n"), F.avg((F.col("y") - F.col("prediction")) ** 2).alias("mse"))
    net = linear.walk_forward(linear.gram(folds, [*KEYS, "role"], BASE, "y"), BASE, ALPHAS, kind="elastic_net", l1_ratios=RATIOS, minimum=SMALL)
    years = cut(mine.join(net.select(*KEYS, F.col("mse").alias("net_mse"), "mse_mean"), KEYS).withColumn("improvement", F.col("net_mse") - F.col("mse")))
    interval = inference.bootstrap_mean(years, ["target"], ["year"], "improvement", REPS).select("target", F.col("mean").alias("mean_improvement"), "low", "high")
    horizon = Window.partitionBy("target")
    better, folds_of = F.count_if(F.col("improvement") > 0).over(horizon), F.count("*").over(horizon)
    out = years.withColumns({"in_favour": better, "folds": folds_of}).join(interval, "target")
    p = sign_test(F.col("in_favour"), F.col("folds"))
    return out.withColumns({"p": p, "passed": p < 0.05 / len(HORIZONS)})
