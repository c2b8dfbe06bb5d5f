"""The timing audit: whether an association of a factor with later changes survives once the factor counts only from its publication on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import cut
from ..functions.columns import guarded_corr
from ..operators import inference, spectral
from ..operators.temporal import as_of_bucketed, local_instant
from . import data
from .registry import query
from .spectra import CHANGES, CORR, changes

# Clock times in New York at which decisions fall, at which the factor comes out (the base case and others), and the decision times that those are tried at.
DECISIONS = ("07:00", "15:00", "16:30", "19:30", "21:00")
BASE, ELSEWHEN, TRIED = "18:50", ("16:30", "17:30", "18:50", "19:30", "21:00"), ("16:30", "19:30")


def _minutes(clock: str) -> int:
    hours, minutes = clock.split(":")
    return 60 * int(hours) + int(minutes)


#: The same as minutes after midnight, as the tables show them.
CUTOFFS, OTHERS, TRIED_AT = (tuple(map(_minutes, x)) for x in (DECISIONS, ELSEWHEN, TRIED))
PUBLISHED = _minutes(BASE)
LAGS, SCAN = (1, 2, 5, 20), tuple(range(-10, 11))
STRICT, EVENING = CUTOFFS[0], CUTOFFS[3:]
ALPHA, REPS, BLOCK, SHIFT = 0.05, 1000, 20, 20
SETTINGS = [*(("cutoff", c, PUBLISHED) for c in CUTOFFS), *(("sensitivity", c, p) for p in OTHERS for c in TRIED_AT)]


def _instant(day: Column, minutes: Column) -> Column:
    return F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0)))


SETTING = ["kind", "cutoff", "published"]


def usable(c: DataFrame) -> DataFrame:
    """For each setting and day: x, the factor that was out before the day's cutoff (strictly); the naive setting takes the day's own one. kind, cutoff, published, i, x."""
    settings = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(at).alias("cutoff"), F.lit(p).alias("published")) for k, at, p in SETTINGS)))
    grid = c.select("i", "d", settings.alias("_s")).select("i", "d", "_s.*").withColumn("at", _instant(F.col("d"), F.col("cutoff")))
    out = c.select("i", "d", "f", F.explode(F.array(*map(F.lit, sorted({p for _, _, p in SETTINGS})))).alias("published"))
    out = out.select(F.col("published"), F.col("i").alias("source"), F.col("f").alias("x"), _instant(F.col("d"), F.col("published")).alias("out_at"))
    known = as_of_bucketed(grid, out, "at", "out_at", ["x"], F.year, ["published"], strict=True, order=["source"])
    naive = c.select(F.lit("naive").alias("kind"), F.lit(0).alias("cutoff"), F.lit(0).alias("published"), "i", F.col("f").alias("x"))
    return known.select("kind", "cutoff", "published", "i", "x").unionByName(naive)


def pairs(u: DataFrame, c: DataFrame, lags: tuple[int, ...], keys: list[str] = SETTING) -> DataFrame:
    """x of a row and the target t of ``lag`` rows later; rows without either are left out."""
    ahead = u.where("x is not null").select(*keys, "i", "x", F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    return ahead.join(c.where("t is not null").select((F.col("i")).alias("j"), "t"), F.col("i") + F.col("lag") == F.col("j")).drop("j")


def lag_table(p: DataFrame, keys: list[str] = SETTING) -> DataFrame:
    """Correlation of each setting and lag, and whether both halves have its sign."""
    by = [*keys, "lag"]
    place = p.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("i")) - 1)
    r = p.groupBy(*by).agg(F.count("*").alias("n"), guarded_corr(F.col("x"), F.col("t")).alias("r"))
    return r.join(spectral.sign_stable(place, by, "x", "t").select(*by, "stable"), by)


KINDS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {c} AS cutoff, {p} AS published" for k, c, p in SETTINGS)
TIMED = CHANGES + f""", st AS ({KINDS}), o AS (SELECT published, f AS x, timezone('UTC', timezone('America/New_York', d::TIMESTAMP + to_minutes(published))) AS out_at FROM c, (SELECT DISTINCT published FROM st)),
    g AS (SELECT st.*, c.i, timezone('UTC', timezone('America/New_York', c.d::TIMESTAMP + to_minutes(cutoff))) AS at FROM c, st),
    u AS (SELECT g.kind, g.cutoff, g.published, g.i, o.x FROM g ASOF LEFT JOIN o ON g.published = o.published AND g.at > o.out_at UNION ALL SELECT 'naive', 0, 0, i, f FROM c),
    pr AS (SELECT u.*, z.lag, c.t FROM u, (SELECT unnest({{lags}}) AS lag) z, c WHERE c.i = u.i + z.lag AND u.x IS NOT NULL AND c.t IS NOT NULL)"""


@query(f"""WITH {TIMED.format(lags=list(LAGS))}, h AS (SELECT *, row_number() OVER (PARTITION BY kind, cutoff, published, lag ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY kind, cutoff, published, lag) AS n FROM pr),
    hr AS (SELECT kind, cutoff, published, lag, n, k >= n // 2 AS later, {CORR.format(x='x', y='t')} AS r FROM h GROUP BY kind, cutoff, published, lag, n, k >= n // 2), s AS (SELECT kind, cutoff, published, lag, n, n >= 20 AND coalesce(max(r) FILTER (later) * max(r) FILTER (NOT later) > 0, false) AS stable FROM hr GROUP BY kind, cutoff, published, lag, n),
    wr AS (SELECT kind, cutoff, published, lag, {CORR.format(x='x', y='t')} AS r FROM pr GROUP BY kind, cutoff, published, lag)
    SELECT kind, cutoff, published, CAST(lag AS INTEGER) AS lag, n, round(r, 6) AS r, stable FROM s JOIN wr USING (kind, cutoff, published, lag)""")
def timing_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered lags under the naive dating, five decision times, and other publication times."""
    c = cut(changes(spark, sf_dir))
    return lag_table(pairs(usable(c), c, LAGS)).select(*SETTING, "lag", "n", F.round("r", 6).alias("r"), "stable")


@query(f"WITH {TIMED.format(lags=list(SCAN))} SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, round({CORR.format(x='x', y='t')}, 6) AS r FROM pr WHERE kind = 'cutoff' AND cutoff = {STRICT} GROUP BY lag")
def timing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags of ten days both ways at the strict decision time; no verdict rests on them."""
    c = cut(changes(spark, sf_dir))
    strict = usable(c).where(f"kind = 'cutoff' and cutoff = {STRICT}")
    return pairs(strict, c, SCAN).groupBy("lag").agg(F.count("*").alias("n"), F.round(guarded_corr(F.col("x"), F.col("t")), 6).alias("r"))


def verdict(best: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One word for each group of ``by`` from the rows (kind, cutoff, stable, passes): robust if the strict decision time passes, is stable, and no placebo passes; timing_artifact if it does not
    pass but an evening one and the naive dating do; else not_reproducible."""
    any_of = lambda test: F.coalesce(F.bool_or(test & F.col("passes")), F.lit(False))
    at = lambda *cutoffs: (F.col("kind") == "cutoff") & F.col("cutoff").isin(*cutoffs)
    s = best.groupBy(*(by or [])).agg(any_of(at(STRICT)).alias("strict"), any_of(at(STRICT) & F.col("stable")).alias("held"), any_of(at(*EVENING)).alias("evening"), any_of(F.col("kind") == "naive").alias("naive"), any_of(F.col("kind") == "placebo").alias("placebo"))
    word = F.when(F.col("held") & ~F.col("placebo"), "robust").when(~F.col("strict") & F.col("evening") & F.col("naive"), "timing_artifact").otherwise("not_reproducible")
    return s.select(*(by or []), word.alias("verdict"), "strict", "evening", "naive", "placebo")


@query()
def timing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best registered lag of the naive dating and of each decision time with its residual-bootstrap p against 0.05 / 4, a placebo of the factor 20 rows later, and the verdict."""
    c = cut(changes(spark, sf_dir))
    p = cut(pairs(usable(c).where("kind <> 'sensitivity'"), c, LAGS))
    order = Window.partitionBy(*SETTING).orderBy(F.desc(F.round(F.abs("r"), 12)), "lag")
    best = cut(lag_table(p).where("r is not null").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k"))
    mine = p.join(F.broadcast(best.select(*SETTING, "lag")), [*SETTING, "lag"])
    shifted = c.select((F.col("i") - SHIFT).alias("i"), F.col("f").alias("x")).where("i >= 0")
    lag = best.where("kind = 'naive'").select("lag")
    placebo = shifted.withColumn("one", F.lit(1)).join(F.broadcast(lag.withColumn("one", F.lit(1))), "one").join(c.where("t is not null").select(F.col("i").alias("j"), "t"), F.col("i") + F.col("lag") == F.col("j"))
    tested = mine.unionByName(placebo.select(F.lit("placebo").alias("kind"), F.lit(0).alias("cutoff"), F.lit(0).alias("published"), "lag", "i", "x", "t"))
    out = inference.block_bootstrap_p(tested, [*SETTING, "lag"], "i", "x", "t", REPS, BLOCK)
    out = cut(out.join(best.select(*SETTING, "stable"), SETTING, "left").withColumn("passes", F.coalesce(F.col("p") < ALPHA / len(LAGS), F.lit(False))))
    one = verdict(out).select("verdict", F.lit(1).alias("_one"))
    return out.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


# ---- five candidates, each known once the last of its nodes is out

# Clock time, zone and days after its own day at which each series comes out, and the series that each candidate is made of.
NODES = {
    1: ("15:30", "America/New_York", 0), 2: ("18:50", "America/New_York", 0), 3: ("15:30", "America/New_York", 0), 4: ("18:50", "America/New_York", 0), 5: ("10:30", "America/New_York", 1), 6: ("10:30", "America/New_York", 1),
    7: ("15:15", "America/New_York", 0),
}
CANDIDATES = {"spread_front": (1, 2), "spread_back": (3, 4), "fuel": (5,), "oil": (6,), "risk": (7,)}
FACTOR_SETTING = ["factor", "kind", "cutoff"]


def _level(nodes: tuple[int, ...]) -> str:
    """A candidate's level: of one series itself, of two their ratio; changes are logarithmic."""
    return " / ".join(f"s{k}" for k in nodes)


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(factor, i, d, x, out_at) of all candidates and (i, d, t) of the target: changes on the common grid, numbered from 0."""
    line = Window.partitionBy(F.lit(0)).orderBy("d")
    change = lambda level: F.log(F.expr(level) / F.lag(F.expr(level)).over(line))
    g = data.grid(spark, sf_dir).select("d", change("s0").alias("t"), *(change(_level(nodes)).alias(name) for name, nodes in CANDIDATES.items()))
    g = cut(spectral.numbered(g.where("t is not null").withColumn("s", F.lit(0)), ["s"], "d"))
    out_at = {name: [local_instant(F.col("d"), *NODES[k]) for k in nodes] for name, nodes in CANDIDATES.items()}
    each = F.array(*(F.struct(F.lit(name).alias("factor"), F.col(name).alias("x"), (F.greatest(*at) if len(at) > 1 else at[0]).alias("out_at")) for name, at in out_at.items()))
    return g.select("i", "d", F.explode(each).alias("e")).select("e.factor", "i", "d", "e.x", "e.out_at"), g.select("i", "d", "t")


def usable_candidates(factors: DataFrame, target: DataFrame) -> DataFrame:
    """For each candidate, decision time and day the value that was out strictly before, and under the naive dating the day's own: factor, kind, cutoff, i, x."""
    times = F.explode(F.array(*(F.struct(F.lit(_minutes(c)).alias("cutoff"), local_instant(F.col("d"), c, "America/New_York").alias("at")) for c in DECISIONS)))
    grid = target.select("i", "d", times.alias("t")).select("i", "t.*", F.explode(F.array(*map(F.lit, CANDIDATES))).alias("factor"))
    known = as_of_bucketed(grid, factors.select("factor", F.col("i").alias("source"), "x", "out_at"), "at", "out_at", ["x"], F.year, ["factor"], strict=True, order=["source"])
    naive = factors.select("factor", F.lit("naive").alias("kind"), F.lit(0).alias("cutoff"), "i", "x")
    return known.select("factor", F.lit("cutoff").alias("kind"), "cutoff", "i", "x").unionByName(naive)


def _out_sql(nodes: tuple[int, ...]) -> str:
    each = [f"timezone('UTC', timezone('{zone}', (d + {days})::TIMESTAMP + to_minutes({_minutes(clock)})))" for clock, zone, days in (NODES[k] for k in nodes)]
    return f"greatest({', '.join(each)})"


FACTORS_SQL = data.GRID + ", ca AS (" + " UNION ALL ".join(f"SELECT '{name}' AS factor, d, ln(({_level(nodes)}) / lag({_level(nodes)}) OVER (ORDER BY d)) AS x, {_out_sql(nodes)} AS out_at FROM grid" for name, nodes in CANDIDATES.items()) + """),
    tr AS (SELECT d, t, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS i FROM (SELECT d, ln(s0 / lag(s0) OVER (ORDER BY d)) AS t FROM grid) WHERE t IS NOT NULL), fa AS (SELECT ca.factor, tr.i, ca.x, ca.out_at FROM ca JOIN tr USING (d))"""
AUDIT_SQL = FACTORS_SQL + f""", cu AS (SELECT unnest({list(CUTOFFS)}) AS cutoff), gr AS (SELECT factor, cutoff, i, timezone('UTC', timezone('America/New_York', d::TIMESTAMP + to_minutes(CAST(cutoff AS INTEGER)))) AS at FROM tr, cu, (SELECT DISTINCT factor FROM ca)),
    us AS (SELECT gr.factor, 'cutoff' AS kind, CAST(gr.cutoff AS INTEGER) AS cutoff, gr.i, fa.x FROM gr ASOF LEFT JOIN fa ON gr.factor = fa.factor AND gr.at > fa.out_at UNION ALL SELECT factor, 'naive', 0, i, x FROM fa),
    pr AS (SELECT us.*, z.lag, tr.t FROM us, (SELECT unnest({list(LAGS)}) AS lag) z, tr WHERE tr.i = us.i + z.lag AND us.x IS NOT NULL)"""


@query(f"""WITH {AUDIT_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY factor, kind, cutoff, lag ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY factor, kind, cutoff, lag) AS n FROM pr), hr AS (SELECT factor, kind, cutoff, lag, n, k >= n // 2 AS later, {CORR.format(x='x', y='t')} AS r FROM h GROUP BY factor, kind, cutoff, lag, n, k >= n // 2),
    s AS (SELECT factor, kind, cutoff, lag, n, n >= 20 AND coalesce(max(r) FILTER (later) * max(r) FILTER (NOT later) > 0, false) AS stable FROM hr GROUP BY factor, kind, cutoff, lag, n), wr AS (SELECT factor, kind, cutoff, lag, {CORR.format(x='x', y='t')} AS r FROM pr GROUP BY factor, kind, cutoff, lag)
    SELECT factor, kind, cutoff, CAST(lag AS INTEGER) AS lag, n, round(r, 6) AS r, stable FROM s JOIN wr USING (factor, kind, cutoff, lag)""")
def timing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five candidates, five decision times and the naive dating at four registered lags."""
    factors, target = candidates(spark, sf_dir)
    p = pairs(usable_candidates(factors, target), target, LAGS, FACTOR_SETTING)
    return lag_table(p, FACTOR_SETTING).select(*FACTOR_SETTING, "lag", "n", F.round("r", 6).alias("r"), "stable")


@query()
def timing_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each candidate: its best registered lag under each dating with the residual bootstrap's p against 0.05 / 4, and a placebo of the candidate 20 rows later."""
    factors, target = candidates(spark, sf_dir)
    p = cut(pairs(usable_candidates(factors, target), target, LAGS, FACTOR_SETTING))
    order = Window.partitionBy(*FACTOR_SETTING).orderBy(F.desc(F.round(F.abs("r"), 12)), "lag")
    best = cut(lag_table(p, FACTOR_SETTING).where("r is not null").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k"))
    mine = p.join(F.broadcast(best.select(*FACTOR_SETTING, "lag")), [*FACTOR_SETTING, "lag"])
    shifted = factors.select("factor", (F.col("i") - SHIFT).alias("i"), "x").where("i >= 0").join(F.broadcast(best.where("kind = 'naive'").select("factor", "lag")), "factor")
    placebo = shifted.join(target.select(F.col("i").alias("j"), "t"), F.col("i") + F.col("lag") == F.col("j"))
    tested = mine.unionByName(placebo.select("factor", F.lit("placebo").alias("kind"), F.lit(0).alias("cutoff"), "lag", "i", "x", "t"))
    out = inference.block_bootstrap_p(tested, [*FACTOR_SETTING, "lag"], "i", "x", "t", REPS, BLOCK)
    out = cut(out.join(best.select(*FACTOR_SETTING, "stable"), FACTOR_SETTING, "left").withColumn("passes", F.coalesce(F.col("p") < ALPHA / len(LAGS), F.lit(False))))
    return out.join(F.broadcast(verdict(out, ["factor"]).select("factor", "verdict")), "factor")
