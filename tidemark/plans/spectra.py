"""Queries on spectra, lags and chronological windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import cut
from ..functions.columns import guarded_corr
from ..operators import features, spectral, temporal
from . import data
from .data import GRID
from .registry import query

CHANGES = GRID + """, ch AS (SELECT d, row_number() OVER w - 1 AS i0, ln(s0 / lag(s0) OVER w) AS f, ln(s1 / lag(s1) OVER w) AS t FROM grid WINDOW w AS (ORDER BY d)),
    c AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS i, f, t FROM ch WHERE f IS NOT NULL)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log changes f and t of two series of the common grid, numbered from 0; ``s`` is constant. One grid is one short series."""
    line = Window.partitionBy(F.lit(0)).orderBy("d")
    g = data.grid(spark, sf_dir).select("d", features.log_return(F.col("s0"), line, 1).alias("f"), features.log_return(F.col("s1"), line, 1).alias("t")).where("f is not null")
    return spectral.numbered(g.withColumn("s", F.lit(0)), ["s"], "d")


CORR = "CASE WHEN count(*) >= 3 AND var_pop({x}) > 1e-18 AND var_pop({y}) > 1e-18 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


@query(f"WITH {CHANGES}, b AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS bin) SELECT CAST(i // 128 AS INTEGER) AS w, bin, round(sum(f * cos(-2 * pi() * ((i * bin) % 128) / 128)), 6) AS re, round(sum(f * sin(-2 * pi() * ((i * bin) % 128) / 128)), 6) AS im FROM c, b GROUP BY 1, 2")
def fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes in stretches of 128; the last one is filled up with zeros."""
    stretches = changes(spark, sf_dir).withColumns({"w": F.expr("int(i div 128)"), "i": F.expr("int(i % 128)")})
    out = spectral.dft(stretches, ["s", "w"], "f", 128, list(range(64)))
    return out.select("w", "bin", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


WELCH = CHANGES + """, w AS (SELECT c.*, CAST(k AS INTEGER) AS w, CAST(i - k * 32 AS INTEGER) AS j FROM c, range(0, 1000) t(k) WHERE i >= k * 32 AND i < k * 32 + 64),
    m AS (SELECT *, count(*) OVER z AS n, f - avg(f) OVER z AS f0, t - avg(t) OVER z AS t0 FROM w WINDOW z AS (PARTITION BY w)),
    h AS (SELECT w, j, f0 * (0.5 - 0.5 * cos(2 * pi() * j / 63)) AS f1, t0 * (0.5 - 0.5 * cos(2 * pi() * j / 63)) AS t1 FROM m WHERE n = 64),
    b AS (SELECT CAST(unnest(range(1, 33)) AS INTEGER) AS bin),
    x AS (SELECT w, bin, sum(f1 * cos(-2 * pi() * ((j * bin) % 64) / 64)) AS re, sum(f1 * sin(-2 * pi() * ((j * bin) % 64) / 64)) AS im, sum(t1 * cos(-2 * pi() * ((j * bin) % 64) / 64)) AS re2, sum(t1 * sin(-2 * pi() * ((j * bin) % 64) / 64)) AS im2 FROM h, b GROUP BY w, bin),
    y AS (SELECT bin, avg(re * re + im * im) AS pf, avg(re2 * re2 + im2 * im2) AS pt, avg(re * re2 + im * im2) AS co, CASE WHEN bin = 32 THEN 0.0 ELSE avg(re * im2 - im * re2) END AS qu, count(*) AS windows FROM x GROUP BY bin),
    sp AS (SELECT bin, 64.0::DOUBLE / bin AS period, CASE WHEN pf * pt <= 1e-18 THEN 0.0 ELSE least(1.0, (co * co + qu * qu) / (pf * pt)) END AS coherence, atan2(qu, co) AS phase, windows FROM y)"""


@query(f"WITH {WELCH} SELECT bin, round(period, 6) AS period, round(coherence, 6) AS coherence, round(phase, 6) AS phase, round(-phase * 64 / (2 * pi() * bin) + 0.0, 6) AS lead, windows FROM sp")
def cross_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectral.welch(changes(spark, sf_dir), ["s"], "f", "t", 64, 32)
    return out.select("bin", *(F.round(c, 6).alias(c) for c in ("period", "coherence", "phase", "lead")), "windows")


BANDS = [("fast", 2.0, 5.0), ("week", 5.0, 10.0), ("month", 10.0, 25.0), ("quarter", 25.0, 64.0)]


@query(f"""WITH {WELCH} SELECT CASE WHEN period < 5 THEN 'fast' WHEN period < 10 THEN 'week' WHEN period < 25 THEN 'month' ELSE 'quarter' END AS band, round(avg(coherence), 6) AS coherence,
    round(arg_max(period, (round(coherence, 9), -bin)), 6) AS peak_period, count(*) AS bins FROM sp WHERE period BETWEEN 2 AND 64 GROUP BY 1""")
def band_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectral.bands(spectral.welch(changes(spark, sf_dir), ["s"], "f", "t", 64, 32), ["s"], BANDS)
    return out.select("band", F.round("coherence", 6).alias("coherence"), F.round("peak_period", 6).alias("peak_period"), "bins")


CHRONO = CHANGES + """, nn AS (SELECT CAST(count(*) AS INTEGER) AS n FROM c),
    re AS (SELECT DISTINCT least(e, n) AS e FROM (SELECT unnest(range(256, n + 64, 64)) AS e, n FROM nn WHERE n >= 256) WHERE e < n + 64), ee AS (SELECT DISTINCT least(e, n) AS e FROM (SELECT unnest(range(256, n + 128, 128)) AS e, n FROM nn WHERE n >= 256)),
    wn AS (SELECT 'rolling' AS mode, row_number() OVER (ORDER BY e) AS number, e - 256 AS start, e AS stop FROM re UNION ALL SELECT 'expanding', row_number() OVER (ORDER BY e), 0, e FROM ee)"""
WINDOW_BANDS = CHRONO + """, sg AS (SELECT mode, number, unnest(range(start, stop - 63, 32)) AS seg FROM wn), sd AS (SELECT DISTINCT seg FROM sg),
    sm AS (SELECT seg, i - seg AS j, f - avg(f) OVER z AS f0, t - avg(t) OVER z AS t0 FROM sd JOIN c ON i >= seg AND i < seg + 64 WINDOW z AS (PARTITION BY seg)), sh AS (SELECT seg, j, f0 * (0.5 - 0.5 * cos(2 * pi() * j / 63)) AS f1, t0 * (0.5 - 0.5 * cos(2 * pi() * j / 63)) AS t1 FROM sm),
    sb AS (SELECT CAST(unnest(range(1, 33)) AS INTEGER) AS bin), sx AS (SELECT seg, bin, sum(f1 * cos(-2 * pi() * ((j * bin) % 64) / 64)) AS re, sum(f1 * sin(-2 * pi() * ((j * bin) % 64) / 64)) AS im, sum(t1 * cos(-2 * pi() * ((j * bin) % 64) / 64)) AS re2, sum(t1 * sin(-2 * pi() * ((j * bin) % 64) / 64)) AS im2 FROM sh, sb GROUP BY 1, 2),
    sy AS (SELECT mode, number, bin, avg(re * re + im * im) AS pf, avg(re2 * re2 + im2 * im2) AS pt, avg(re * re2 + im * im2) AS co, CASE WHEN bin = 32 THEN 0.0 ELSE avg(re * im2 - im * re2) END AS qu, count(*) AS segments FROM sg JOIN sx USING (seg) GROUP BY mode, number, bin),
    sc AS (SELECT mode, number, bin, pf, 64.0::DOUBLE / bin AS period, CASE WHEN pf * pt <= 1e-18 THEN 0.0 ELSE least(1.0, (co * co + qu * qu) / (pf * pt)) END AS coherence, -atan2(qu, co) * 64 / (2 * pi() * bin) + 0.0 AS lead, segments FROM sy),
    bd AS (SELECT mode, number, CASE WHEN period < 5 THEN 'fast' WHEN period < 10 THEN 'week' WHEN period < 25 THEN 'month' ELSE 'quarter' END AS band, avg(coherence) AS mean_coherence, arg_max(coherence, (round(coherence, 9), -bin)) AS peak_coherence, arg_max(period, (round(coherence, 9), -bin)) AS peak_period,
        arg_max(lead, (round(coherence, 9), -bin)) AS lead, sum(pf) AS power, max(segments) AS segments FROM sc GROUP BY 1, 2, 3),
    wb AS (SELECT *, power / sum(power) OVER (PARTITION BY mode, number) AS power_share, list_position(['fast', 'week', 'month', 'quarter'], band) AS o, row_number() OVER (PARTITION BY mode, number ORDER BY round(mean_coherence, 9) DESC, list_position(['fast', 'week', 'month', 'quarter'], band)) = 1 AS leads FROM bd)"""


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = cut(changes(spark, sf_dir))
    return c, spectral.chronological_windows(c, ["s"], 256, 64, 256, 128)


def _window_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, windows = _windows(spark, sf_dir)
    return spectral.window_bands(spectral.window_spectra(c, ["s"], "f", "t", windows, 64, 32), ["s", "mode", "number"], BANDS)


@query(f"WITH {WINDOW_BANDS} SELECT mode, number, band, round(mean_coherence, 6) AS mean_coherence, round(peak_coherence, 6) AS peak_coherence, round(peak_period, 6) AS peak_period, round(lead, 5) AS lead, round(power_share, 6) AS power_share, segments, leads FROM wb")
def band_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of each band in each rolling and expanding window, and which band leads."""
    out = _window_bands(spark, sf_dir)
    return out.select("mode", "number", "band", *(F.round(c, 5 if c == "lead" else 6).alias(c) for c in ("mean_coherence", "peak_coherence", "peak_period", "lead", "power_share")), "segments", "leads")


@query(f"""WITH {WINDOW_BANDS}, su AS (SELECT mode, band, any_value(o) AS o, count(*) AS windows, quantile_cont(mean_coherence, 0.5) AS mc, quantile_cont(mean_coherence, 0.1) AS lc, quantile_cont(mean_coherence, 0.9) AS hc, avg(leads::INT) AS ts, quantile_cont(peak_period, 0.5) AS mp, quantile_cont(lead, 0.5) AS ml, avg((lead > 0)::INT) AS pl FROM wb GROUP BY 1, 2)
    SELECT mode, band, windows, round(mc, 6) AS median_coherence, round(lc, 6) AS low_coherence, round(hc, 6) AS high_coherence, round(ts, 6) AS top_share, round(mp, 6) AS median_period, round(ml, 5) AS median_lead, round(pl, 6) AS positive_lead, round(greatest(pl, 1 - pl), 6) AS sign_consistency,
    row_number() OVER (PARTITION BY mode ORDER BY ts DESC, round(mc, 9) DESC, o) = 1 AS leader FROM su""")
def band_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How steady the bands are over the windows, and the leading one."""
    out = spectral.band_summary(_window_bands(spark, sf_dir), ["s", "mode"], BANDS)
    numbers = ("median_coherence", "low_coherence", "high_coherence", "top_share", "median_period", "median_lead", "positive_lead", "sign_consistency")
    return out.select("mode", "band", "windows", *(F.round(c, 5 if c == "median_lead" else 6).alias(c) for c in numbers), "leader")


@query(f"""WITH {CHRONO}, wl AS (SELECT mode, number, CAST(g.k AS INTEGER) AS lag, {CORR.format(x='a.f', y='b.t')} AS r FROM wn JOIN c a ON a.i >= start AND a.i < stop, (VALUES (0), (1), (5), (20)) g(k), c b WHERE b.i = a.i + g.k AND b.i < stop GROUP BY 1, 2, 3)
    SELECT mode, lag, count(*) AS windows, round(quantile_cont(r, 0.5), 6) AS median_r, round(quantile_cont(r, 0.1), 6) AS low_r, round(quantile_cont(r, 0.9), 6) AS high_r, round(avg((r > 0)::INT), 6) AS positive, round(greatest(avg((r > 0)::INT), 1 - avg((r > 0)::INT)), 6) AS sign_consistency FROM wl WHERE r IS NOT NULL GROUP BY mode, lag""")
def registered_lag_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation at four fixed lags over the rolling and expanding windows: one pass over pairs of rows, each in the windows that hold both."""
    c, windows = _windows(spark, sf_dir)
    pairs = c.select("s", F.col("i").alias("a"), "f", F.explode(F.array(*map(F.lit, (0, 1, 5, 20)))).alias("lag")).withColumn("i", F.col("a") + F.col("lag")).join(c.select("s", "i", "t"), ["s", "i"])
    placed = windows.select("s", "mode", "number", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("a")).join(pairs, ["s", "a"]).where("i < end")
    out = spectral.lag_summary(placed.groupBy("s", "mode", "number", "lag").agg(guarded_corr(F.col("f"), F.col("t")).alias("r")), ["s", "mode"])
    return out.select("mode", "lag", "windows", *(F.round(c, 6).alias(c) for c in ("median_r", "low_r", "high_r", "positive", "sign_consistency")))


def _haar_sql(levels: int) -> str:
    parts = [CHANGES, "a0 AS (SELECT i, f AS a FROM c)"]
    for k in range(1, levels + 1):
        parts.append(f"p{k} AS (SELECT i // 2 AS i, max(a) FILTER (i % 2 = 0) AS p, max(a) FILTER (i % 2 = 1) AS q FROM a{k - 1} GROUP BY 1 HAVING max(a) FILTER (i % 2 = 1) IS NOT NULL)")
        parts.append(f"a{k} AS (SELECT i, (p + q) / sqrt(2) AS a FROM p{k})")
    energy = " UNION ALL ".join(f"SELECT {k} AS level, sum(((p - q) / sqrt(2)) ** 2) AS energy FROM p{k}" for k in range(1, levels + 1))
    return f"WITH {', '.join(parts)}, e AS ({energy} UNION ALL SELECT 0, sum(a * a) FROM a{levels}) SELECT level, round(energy, 6) AS energy, round(share, 6) AS share FROM (SELECT *, energy / sum(energy) OVER () AS share FROM e) WHERE level > 0 AND energy IS NOT NULL"


@query(_haar_sql(5))
def haar_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.haar_energy(changes(spark, sf_dir), ["s"], "f", 5).select("level", F.round("energy", 6).alias("energy"), F.round("share", 6).alias("share"))


LAGS = CHANGES + f", l AS (SELECT CAST(k AS INTEGER) AS lag, {CORR.format(x='a.f', y='b.t')} AS r, count(*) AS n FROM c a, range(-10, 11) z(k), c b WHERE b.i = a.i + k GROUP BY k)"


@query(f"WITH {LAGS} SELECT lag, round(r, 6) AS r, n FROM l")
def lag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.lag_correlations(changes(spark, sf_dir), ["s"], "f", "t", 10).select("lag", F.round("r", 6).alias("r"), "n")


@query(f"WITH {LAGS} SELECT lag, round(r, 6) AS r FROM l WHERE r IS NOT NULL ORDER BY abs(round(r, 12)) DESC, lag LIMIT 1")
def best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.best_lag(spectral.lag_correlations(changes(spark, sf_dir), ["s"], "f", "t", 10), ["s"]).select("lag", F.round("r", 6).alias("r"))


@query(f"WITH {CHANGES} SELECT CAST(k AS INTEGER) AS w, round({CORR.format(x='f', y='t')}, 6) AS r, count(*) AS n FROM c, range(0, 1000) t(k) WHERE i >= k * 64 AND i < k * 64 + 256 GROUP BY k HAVING count(*) = 256")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spectral.in_windows(changes(spark, sf_dir), 256, 64)
    return w.groupBy("w").agg(F.round(guarded_corr(F.col("f"), F.col("t")), 6).alias("r"), F.count("*").alias("n")).where("n = 256")


@query(f"""WITH {CHANGES}, h AS (SELECT CASE WHEN i >= floor(n / 2) THEN 1 ELSE 0 END AS half, n, f, t FROM (SELECT *, count(*) OVER () AS n FROM c)), r AS (SELECT n, half, {CORR.format(x='f', y='t')} AS r FROM h GROUP BY n, half)
    SELECT n, round(max(r) FILTER (half = 0), 6) AS r1, round(max(r) FILTER (half = 1), 6) AS r2, n >= 20 AND coalesce(max(r) FILTER (half = 0) * max(r) FILTER (half = 1) > 0, false) AS stable FROM r GROUP BY n""")
def sign_stable_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.sign_stable(changes(spark, sf_dir), ["s"], "f", "t").select("n", F.round("r1", 6).alias("r1"), F.round("r2", 6).alias("r2"), "stable")


@query(f"""WITH {LAGS}, q AS (SELECT abs(r) AS x FROM l WHERE r IS NOT NULL), o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS k, count(*) OVER () AS n FROM q)
    SELECT round((SELECT quantile_cont(x, 0.5) FROM q), 6) AS median_abs, round((SELECT quantile_cont(x, 0.9) FROM q), 6) AS linear_90, round(max(x) FILTER (k = floor(0.95 * (n - 1))), 6) AS floor_95, round(max(x) FILTER (k = least(floor(n * 0.95), n - 1)), 6) AS clipped_95 FROM o""")
def quantile_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lags = spectral.lag_correlations(changes(spark, sf_dir), ["s"], "f", "t", 10).where("r is not null")
    x = F.abs("r")
    out = lags.agg(F.percentile(x, F.lit(0.5)).alias("median_abs"), F.percentile(x, F.lit(0.9)).alias("linear_90"), F.sort_array(F.collect_list(x)).alias("o"))
    n = F.size("o")
    return out.select(F.round("median_abs", 6).alias("median_abs"), F.round("linear_90", 6).alias("linear_90"), F.round(F.get("o", F.floor(0.95 * (n - 1)).cast("int")), 6).alias("floor_95"), F.round(F.get("o", F.least(F.floor(n * 0.95), n - 1).cast("int")), 6).alias("clipped_95"))


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid rows with the last factor change that was out before each day's cutoff: levels come out at 09:00 Tokyo time of the next day, decisions fall at 07:00 in New York."""
    c = changes(spark, sf_dir)
    out_at = temporal.local_instant(F.col("d"), "09:00", "Asia/Tokyo", 1)
    cutoff = temporal.local_instant(F.col("d"), "07:00", "America/New_York")
    known = c.select("s", F.col("i").alias("source"), F.col("f").alias("known"), out_at.alias("out_at"))
    return temporal.as_of_bucketed(c.withColumn("cutoff", cutoff), known, "cutoff", "out_at", ["source", "known"], F.year, ["s"], strict=True, order=["source"])


TIMING = CHANGES + """, o AS (SELECT i AS source, f AS known, timezone('UTC', timezone('Asia/Tokyo', (d + 1)::TIMESTAMP + INTERVAL 9 HOUR)) AS out_at FROM c), g AS (SELECT *, timezone('UTC', timezone('America/New_York', d::TIMESTAMP + INTERVAL 7 HOUR)) AS cutoff FROM c),
    u AS (SELECT g.*, o.source, o.known FROM g ASOF LEFT JOIN o ON g.cutoff > o.out_at)"""


@query(f"WITH {TIMING} SELECT CAST(d AS VARCHAR) AS d, coalesce(source, -1) AS source, round(known, 8) AS known FROM u")
def latest_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usable(spark, sf_dir).select(F.col("d").cast("string").alias("d"), F.coalesce("source", F.lit(-1)).alias("source"), F.round("known", 8).alias("known"))


@query(f"""WITH {TIMING}, v AS (SELECT 'naive' AS method, lag(f) OVER (ORDER BY d) AS x, t AS y FROM c UNION ALL SELECT 'corrected', known, t FROM u), p AS (SELECT * FROM v WHERE x IS NOT NULL AND y IS NOT NULL)
    SELECT method, round({CORR.format(x='x', y='y')}, 6) AS r, count(*) AS n FROM p GROUP BY method""")
def timing_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _usable(spark, sf_dir)
    naive = u.select(F.lit("naive").alias("method"), F.lag("f").over(Window.partitionBy("s").orderBy("d")).alias("x"), F.col("t").alias("y"))
    both = naive.unionByName(u.select(F.lit("corrected").alias("method"), F.col("known").alias("x"), F.col("t").alias("y"))).dropna()
    return both.groupBy("method").agg(F.round(guarded_corr(F.col("x"), F.col("y")), 6).alias("r"), F.count("*").alias("n"))


@query(f"WITH {CHANGES} SELECT 250 AS shift, round({CORR.format(x='a.f', y='b.t')}, 6) AS r, count(*) AS n FROM c a JOIN c b ON a.i = b.i + 250")
def placebo_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor of 250 rows later against the target; the series is cut, not wrapped around."""
    c = changes(spark, sf_dir)
    pair = c.select((F.col("i") - 250).alias("i"), "f").join(c.select("i", "t"), "i")
    return pair.agg(F.round(guarded_corr(F.col("f"), F.col("t")), 6).alias("r"), F.count("*").alias("n")).select(F.lit(250).alias("shift"), "r", "n")


@query(f"""WITH {CHANGES}, w AS (SELECT CAST(k AS INTEGER) AS w, {CORR.format(x='f', y='t')} AS r FROM c, range(0, 1000) t(k) WHERE i >= k * 64 AND i < k * 64 + 256 GROUP BY k HAVING count(*) = 256)
    SELECT round(avg(r), 6) AS mean_r, round(avg(CASE WHEN sign(r) = (SELECT sign(avg(r)) FROM w) THEN 1.0 ELSE 0.0 END), 6) AS sign_share, CASE WHEN abs(avg(r)) >= 0.05 AND avg(CASE WHEN sign(r) = (SELECT sign(avg(r)) FROM w) THEN 1.0 ELSE 0.0 END) >= 0.75 THEN 'CONFIRMED' ELSE 'NOT_CONFIRMED' END AS verdict FROM w""")
def confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spectral.in_windows(changes(spark, sf_dir), 256, 64).groupBy("w").agg(guarded_corr(F.col("f"), F.col("t")).alias("r"), F.count("*").alias("n")).where("n = 256")
    out = w.agg(F.avg("r").alias("m"), F.count_if(F.signum("r") > 0).alias("up"), F.count_if(F.signum("r") < 0).alias("down"), F.count("*").alias("n"))
    share = F.when(F.col("m") > 0, F.col("up")).otherwise(F.col("down")) / F.nullif(F.col("n"), F.lit(0))
    return out.select(F.round("m", 6).alias("mean_r"), F.round(share, 6).alias("sign_share"), F.when((F.abs("m") >= 0.05) & (share >= 0.75), "CONFIRMED").otherwise("NOT_CONFIRMED").alias("verdict"))
