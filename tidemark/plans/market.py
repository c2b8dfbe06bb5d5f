"""Queries on bars, sessions, point-in-time joins and grid features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import age_decay, from_zone
from ..operators import bars, features, quality, temporal
from . import data
from .data import DAILY, GRID, HOURLY, PANEL, RELEASES
from .registry import query, table

def line():
    return Window.partitionBy("s").orderBy("d")



def text(c: str):
    return F.col(c).cast("string").alias(c)


def rounded(*names: str, places: int = 6):
    return [F.round(c, places).alias(c) for c in names]


@query(f"WITH {HOURLY} SELECT CAST(bar_start AS VARCHAR) AS bar_start, open, high, low, close, ticks FROM hourly")
def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bars(data.ticks(spark, sf_dir), "hour").withColumn("bar_start", F.col("bar_start").cast("string"))


SESSION = "session AS (SELECT CAST(timezone('America/New_York', timezone('UTC', bar_start)) + INTERVAL 7 HOUR AS DATE) AS session_date, * FROM hourly)"


@query(f"""WITH {HOURLY}, {SESSION} SELECT CAST(session_date AS VARCHAR) AS session_date, arg_min(open, bar_start) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, bar_start) AS close, CAST(sum(ticks) AS BIGINT) AS ticks, count(*) AS hours_present, CAST(24 AS BIGINT) AS hours_expected, count(*) = 24 AS complete
    FROM session WHERE isodow(session_date) BETWEEN 1 AND 5 GROUP BY session_date""")
def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.session_bars(bars.bars(data.ticks(spark, sf_dir), "hour")).withColumn("session_date", F.col("session_date").cast("string"))


@query("""WITH q AS (SELECT event_id, ts, round(value, 2) AS bid, round(value + 0.02, 2) AS ask FROM events WHERE event_type = 'view')
    SELECT CAST(date_trunc('minute', ts)::TIMESTAMP AS VARCHAR) AS bar_start, arg_min(bid, (ts, event_id)) AS bid_open, max(bid) AS bid_high, min(bid) AS bid_low, arg_max(bid, (ts, event_id)) AS bid_close,
    arg_min(ask, (ts, event_id)) AS ask_open, max(ask) AS ask_high, min(ask) AS ask_low, arg_max(ask, (ts, event_id)) AS ask_close, count(*) AS ticks FROM q GROUP BY date_trunc('minute', ts)""")
def quote_minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("event_id").alias("tick_id"), "ts", F.round("value", 2).alias("bid"), F.round(F.col("value") + 0.02, 2).alias("ask"))
    return bars.quote_bars(quotes).withColumn("bar_start", F.col("bar_start").cast("string"))


@query("""SELECT user_id, event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS units,
    round(1.1::DOUBLE + CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) * 0.00001::DOUBLE, 8) AS price FROM events""")
def candle_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.round(F.col("value") * 100).cast("long").alias("delta"), F.lit(0.00001).alias("multiplier"), F.lit(1.1).alias("base"))
    return bars.decode_deltas(rows, "user_id").select("user_id", F.col("pos").alias("event_id"), "units", F.round("price", 8).alias("price"))


@query(f"""WITH {HOURLY}, b AS (SELECT bar_start, open, CASE WHEN hour(bar_start) = 3 THEN low ELSE high END AS high, CASE WHEN hour(bar_start) = 5 THEN high ELSE low END AS low, close, CASE WHEN ticks > 9 THEN -1.0 ELSE 1.0 END AS volume FROM hourly),
    u AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE hour(bar_start) = 7)
    SELECT CAST(bar_start AS VARCHAR) AS bar_start, concat_ws(',', CASE WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 'invalid_ohlc' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'non_positive' END,
    CASE WHEN volume < 0 THEN 'negative_volume' END, CASE WHEN count(*) OVER (PARTITION BY bar_start) > 1 THEN 'duplicate_timestamp' END) AS reject FROM u""")
def bar_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.bars(data.ticks(spark, sf_dir), "hour")
    hour = F.hour("bar_start")
    b = b.select("bar_start", "open", F.when(hour == 3, F.col("low")).otherwise(F.col("high")).alias("high"), F.when(hour == 5, F.col("high")).otherwise(F.col("low")).alias("low"), "close", F.when(F.col("ticks") > 9, -1.0).otherwise(1.0).alias("volume"))
    return bars.quarantine(b.unionByName(b.where(F.hour("bar_start") == 7))).select(text("bar_start"), "reject")


HOLIDAYS = [("2024-01-15 20:30:00", "2024-01-15 23:30:00"), ("2024-01-15 23:00:00", "2024-01-16 01:15:00"), ("2024-01-10 22:00:00", "2024-01-11 22:00:00")]


@query(f"""WITH {HOURLY}, days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-29', INTERVAL 1 DAY)) AS DATE) AS session_date),
    h AS (SELECT session_date, unnest(generate_series(timezone('UTC', timezone('America/New_York', (session_date - 1)::TIMESTAMP + INTERVAL 17 HOUR)), timezone('UTC', timezone('America/New_York', session_date::TIMESTAMP + INTERVAL 17 HOUR)) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour FROM days WHERE isodow(session_date) <= 5)
    SELECT CAST(session_date AS VARCHAR) AS session_date, CAST(hour AS VARCHAR) AS hour FROM h
    WHERE NOT (hour >= TIMESTAMP '2024-01-15 20:30:00' AND hour + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-16 01:15:00') AND NOT (hour >= TIMESTAMP '2024-01-10 22:00:00' AND hour + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-11 22:00:00')
    AND hour NOT IN (SELECT bar_start FROM hourly)""")
def missing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(28).select(F.date_add(F.lit("2024-01-02").cast("date"), F.col("id").cast("int")).alias("session_date"))
    holidays = spark.createDataFrame(HOLIDAYS, "from_ts string, till_ts string").select(*(F.col(c).cast("timestamp_ntz").alias(c) for c in ("from_ts", "till_ts")))
    return bars.missing_hours(bars.expected_hours(days, holidays), bars.bars(data.ticks(spark, sf_dir), "hour")).select(text("session_date"), text("hour"))


@query("""SELECT user_id, event_type, event_id, value FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' AND value > 1
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def pit_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("ts", "available_at")
    at = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return temporal.latest_known(rows, at, ["user_id", "event_type"], ["event_id"], strict=F.col("value") > 1).select("user_id", "event_type", "event_id", "value")


AS_OF_GRID = "g AS (SELECT d, s FROM daily, (VALUES (0), (1), (2), (3)) t(s))"


def _release_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.daily(spark, sf_dir).select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("s"))


@query(f"WITH {DAILY}, {RELEASES}, {AS_OF_GRID} SELECT CAST(g.d AS VARCHAR) AS d, CAST(g.s AS BIGINT) AS s, r.v AS v, CAST(coalesce(g.d - r.available, -1) AS BIGINT) AS age FROM g ASOF LEFT JOIN releases r ON g.s = r.s AND g.d >= r.available")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.as_of_bucketed(_release_grid(spark, sf_dir), data.releases(spark, sf_dir), "d", "available", ["v"], F.year, ["s"])
    return out.select(text("d"), "s", "v", F.coalesce(F.date_diff("d", "matched_at"), F.lit(-1)).cast("long").alias("age"))


@query(f"WITH {DAILY}, {RELEASES}, {AS_OF_GRID} SELECT CAST(g.d AS VARCHAR) AS d, CAST(g.s AS BIGINT) AS s, r.v AS v, CAST(r.available AS VARCHAR) AS matched_at FROM g ASOF LEFT JOIN releases r ON g.s = r.s AND g.d > r.available")
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.as_of_bucketed(_release_grid(spark, sf_dir), data.releases(spark, sf_dir), "d", "available", ["v"], F.year, ["s"], strict=True).select(text("d"), "s", "v", text("matched_at"))


@query(f"""WITH {DAILY}, {RELEASES}, {AS_OF_GRID} SELECT CAST(g.d AS VARCHAR) AS d, CAST(g.s AS BIGINT) AS s, r.v AS v, CAST(r.available AS VARCHAR) AS matched_at FROM g ASOF LEFT JOIN releases r ON g.s = r.s AND g.d <= r.available
    WHERE r.available - g.d <= 4""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.as_of_bucketed(_release_grid(spark, sf_dir), data.releases(spark, sf_dir), "d", "available", ["v"], F.year, ["s"], direction="forward")
    return out.where(F.date_diff("matched_at", "d") <= 4).select(text("d"), "s", "v", text("matched_at"))


@query(f"""WITH {DAILY}, w AS (SELECT CAST(l_suppkey % 4 AS BIGINT) AS s, CAST(l_shipdate AS DATE) + 7 AS available, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1, 2),
    {AS_OF_GRID} SELECT CAST(g.d AS VARCHAR) AS d, CAST(g.s AS BIGINT) AS s, w.q, w.disc FROM g ASOF LEFT JOIN w ON g.s = w.s AND g.d >= w.available""")
def asof_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    weekly = lines.groupBy((F.col("l_suppkey") % 4).cast("long").alias("s"), F.date_add(F.col("l_shipdate").cast("date"), 7).alias("available")).agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_discount"), 6).alias("disc"))
    return temporal.as_of_bucketed(_release_grid(spark, sf_dir), weekly, "d", "available", ["q", "disc"], F.year, ["s"]).select(text("d"), "s", "q", "disc")


@query(f"""WITH {HOURLY}, days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d)
    SELECT CAST(d AS VARCHAR) AS d, open, open IS NOT NULL AS matched FROM days LEFT JOIN hourly ON bar_start = timezone('UTC', timezone('Europe/Berlin', d::TIMESTAMP + INTERVAL 14 HOUR))""")
def reference_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(31).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    days = days.withColumn("bar_start", from_zone(F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 14 HOURS"), "Europe/Berlin"))
    return days.join(bars.bars(data.ticks(spark, sf_dir), "hour").select("bar_start", "open"), "bar_start", "left").select(text("d"), "open", F.col("open").isNotNull().alias("matched"))


@query("""WITH e AS (SELECT event_id, ts AS reference_at, CASE WHEN value > 20 THEN ts + INTERVAL 5 MINUTE END AS available_at FROM events WHERE event_type = 'click')
    SELECT event_id, 'pre_event' AS prediction_mode, epoch_us(reference_at) AS at FROM e WHERE reference_at IS NOT NULL UNION ALL SELECT event_id, 'post_release', epoch_us(available_at) FROM e WHERE available_at IS NOT NULL
    UNION ALL SELECT event_id, 'reaction_confirmed', epoch_us(available_at + INTERVAL 1 HOUR) FROM e WHERE available_at IS NOT NULL""")
def prediction_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.col("ts").alias("reference_at"), F.when(F.col("value") > 20, F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("available_at"))
    return temporal.prediction_modes(e).select("event_id", "prediction_mode", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', prediction_time)").alias("at"))


@query(f"""WITH {DAILY}, r AS (SELECT DISTINCT d AS release FROM daily WHERE day(d) IN (3, 17)) SELECT CAST(d AS VARCHAR) AS day, CAST(min(release) AS VARCHAR) AS release FROM daily LEFT JOIN r ON release > d AND release <= d + 10 GROUP BY d""")
def next_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = data.daily(spark, sf_dir).select(F.col("d").alias("day"))
    schedule = days.where(F.dayofmonth("day").isin(3, 17)).select(F.col("day").alias("release"))
    return temporal.next_scheduled(days, schedule).select(text("day"), text("release"))


@query(f"WITH {GRID} SELECT CAST(d AS VARCHAR) AS d, {', '.join(f's{i}' for i in range(8))}, round(s0 - s1, 2) AS spread, round((s0 - s1) / nullif(s2, 0), 8) AS share FROM grid")
def common_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = data.grid(spark, sf_dir)
    return g.select(text("d"), *(f"s{i}" for i in range(8)), F.round(F.col("s0") - F.col("s1"), 2).alias("spread"), F.round((F.col("s0") - F.col("s1")) / F.nullif("s2", F.lit(0.0)), 8).alias("share"))


@query(f"""WITH {GRID}, m AS (SELECT * FROM (VALUES ('s0', 'rates'), ('s1', 'rates'), ('s2', 'energy'), ('s3', 'energy'), ('s4', 'risk'), ('s5', 'risk'), ('s6', 'fx'), ('s7', 'fx')) t(node, block)),
    l AS (UNPIVOT grid ON s0, s1, s2, s3, s4, s5, s6, s7 INTO NAME node VALUE value) SELECT CAST(d AS VARCHAR) AS d, node, block, value FROM l JOIN m USING (node)""")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.createDataFrame([(f"s{i}", ("rates", "energy", "risk", "fx")[i // 2]) for i in range(8)], "node string, block string")
    melted = data.grid(spark, sf_dir).unpivot(["d"], [f"s{i}" for i in range(8)], "node", "value")
    return melted.join(F.broadcast(meta), "node").select(text("d"), "node", "block", "value")


@query(f"""WITH {PANEL}, a AS (SELECT s, min(d) AS first, max(d) AS last, count(*) AS n, count(*) FILTER (isodow(d) <= 5) AS weekdays_present FROM panel GROUP BY s),
    e AS (SELECT s, count(*) AS weekdays FROM (SELECT s, unnest(generate_series(first::TIMESTAMP, last::TIMESTAMP, INTERVAL 1 DAY)) AS x FROM a) WHERE isodow(x) <= 5 GROUP BY s)
    SELECT s, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, n, weekdays, weekdays - weekdays_present AS missing, CASE WHEN weekdays - weekdays_present = 0 THEN 'READY' ELSE 'PARTIAL' END AS status FROM a JOIN e USING (s)""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(data.panel(spark, sf_dir), "s", "d").select("s", text("first"), text("last"), "n", "weekdays", "missing", "status")


@query("SELECT user_id, CAST(ts::DATE AS VARCHAR) AS d, value FROM events WHERE isfinite(value) AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("d", F.col("ts").cast("date"))
    return quality.last_wins(quality.clip(rows, "d", "2024-01-05", "2024-01-20"), ["user_id", "d"], ["ts", "event_id"], "value").select("user_id", text("d"), "value")


@query(f"""WITH {PANEL}, w AS (SELECT s, d, v, avg(v) OVER z AS m, var_pop(v) OVER z AS q, count(v) OVER z AS c FROM panel WINDOW z AS (PARTITION BY s ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT s, CAST(d AS VARCHAR) AS d, round(CASE WHEN c < 60 THEN NULL WHEN q <= 1e-18 THEN 0.0 ELSE (v - m) / sqrt(q) END, 6) AS z FROM w""")
def rolling_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.panel(spark, sf_dir).withColumn("z", features.zscore(F.col("v"), line(), 60)).select("s", text("d"), *rounded("z"))


@query(f"""WITH {PANEL} SELECT s, CAST(d AS VARCHAR) AS d, round(ln(v / lag(v, 5) OVER w), 8) AS r5, round(ln(v / lag(v, 20) OVER w), 8) AS r20, round(asinh(v / 20.0) - asinh(lag(v, 5) OVER w / 20.0), 8) AS a5,
    round(v - lag(v) OVER w, 2) AS diff, round(ln(v / lag(v) OVER w), 8) AS log_diff, round(v / 1000 - lag(v / 1000) OVER w, 8) AS bp FROM panel WINDOW w AS (PARTITION BY s ORDER BY d)""")
def lag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    p = data.panel(spark, sf_dir)
    return p.select("s", text("d"), F.round(features.log_return(v, line(), 5), 8).alias("r5"), F.round(features.log_return(v, line(), 20), 8).alias("r20"), F.round(features.asinh_change(v, line(), 5), 8).alias("a5"), F.round(v - F.lag(v).over(line()), 2).alias("diff"), F.round(features.log_return(v, line(), 1), 8).alias("log_diff"), F.round(v / 1000 - F.lag(v / 1000).over(line()), 8).alias("bp"))


@query(f"""WITH {DAILY}, {RELEASES}, rr AS (SELECT s, available, round(ln(v / lag(v, 4) OVER (PARTITION BY s ORDER BY available)), 8) AS r FROM releases), {AS_OF_GRID}
    SELECT CAST(g.d AS VARCHAR) AS d, CAST(g.s AS BIGINT) AS s, rr.r FROM g ASOF LEFT JOIN rr ON g.s = rr.s AND g.d >= rr.available""")
def release_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_release = Window.partitionBy("s").orderBy("available")
    rel = data.releases(spark, sf_dir).withColumn("r", F.round(features.log_return(F.col("v"), by_release, 4), 8))
    return temporal.as_of_bucketed(_release_grid(spark, sf_dir), rel, "d", "available", ["r"], F.year, ["s"]).select(text("d"), "s", "r")


@query(f"""WITH RECURSIVE {PANEL}, n AS (SELECT s, d, v / 1000 AS x, row_number() OVER (PARTITION BY s ORDER BY d) AS i FROM panel),
    e AS (SELECT s, d, i, x AS m FROM n WHERE i = 1 UNION ALL SELECT n.s, n.d, n.i, pow(2, -1.0 / 5) * e.m + (1 - pow(2, -1.0 / 5)) * n.x FROM e JOIN n ON n.s = e.s AND n.i = e.i + 1)
    SELECT s, CAST(d AS VARCHAR) AS d, round(m, 4) AS m FROM e""")
def ema_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = data.panel(spark, sf_dir).withColumn("x", F.col("v") / 1000)
    return features.ema(p, "s", "d", "x", 5.0, "m", F.year).select("s", text("d"), F.round("m", 4).alias("m"))


@query(f"""WITH {DAILY}, {RELEASES}, {AS_OF_GRID} SELECT CAST(g.d AS VARCHAR) AS d, CAST(g.s AS BIGINT) AS s, round(r.v * pow(2, -(g.d - r.available) / 14.0), 6) AS decayed FROM g ASOF LEFT JOIN releases r ON g.s = r.s AND g.d >= r.available""")
def age_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.as_of_bucketed(_release_grid(spark, sf_dir), data.releases(spark, sf_dir), "d", "available", ["v"], F.year, ["s"])
    return out.select(text("d"), "s", F.round(F.col("v") * age_decay(F.date_diff("d", "matched_at"), 14), 6).alias("decayed"))


@query(f"""WITH {PANEL}, t AS (SELECT s, d, ln(lead(v, 1) OVER w / v) AS target_return_1d, ln(lead(v, 5) OVER w / v) AS target_return_5d, ln(lead(v, 20) OVER w / v) AS target_return_20d, lead(d, 1) OVER w AS target_start, lead(d, 20) OVER w AS target_end_20d,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY s) AS n FROM panel WINDOW w AS (PARTITION BY s ORDER BY d))
    SELECT s, CAST(d AS VARCHAR) AS d, round(target_return_1d, 8) AS target_return_1d, round(target_return_5d, 8) AS target_return_5d, round(target_return_20d, 8) AS target_return_20d, CAST(target_start AS VARCHAR) AS target_start, CAST(target_end_20d AS VARCHAR) AS target_end_20d
    FROM t WHERE i > 60 AND i <= n - 60""")
def forward_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.forward_targets(data.panel(spark, sf_dir), "v", "d", line(), (1, 5, 20))
    return features.trimmed(t, ["s"], "d", 60, 60).select("s", text("d"), *rounded("target_return_1d", "target_return_5d", "target_return_20d", places=8), text("target_start"), text("target_end_20d"))


@query(f"WITH {PANEL} SELECT s, CAST(d AS VARCHAR) AS d, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS z FROM panel WINDOW w AS (PARTITION BY s)")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.panel(spark, sf_dir).withColumn("z", features.standardise(F.col("v"), Window.partitionBy("s"))).select("s", text("d"), *rounded("z"))


@query("""WITH RECURSIVE d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), x AS (SELECT day, timezone('UTC', timezone('America/New_York', (day + 1)::TIMESTAMP + INTERVAL 990 MINUTE)) AS ny, timezone('UTC', timezone('Europe/Berlin', day::TIMESTAMP + INTERVAL 885 MINUTE)) AS eu, timezone('UTC', timezone('Asia/Tokyo', (day + 1)::TIMESTAMP + INTERVAL 540 MINUTE)) AS jp FROM d)
    SELECT CAST(day AS VARCHAR) AS day, epoch_us(greatest(ny, eu, jp)) AS effective FROM x""")
def effective_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    at = F.greatest(temporal.local_instant(F.col("day"), "16:30", "America/New_York", 1), temporal.local_instant(F.col("day"), "14:45", "Europe/Berlin"), temporal.local_instant(F.col("day"), "09:00", "Asia/Tokyo", 1))
    return days.select(text("day"), at.alias("t")).select("day", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', t)").alias("effective"))


@query("SELECT 'l_orderkey,l_linenumber' AS key, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated, count(*) FILTER (NOT isfinite(l_extendedprice)) AS not_finite, count(*) FILTER (l_extendedprice <= 0) AS not_positive FROM lineitem")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.integrity(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice")


@query(f"WITH {PANEL} SELECT CAST(d AS VARCHAR) AS d, s, v FROM panel WHERE s IN (1, 3) ORDER BY d DESC, s LIMIT 50")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latest(data.panel(spark, sf_dir).where(F.col("s").isin(1, 3)), ["d", "s"], 50).select(text("d"), "s", "v")

