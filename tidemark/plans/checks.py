"""Queries on contracts, peers, archives, windows, closed bars and spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded_corr
from ..operators import audits, bars, temporal
from . import data
from .data import DAILY, HOURLY, PANEL
from .market import HOLIDAYS, SESSION
from .registry import query, table
from .spectra import CHANGES, CORR, changes


@query(f"WITH {HOURLY} SELECT CAST(bar_start AS VARCHAR) AS bar_start, open, close FROM hourly WHERE bar_start >= TIMESTAMP '2024-01-05 00:30:00' AND bar_start + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 12:00:00'")
def closed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = audits.closed(bars.bars(data.ticks(spark, sf_dir), "hour"), "2024-01-05 00:30:00", "2024-01-20 12:00:00", 60)
    return own.select(F.col("bar_start").cast("string").alias("bar_start"), "open", "close")


@query(f"""WITH {HOURLY}, h AS (SELECT bar_start, bar_start + INTERVAL 1 HOUR AS bar_end, open FROM hourly), e AS (SELECT event_id, ts FROM events WHERE event_type = 'click' AND ts >= (SELECT min(bar_start) FROM hourly))
    SELECT event_id, CAST(h.bar_start AS VARCHAR) AS bar_start, h.open FROM e ASOF LEFT JOIN h ON e.ts <= h.bar_end""")
def first_bar_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event from the first bar on, the first bar that ends at or after it."""
    hourly = bars.bars(data.ticks(spark, sf_dir), "hour").withColumn("bar_end", F.col("bar_start") + F.expr("INTERVAL 1 HOUR"))
    first = hourly.agg(F.min("bar_start").alias("first"))
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "ts")
    e = e.join(F.broadcast(first), F.col("ts") >= F.col("first")).drop("first")
    out = temporal.as_of_bucketed(e, hourly, "ts", "bar_end", ["bar_start", "open"], lambda c: F.date_trunc("DAY", c), direction="forward")
    return out.select("event_id", F.col("bar_start").cast("string").alias("bar_start"), "open")


@query(f"""WITH {DAILY}, c AS (SELECT d, v, lead(v, 1) OVER w AS v1, lead(v, 5) OVER w AS v5, lead(v, 20) OVER w AS v20, lead(d, 20) OVER w AS d20 FROM daily WHERE n % 17 <> 0 WINDOW w AS (ORDER BY d))
    SELECT CAST(d AS VARCHAR) AS d, CAST(d20 AS VARCHAR) AS end_20d, round(ln(v1 / v), 8) AS r1, round(ln(v5 / v), 8) AS r5, round(ln(v20 / v), 8) AS r20 FROM c WHERE d20 IS NOT NULL""")
def complete_bar_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets over complete sessions only: incomplete ones are not counted, and a row stays only if every horizon is there."""
    line = Window.orderBy("d")
    rows = data.daily(spark, sf_dir).where("n % 17 <> 0")
    out = rows.select("d", F.lead("d", 20).over(line).alias("end"), *(F.log(F.lead("v", h).over(line) / F.col("v")).alias(f"r{h}") for h in (1, 5, 20)))
    return out.where("end is not null").select(F.col("d").cast("string").alias("d"), F.col("end").cast("string").alias("end_20d"), *(F.round(f"r{h}", 8).alias(f"r{h}") for h in (1, 5, 20)))


@query("""WITH q AS (SELECT CAST(ts AS DATE) AS d, (1 + event_id % 9) * 0.25::DOUBLE + value AS pips FROM events WHERE event_type = 'view')
    SELECT CAST(d AS VARCHAR) AS d, count(*) AS n, round(quantile_cont(pips, 0.5), 8) AS median_pips, round(quantile_cont(pips, 0.95), 8) AS p95_pips, round(max(pips), 8) AS most_pips FROM q GROUP BY d""")
def spread_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 95 % quantile and largest spread of each day's quotes, in pips."""
    pips = ((1 + F.col("event_id") % 9) * 0.25 + F.col("value")).alias("pips")
    q = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("ts").cast("date").cast("string").alias("d"), pips)
    return q.groupBy("d").agg(F.count("*").alias("n"), F.round(F.percentile("pips", 0.5), 8).alias("median_pips"), F.round(F.percentile("pips", 0.95), 8).alias("p95_pips"), F.round(F.max("pips"), 8).alias("most_pips"))


@query(f"""WITH {PANEL}, c AS (SELECT s, d, round(v - lag(v) OVER (PARTITION BY s ORDER BY d), 2) AS change FROM panel) SELECT s, CAST(d AS VARCHAR) AS d, change FROM c WHERE change IS NOT NULL ORDER BY abs(change) DESC, s, c.d LIMIT 10""")
def largest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest daily changes of the panel (ties by series and day)."""
    line = Window.partitionBy("s").orderBy("d")
    rows = data.panel(spark, sf_dir).withColumn("change", F.round(F.col("v") - F.lag("v").over(line), 2)).where("change is not null")
    return rows.orderBy(F.desc(F.abs("change")), "s", "d").limit(10).select("s", F.col("d").cast("string").alias("d"), "change")


@query(f"""WITH {CHANGES}, z AS (SELECT count(*) AS n FROM c), w AS (SELECT DISTINCT 'rolling' AS mode, a AS first, a + 250 AS past FROM z, (SELECT unnest(list_concat(range(0, n - 250 + 1, 60), [n - 250])) AS a FROM z WHERE n >= 250)
    UNION SELECT 'expanding', 0, b FROM (SELECT unnest(list_concat(range(250, n + 1, 125), [n])) AS b FROM z WHERE n >= 250))
    SELECT mode, first, past, count(*) AS n, round(avg(f), 8) AS mean, round({CORR.format(x='f', y='t')}, 8) AS r FROM w JOIN c ON c.i >= w.first AND c.i < w.past GROUP BY ALL""")
def aligned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and correlation over rolling and expanding windows, of each kind a last one that ends with the series."""
    rows = audits.chronological_windows(changes(spark, sf_dir), 250, 60, 250, 125)
    return rows.groupBy("mode", "first", "past").agg(F.count("*").alias("n"), F.round(F.avg("f"), 8).alias("mean"), F.round(guarded_corr(F.col("f"), F.col("t")), 8).alias("r"))


CALENDAR = """days AS (SELECT DISTINCT session_date FROM session WHERE isodow(session_date) <= 5),
    hh AS (SELECT session_date, unnest(generate_series(timezone('UTC', timezone('America/New_York', (session_date - 1)::TIMESTAMP + INTERVAL 17 HOUR)), timezone('UTC', timezone('America/New_York', session_date::TIMESTAMP + INTERVAL 17 HOUR)) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour FROM days),
    x AS (SELECT session_date, count(*) FILTER (NOT (hour >= TIMESTAMP '2024-01-15 20:30:00' AND hour + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-16 01:15:00') AND NOT (hour >= TIMESTAMP '2024-01-10 22:00:00' AND hour + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-11 22:00:00')) AS expected FROM hh GROUP BY 1)"""


@query(f"""WITH {HOURLY}, {SESSION}, {CALENDAR}, p AS (SELECT session_date, arg_min(open, bar_start) AS open, arg_max(close, bar_start) AS close, count(*) AS hours_present FROM session WHERE isodow(session_date) <= 5 GROUP BY 1)
    SELECT CAST(session_date AS VARCHAR) AS session_date, open, close, hours_present, expected AS hours_expected, hours_present >= expected AS complete FROM p JOIN x USING (session_date)""")
def calendar_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session bars that are complete when they have the hours that the calendar and its holidays leave."""
    hourly = bars.bars(data.ticks(spark, sf_dir), "hour")
    holidays = spark.createDataFrame(HOLIDAYS, "from_ts string, till_ts string").select(*(F.col(c).cast("timestamp_ntz").alias(c) for c in ("from_ts", "till_ts")))
    out = bars.calendar_bars(hourly, holidays)
    return out.select(F.col("session_date").cast("string").alias("session_date"), "open", "close", "hours_present", "hours_expected", "complete")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT o_orderkey AS k FROM orders) SELECT count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b, count(*) FILTER (a.k = b.k) AS shared,
    count(*) FILTER (a.k IS NULL OR b.k IS NULL) = 0 AS is_equal, count(*) FILTER (b.k IS NULL) = 0 AS is_subset, count(*) FILTER (a.k = b.k) = 0 AS is_disjoint FROM a FULL JOIN b ON a.k = b.k""")
def set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return audits.set_relation(returned, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), ["k"])


@query("SELECT l_orderkey, l_linenumber, o_orderpriority AS priority, o_totalprice AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def frozen_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its order; one without would fail the job."""
    peers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"))
    return audits.with_peer(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), peers, ["l_orderkey"], ["priority", "total"]).select("l_orderkey", "l_linenumber", "priority", "total")


@query("""SELECT field, expected, found, count(*) AS rows FROM (SELECT 'lang' AS field, 'en' AS expected, lang AS found FROM documents WHERE lang IS DISTINCT FROM 'en' UNION ALL SELECT 'has_text', 'true', CAST(text IS NOT NULL AS VARCHAR) FROM documents WHERE text IS NULL) GROUP BY ALL""")
def contract_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.col("text").isNotNull().alias("has_text"))
    return audits.contract_breaches(docs, {"lang": "en", "has_text": "true"})


@query("""WITH s AS (SELECT CAST(o_orderpriority AS VARCHAR) AS p, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1), y AS (SELECT a, b, unnest(range(greatest(year(a), 1993), year(b) + 1)) AS year FROM s WHERE year(b) >= 1993)
    SELECT DISTINCT CAST(a AS VARCHAR) AS start, CAST(b AS VARCHAR) AS "end", CASE WHEN year <= 1995 THEN '1993-1995' ELSE CAST(year AS VARCHAR) END AS period FROM y""")
def archive_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    spans = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min(day).alias("start"), F.max(day).alias("end")).select("start", "end").distinct()
    return audits.archive_plan(spans, 1993, 1995).select(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "period")


@query("SELECT 'orders' AS source, 'READY' AS status, count(*) AS rows FROM orders UNION ALL SELECT 'absent', 'UNAVAILABLE', 0 UNION ALL SELECT 'events', 'READY', count(*) FROM events")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources of which one cannot be read."""
    return audits.isolated(spark, {name: (lambda name=name: table(spark, sf_dir, name)) for name in ("orders", "absent", "events")})[1]
