"""Queries that write series as published payloads and read them back, and a stream of ticks to bars."""

from __future__ import annotations

import lzma
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import shared_folder
from ..operators import audits, bars, publish
from ..sources import archives, raw, releases, series
from ..streaming import bars as streaming
from . import data
from .data import HOURLY
from .registry import query, table


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total of the orders of each day, in cents, and their number."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count("*").alias("n"))


def _monthly(spark: SparkSession, sf_dir: str, entry, glue: str, head: str = "", tail: str = "") -> DataFrame:
    """One payload for each month of the daily series, from an expression for each day."""
    d = _daily(spark, sf_dir).select("d", F.col("v").cast("decimal(18,2)").cast("string").alias("v"), F.col("n").cast("string").alias("n"))
    days = d.select(F.trunc("d", "month").cast("string").alias("id"), F.struct("d", entry.alias("e")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), glue)
    return days.groupBy("id").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("content"))


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("series", F.col("day").cast("string").alias("day"), F.round("value", 2).alias("value"))


TOTALS = "daily AS (SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS v, count(*) AS n FROM orders GROUP BY 1)"
BOTH = f"WITH {TOTALS} SELECT 'price' AS series, CAST(d AS VARCHAR) AS day, round(v, 2) AS value FROM daily UNION ALL SELECT 'count', CAST(d AS VARCHAR), CAST(n AS DOUBLE) FROM daily"
ONE = f"WITH {TOTALS} SELECT 'price' AS series, CAST(d AS VARCHAR) AS day, round(v, 2) AS value FROM daily"


@query(BOTH)
def atom_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit("<entry><m:properties><d:NEW_DATE>"), F.col("d").cast("string"), F.lit("T00:00:00</d:NEW_DATE><d:P>"), "v", F.lit("</d:P><d:N>"), "n", F.lit("</d:N></m:properties></entry>"))
    return _out(series.atom_xml(_monthly(spark, sf_dir, entry, "\n", "<feed>", "</feed>"), "NEW_DATE", {"P": "price", "N": "count"}))


@query(BOTH)
def csv_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat_ws(",", F.date_format("d", "MM/dd/yyyy"), "v", "n")
    return _out(series.dated_csv(_monthly(spark, sf_dir, entry, "\r\n", "a note, first\nDATE,CLOSE,COUNT\n"), "^DATE,", "DATE", {"CLOSE": "price", "COUNT": "count"}, ("MM/dd/yyyy",)))


@query(ONE)
def keyed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit("A.B,"), F.col("d").cast("string"), F.lit(","), "v", F.lit("\nA.C,"), F.col("d").cast("string"), F.lit(",1"))
    return _out(series.keyed_csv(_monthly(spark, sf_dir, entry, "\n", "KEY,TIME_PERIOD,OBS_VALUE\n"), "A.B", "price"))


@query(ONE)
def cube_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit("<Cube time='"), F.col("d").cast("string"), F.lit("'><Cube currency='USD' rate='"), "v", F.lit("'/><Cube currency='JPY' rate='1'/></Cube>"))
    return _out(series.cube_xml(_monthly(spark, sf_dir, entry, "", "<Cube>", "</Cube>"), "USD", "price"))


@query(ONE)
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir).select(F.trunc("d", "month").cast("string").alias("id"), F.struct(F.date_diff("d", F.lit("1970-01-01").cast("date")).alias("day"), F.col("v").cast("decimal(18,2)").cast("string").alias("v")).alias("x")).groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    times = F.array_join(F.transform("x", lambda x: (x["day"].cast("long") * 86400 + 3600).cast("string")), ",")
    closes = F.array_join(F.transform("x", lambda x: x["v"]), ",")
    content = F.concat(F.lit('{"chart":{"result":[{"timestamp":['), times, F.lit('],"indicators":{"quote":[{"close":['), closes, F.lit("]}]}}]}}"))
    return _out(series.chart_json(d.select("id", content.alias("content")), "price"))


@query("SELECT 'g' || (s_suppkey % 3) AS id, count(*) AS records, CAST(sum(s_suppkey) AS BIGINT) AS total FROM supplier GROUP BY 1")
def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("g"), (F.col("s_suppkey") % 3).cast("string")).alias("id")).agg(F.array_join(F.collect_list(F.concat(F.col("s_suppkey").cast("string"), F.lit(',"x",{"k": 1}'))), ",").alias("body"))
    r = series.flat_records(s.select("id", F.concat(F.lit("["), "body", F.lit("]")).alias("content")), ["key", "name", "more"])
    return r.groupBy("id").agg(F.count("*").alias("records"), F.sum(F.col("record")["key"].cast("long")).alias("total"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CAST(round(value) AS BIGINT) AS k FROM events WHERE event_type = 'click')
    SELECT user_id, pos, 1704067200000 + CAST(sum(1 + k % 3) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) * 3600000 AS ms, round(1.1::DOUBLE + CAST(sum(k) OVER (PARTITION BY user_id ORDER BY pos) AS DOUBLE) * 0.00001::DOUBLE, 8) AS open FROM e""")
def candle_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "event_id", F.round("value").cast("int").alias("k"))
    packed = e.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "k"))), lambda x: x["k"]).alias("opens"))
    zeros = F.transform("opens", lambda x: F.lit(0))
    blobs = packed.select("id", F.lit(1704067200000).alias("timestamp"), F.lit(0.00001).alias("multiplier"), *(F.lit(1.1).alias(c) for c in ("open", "high", "low", "close")), F.transform("opens", lambda x: 1 + x % 3).alias("times"), "opens", *(zeros.alias(c) for c in ("highs", "lows", "closes")), F.transform("opens", lambda x: F.lit(1.0)).alias("volumes"))
    return bars.explode_candles(blobs).select(F.col("id").alias("user_id"), F.col("pos").cast("long").alias("pos"), "ms", F.round("open", 8).alias("open"))


@query("""SELECT CAST(date_trunc('hour', ts)::TIMESTAMP AS VARCHAR) AS bar_start, event_type, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2, date_trunc('hour', ts)""")
def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly bars of the events table read as a stream to its end; results go to the session's shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a stream reads folders: that of the table's parts, or the one that holds its single file
    path = f"{sf_dir}/events.parquet"
    parts = all("/events.parquet/" in f for f in spark.read.parquet(path).inputFiles())
    stream = streaming.tick_stream(spark, path) if parts else streaming.tick_stream(spark, sf_dir, pathGlobFilter="events.parquet")
    out = streaming.hourly_bars(stream)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/bars")

    out.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{folder}/bars")
    return done.select(F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss").alias("bar_start"), "event_type", "open", "high", "low", "close", "ticks")


# ---- release texts: pages written from the orders of each day and read back

PAGES = "days AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY 1)"


@query(f"""WITH {PAGES} SELECT CAST(d AS VARCHAR) AS d, CAST(timezone('UTC', timezone('America/New_York', d::TIMESTAMP + INTERVAL '8 hours 30 minutes')) AS VARCHAR) AS embargo, CAST(CASE n % 4 WHEN 0 THEN n WHEN 1 THEN -n ELSE 0 END AS DOUBLE) AS jobs, CASE WHEN n % 3 <> 0 THEN CASE WHEN v % 2 = 0 THEN 1 ELSE -1 END * (v % 9 + 1) / 10.0 END AS month_prices,
    CASE WHEN n % 3 = 0 THEN CASE WHEN v % 2 = 0 THEN 1 ELSE -1 END * (v % 9 + 1) / 10.0 END AS two_month_prices, (v % 20) / 4.0 AS lower, (v % 20) / 4.0 + 0.25 AS upper, (v % 7) / 4.0 AS deposit, (v % 7) / 4.0 + 0.5 AS refinancing, (v % 7) / 4.0 + 0.75 AS lending, CAST(d + 6 AS VARCHAR) AS effective FROM days""")
def release_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embargo, payrolls, prices of one and of two months, the target range and three key rates from the text of pages."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v"))
    n, v = F.col("n"), F.col("v")
    jobs = F.when(n % 4 == 0, F.format_string("increased by %,d", n * 1000)).when(n % 4 == 1, F.format_string("fell by %,d", n * 1000)).otherwise("was unchanged")
    over = F.when(n % 3 == 0, F.lit("on a seasonally adjusted basis over the 2 months")).otherwise(F.date_format("d", "'in' MMMM"))
    prices = F.format_string("%s %s percent ", F.when(v % 2 == 0, "rose").otherwise("declined"), ((v % 9 + 1) / 10).cast("string"))
    mixed = lambda q: F.concat(F.expr(f"string({q} div 4)"), F.element_at(F.array(*map(F.lit, ("", "-1/4", "-1/2", "-3/4"))), F.expr(f"int({q} % 4) + 1")))
    rate = lambda more: F.format_string("%s%%", ((v % 7) / 4 + more).cast("string"))
    page = F.concat(
        F.lit("Transmission of material in this release is embargoed until 8:30 a.m. (ET) "), F.date_format("d", "EEEE, MMMM d, yyyy"), F.lit(". Total nonfarm payroll employment "), jobs, F.date_format("d", "' in' MMMM"),
        F.lit(". The Consumer Price Index for All Urban Consumers (CPI-U) "), prices, over, F.lit(". The Committee decided to maintain the target range for the federal funds rate at "), mixed("(v % 20)"), F.lit(" to "), mixed("(v % 20 + 1)"),
        F.lit(" percent. The interest rates on the main refinancing operations, the marginal lending facility and the deposit facility will be "), rate(0.5), F.lit(", "), rate(0.75), F.lit(" and "), rate(0.0), F.lit(" respectively, with effect from "),
        F.date_format(F.date_add("d", 6), "d MMMM yyyy"), F.lit("."))
    read = days.select("d", page.alias("text")).repartition(F.col("d"))
    t = F.col("text")
    facts = read.select("d", releases.embargo(t).alias("embargo"), releases.payrolls(t).alias("jobs"), releases.consumer_prices(t).alias("month_prices"), releases.consumer_prices(t, 2).alias("two_month_prices"), releases.target_range(t).alias("_r"), releases.key_rates(t).alias("_k"), releases.effective_date(t).alias("_e"))
    return facts.select(F.col("d").cast("string").alias("d"), F.date_format("embargo", "yyyy-MM-dd HH:mm:ss").alias("embargo"), "jobs", "month_prices", "two_month_prices", "_r.lower", "_r.upper", *(F.col("_k")[k].alias(k) for k in ("deposit", "refinancing", "lending")), F.col("_e").cast("string").alias("effective"))


# ---- candles as JSON payloads, stored, pinned, published and replayed

PRICES = ("open", "high", "low", "close")
#: Payloads are days; these hold a fault, by the day of the month.
FAULTS = {3: "shift", 5: "unaligned", 7: "length", 9: "negative_time", 11: "fractional", 13: "unreadable"}


def _candle_payloads(spark: SparkSession, sf_dir: str, faulty: bool) -> DataFrame:
    """One JSON document for each day of hourly bars: whole cents as deltas from bar to bar, starts as hours from the bar before."""
    hourly = bars.bars(data.ticks(spark, sf_dir), "hour").select("bar_start", "ticks", F.to_date("bar_start").alias("day"), F.hour("bar_start").alias("h"), *(F.round(F.col(c) * 100).cast("long").alias(c) for c in PRICES))
    line = Window.partitionBy("day").orderBy("h")
    delta = hourly.select("day", "h", F.col("ticks").cast("double").alias("volumes"), (F.col("h") - F.lag("h", 1, 0).over(line)).cast("double").alias("times"), *((F.col(c) - F.lag(c, 1, 0).over(line)).cast("double").alias(f"{c}s") for c in PRICES))
    names = ("times", "opens", "highs", "lows", "closes", "volumes")
    days = delta.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("h", *names))).alias("x"))
    of = {c: F.col(f"x.{c}") for c in names}
    fault = F.dayofmonth("day") if faulty else F.lit(0)
    start = F.unix_millis(F.col("day").cast("timestamp"))
    of["opens"] = F.when(fault == 7, F.concat(of["opens"], F.array(F.lit(1.0)))).otherwise(of["opens"])
    of["times"] = F.when(fault == 9, F.transform(of["times"], lambda t: -1 - t)).otherwise(of["times"])
    of["highs"] = F.when(fault == 11, F.transform(of["highs"], lambda t: t + 0.5)).otherwise(of["highs"])
    fields = [F.when(fault == 5, start + 1).otherwise(start).alias("timestamp"), F.lit(0.01).alias("multiplier"), F.when(fault == 3, 60000).otherwise(3600000).cast("long").alias("shift"), *(F.lit(0.0).alias(c) for c in PRICES), *(of[c].alias(c) for c in names)]
    text = F.to_json(F.struct(*fields))
    return days.select(F.col("day").cast("string").alias("id"), F.when(fault == 13, F.substring(text, 1, 50)).otherwise(text).alias("content"))


def _decoded(payloads: DataFrame) -> DataFrame:
    rows = bars.explode_candles(bars.read_candles(payloads).where("fault is null"))
    return rows.select(F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss").alias("bar_start"), *(F.round(c, 2).alias(c) for c in PRICES), F.col("volume").cast("long").alias("ticks"))


@query(f"WITH {HOURLY} SELECT strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar_start, open, high, low, close, ticks FROM hourly WHERE day(bar_start) NOT IN ({', '.join(map(str, FAULTS))})")
def candle_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars through JSON payloads; those that break the contract give no bars."""
    return _decoded(_candle_payloads(spark, sf_dir, faulty=True))


@query(f"WITH {HOURLY}, f AS (SELECT DISTINCT bar_start::DATE AS d FROM hourly) SELECT coalesce(CASE day(d) {' '.join(f"WHEN {k} THEN '{v}'" for k, v in FAULTS.items())} END, '') AS fault, count(*) AS payloads FROM f GROUP BY 1")
def candle_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.read_candles(_candle_payloads(spark, sf_dir, faulty=True)).groupBy(F.coalesce("fault", F.lit("")).alias("fault")).agg(F.count("*").alias("payloads"))


@query(f"WITH {HOURLY} SELECT strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar_start, open, high, low, close, ticks, 2 AS version FROM hourly")
def replayed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads stored with receipts, pinned, published as the first version and replayed from the store as the second, which is read back."""
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    fetched = _candle_payloads(spark, sf_dir, faulty=False).select(F.lit("ticks").alias("source"), F.col("id").alias("url"), F.lit(200).alias("status"), F.lit("2024-03-01").cast("timestamp").alias("fetched_at"), F.encode("content", "utf-8").alias("content"))
    raw.keep(fetched, f"{folder}/store")
    pins = raw.pinned(raw.receipts(spark, f"{folder}/store"), raw.payloads(spark, f"{folder}/store"))
    rows = _decoded(pins.select(F.col("url").alias("id"), F.decode("content", "utf-8").alias("content")))
    publish.publish_version(rows, folder, "bars", 0, pins=pins, by=["bar_start"])
    report = publish.replay(rows, folder, "bars", pins)
    return publish.published(spark, folder).withColumn("version", F.lit(report["version"]))


# ---- ticks in daily LZMA files, read back as a data source


def _packed(key: tuple, day: pd.DataFrame) -> pd.DataFrame:
    """One file of a day's ticks."""
    ordered = day.sort_values(["ms", "tick_id"])
    records = np.zeros(len(ordered), series.TICK)
    for c in ("ms", "ask", "bid", "ask_volume", "bid_volume"):
        records[c] = ordered[c].to_numpy()
    return pd.DataFrame({"name": [f"{key[0]}.bi5"], "content": [lzma.compress(records.tobytes(), format=lzma.FORMAT_ALONE)]})


ARCHIVED = "tk AS (SELECT ts::DATE AS day, CAST(epoch_us(ts) // 1000 % 86400000 AS BIGINT) AS ms, tick_id, CAST(round(price * 100) AS BIGINT) + 1 AS bid, CAST(round(price * 100) AS BIGINT) + 1 + tick_id % 7 AS ask FROM ticks)"


def _tick_archive(spark: SparkSession, sf_dir: str) -> str:
    """The purchases as ticks in cents, a file a day; one cent is added, as a tick of nothing is no tick."""
    folder = f"{shared_folder(spark)}/ticks-{uuid.uuid4().hex}"
    t = data.ticks(spark, sf_dir).select(
        F.to_date("ts").cast("string").alias("day"), (F.unix_millis(F.col("ts").cast("timestamp")) % 86400000).alias("ms"), "tick_id", (F.round(F.col("price") * 100).cast("long") + 1).alias("bid"),
        (F.round(F.col("price") * 100).cast("long") + 1 + F.col("tick_id") % 7).alias("ask"), F.lit(1.5).alias("ask_volume"), F.lit(0.5).alias("bid_volume"))
    archives.write_files(t.groupBy("day").applyInPandas(_packed, "name string, content binary"), folder)
    return folder


@query(f"WITH {data.TICKS}, {ARCHIVED} SELECT CAST(day AS VARCHAR) AS day, ms, round(bid / 100.0, 2) AS bid, round(ask / 100.0, 2) AS ask, row_number() OVER (PARTITION BY day ORDER BY ms, tick_id) - 1 AS tick_id FROM tk")
def archived_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick through daily LZMA files and back."""
    out = archives.read_ticks(spark, _tick_archive(spark, sf_dir), ["day", "ms", "bid", "ask", "tick_id"], points=100)
    return out.select(F.col("day").cast("string").alias("day"), "ms", F.round("bid", 2).alias("bid"), F.round("ask", 2).alias("ask"), "tick_id")


@query(f"WITH {data.TICKS}, {ARCHIVED} SELECT CAST(day AS VARCHAR) AS day, count(*) AS ticks, round(max(ask - bid) / 100.0, 2) AS widest, strftime(max(day + to_milliseconds(ms)), '%H:%M:%S') AS last FROM tk WHERE day >= DATE '2024-01-10' AND day < DATE '2024-01-20' GROUP BY day")
def archived_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days' spreads: only their files are opened, and no volumes are decoded."""
    out = archives.read_ticks(spark, _tick_archive(spark, sf_dir), ["day", "ts", "bid", "ask"], points=100).where("day >= date'2024-01-10' and day < date'2024-01-20'")
    return out.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("ticks"), F.round(F.max(F.col("ask") - F.col("bid")), 2).alias("widest"), F.date_format(F.max("ts"), "HH:mm:ss").alias("last"))


# ---- sessions of payload bars, and contracts of documents

SESSIONS = f"""{HOURLY}, sd AS (SELECT *, CAST(timezone('America/New_York', timezone('UTC', bar_start)) + INTERVAL 7 HOURS AS DATE) AS session_date, sha256(CAST(bar_start::DATE AS VARCHAR)) AS h FROM hourly),
    sx AS (SELECT session_date, arg_min(open, bar_start) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_start) AS close, CAST(sum(ticks) AS BIGINT) AS volume, count(*) AS hours_present, string_agg(DISTINCT h, ',' ORDER BY h) AS hashes FROM sd WHERE isodow(session_date) <= 5 GROUP BY 1)"""


@query(f"""WITH {SESSIONS} SELECT CAST(session_date AS VARCHAR) AS session_date, open, high, low, close, volume, hours_present, 24 - CASE WHEN day(session_date) % 5 = 0 THEN 2 ELSE 0 END AS hours_expected, hours_present >= 24 - CASE WHEN day(session_date) % 5 = 0 THEN 2 ELSE 0 END AS complete,
    sha256(hashes) AS hashes_sha256, strftime(timezone('UTC', timezone('America/New_York', session_date::TIMESTAMP + INTERVAL 17 HOURS)) + INTERVAL 60 SECONDS, '%Y-%m-%d %H:%M:%S') AS available_at FROM sx""")
def payload_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the payload bars with volume, the payloads behind them and when they may be used; every fifth day of a month two hours are a holiday."""
    payloads = _candle_payloads(spark, sf_dir, faulty=False)
    rows = bars.explode_candles(bars.read_candles(payloads).where("fault is null")).withColumns({"raw_payload_hash": F.sha2(F.col("id").cast("binary"), 256), "ticks": F.col("volume").cast("long")})
    rows = rows.select("bar_start", *(F.round(c, 2).alias(c) for c in PRICES), "ticks", F.col("volume").cast("long").alias("volume"), "raw_payload_hash")
    noon = F.col("id").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    holidays = payloads.where(F.dayofmonth(F.col("id").cast("date")) % 5 == 0).select(noon.alias("from_ts"), (noon + F.expr("INTERVAL 2 HOURS")).alias("till_ts"))
    out = bars.payload_sessions(rows, holidays)
    return out.select(F.col("session_date").cast("string").alias("session_date"), *PRICES, "volume", "hours_present", F.col("hours_expected").cast("int").alias("hours_expected"), "complete", F.sha2(F.array_join("raw_payload_hashes", ",").cast("binary"), 256).alias("hashes_sha256"), F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"))


CONTRACTS = {"a": ["<title>", "cookie", "</html>"], "b": ["href=", "Subscribe"], "c": ["<body", "no such phrase"]}


@query("WITH p AS (SELECT page_id, ['a', 'b', 'c', 'd'][page_id % 4 + 1] AS kind, lower(html) AS t FROM pages), r AS (SELECT unnest(['a', 'a', 'a', 'b', 'b', 'c', 'c']) AS kind, unnest(['<title>', 'cookie', '</html>', 'href=', 'subscribe', '<body', 'no such phrase']) AS phrase) SELECT kind, phrase, count(*) AS pages FROM p JOIN r USING (kind) WHERE NOT contains(t, phrase) GROUP BY 1, 2")
def document_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages of each kind lack a phrase that their contract names."""
    kinds = F.get(F.array(*map(F.lit, "abcd")), (F.col("page_id") % 4).cast("int"))
    lost = audits.missing_phrases(table(spark, sf_dir, "pages").select(kinds.alias("kind"), "html"), "kind", "html", CONTRACTS)
    return lost.select("kind", F.explode("missing").alias("phrase")).groupBy("kind", "phrase").agg(F.count("*").alias("pages"))
