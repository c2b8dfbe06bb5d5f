"""Bars: ticks to bars, sessions, delta decoding, validation and quarantine, expected hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import session_date


def _ohlc(price: Column, order: Column, prefix: str = "") -> list[Column]:
    """Open, high, low and close by a total order of the ticks."""
    return [F.min_by(price, order).alias(f"{prefix}open"), F.max(price).alias(f"{prefix}high"), F.min(price).alias(f"{prefix}low"), F.max_by(price, order).alias(f"{prefix}close")]


def bars(ticks: DataFrame, unit: str, by: list[str] | None = None) -> DataFrame:
    """OHLC bars of ``unit`` ('minute', 'hour') from (ts, tick_id, price)."""
    start = F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bar_start")
    return ticks.groupBy(*(by or []), start).agg(*_ohlc(F.col("price"), F.struct("ts", "tick_id")), F.count("*").alias("ticks"))


def quote_bars(ticks: DataFrame, unit: str = "minute") -> DataFrame:
    """Bid and ask bars from (ts, tick_id, bid, ask)."""
    order = F.struct("ts", "tick_id")
    return ticks.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bar_start")).agg(*_ohlc(F.col("bid"), order, "bid_"), *_ohlc(F.col("ask"), order, "ask_"), F.count("*").alias("ticks"))


def session_bars(hourly: DataFrame, expected: int = 24) -> DataFrame:
    """Trading-day bars from hourly ones: days close at 17:00 in New York, from Monday to Friday; complete with all hours there."""
    days = hourly.withColumn("session_date", session_date(F.col("bar_start"))).where(F.dayofweek("session_date").between(2, 6))
    order = F.col("bar_start")
    out = days.groupBy("session_date").agg(F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("ticks").alias("ticks"), F.count("*").alias("hours_present"))
    return out.withColumn("hours_expected", F.lit(expected).cast("long")).withColumn("complete", F.col("hours_present") == F.col("hours_expected"))


def calendar_bars(hourly: DataFrame, holidays: DataFrame) -> DataFrame:
    """``session_bars`` with the expected hours of the calendar: a session is complete with the hours that holidays leave it."""
    days = session_bars(hourly).drop("hours_expected", "complete")
    hours = expected_hours(days.select("session_date"), holidays).groupBy("session_date").agg(F.count("*").alias("hours_expected"))
    out = days.join(hours, "session_date", "left").withColumn("hours_expected", F.coalesce("hours_expected", F.lit(0).cast("long")))
    return out.withColumn("complete", F.col("hours_present") >= F.col("hours_expected"))


def payload_sessions(hourly: DataFrame, holidays: DataFrame, wait: str = "INTERVAL 60 SECONDS") -> DataFrame:
    """``calendar_bars`` of bars with ``volume`` and ``raw_payload_hash``: also the volume, the distinct hashes in order (a session has few), its bounds, and from when it may be used: ``wait`` after its close, an assumption."""
    from ..functions.columns import from_zone

    days = hourly.withColumn("session_date", session_date(F.col("bar_start"))).where(F.dayofweek("session_date").between(2, 6))
    more = days.groupBy("session_date").agg(F.sum("volume").alias("volume"), F.array_sort(F.collect_set("raw_payload_hash")).alias("raw_payload_hashes"))
    close = lambda day: from_zone(day.cast("timestamp_ntz") + F.expr("INTERVAL 17 HOURS"), "America/New_York")
    out = calendar_bars(hourly, holidays).join(more, "session_date")
    out = out.withColumns({"bar_start": close(F.date_sub("session_date", 1)), "bar_end": close(F.col("session_date"))})
    return out.withColumns({"available_at": F.col("bar_end") + F.expr(wait), "time_quality": F.lit("inferred_conservative")})


def decode_deltas(candles: DataFrame, by: str) -> DataFrame:
    """Running values of delta-encoded integer units: (by, pos, delta, multiplier, base) to a price.

    The chain runs over every row, also over those that a later check rejects.
    """
    chain = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return candles.withColumn("units", F.sum("delta").over(chain)).withColumn("price", F.col("base") + F.col("units") * F.col("multiplier"))


CANDLES = "timestamp long, multiplier double, shift long, open double, high double, low double, close double, " + ", ".join(f"{c} array<double>" for c in ("times", "opens", "highs", "lows", "closes", "volumes"))


def candle_fault(shift_ms: int = 3_600_000) -> Column:
    """Why a payload of delta-encoded candles breaks its contract; null for a sound one. The first in this order: unreadable, shift (not that of the bars), unaligned (a start between bars), length (arrays of several lengths or none), negative_time, fractional (a delta that is no whole number)."""
    arrays = [F.col(c) for c in ("times", "opens", "highs", "lows", "closes", "volumes")]
    plain = [F.col(c) for c in ("timestamp", "multiplier", "shift", "open", "high", "low", "close")]
    missing, uneven, fractional = F.lit(False), F.size("times") == 0, F.lit(False)
    for c in [*plain, *arrays]:
        missing = missing | c.isNull()
    for c in arrays[1:]:
        uneven = uneven | (F.size(c) != F.size("times"))
    for c in arrays[:-1]:
        fractional = fractional | F.exists(c, lambda x: x.isNull() | (x != F.floor(x)))
    return (
        F.when(missing, "unreadable").when(F.col("shift") != shift_ms, "shift").when(F.col("timestamp") % shift_ms != 0, "unaligned").when(uneven, "length")
        .when(F.exists("times", lambda x: x < 0), "negative_time").when(fractional, "fractional")
    )


def read_candles(payloads: DataFrame, shift_ms: int = 3_600_000) -> DataFrame:
    """Payloads (id, content as JSON text) as the columns of ``CANDLES`` with ``fault``; ``explode_candles`` takes those without one. A payload with a fault gives no bars at all, as its chain cannot be trusted."""
    parsed = payloads.select("id", F.from_json(F.col("content").cast("string"), CANDLES).alias("p")).select("id", "p.*")
    return parsed.withColumn("fault", candle_fault(shift_ms))


def explode_candles(blobs: DataFrame, shift_ms: int = 3_600_000) -> DataFrame:
    """Delta-encoded candle arrays to rows. Columns: id, timestamp (ms), multiplier, open, high, low, close (bases), times, opens,
    highs, lows, closes (integer deltas), volumes."""
    rows = blobs.select("id", "timestamp", "multiplier", *(F.col(c).alias(f"base_{c}") for c in ("open", "high", "low", "close")), F.posexplode(F.arrays_zip("times", "opens", "highs", "lows", "closes", "volumes")).alias("pos", "z"))
    chain = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("id", "pos", (F.col("timestamp") + F.sum(F.col("z.times").cast("long")).over(chain) * shift_ms).alias("ms"), *((F.col(f"base_{c}") + F.sum(F.col(f"z.{c}s").cast("long")).over(chain) * F.col("multiplier")).alias(c) for c in ("open", "high", "low", "close")), F.col("z.volumes").alias("volume"))
    return out.withColumn("bar_start", F.timestamp_millis("ms").cast("timestamp_ntz"))


def reasons(price_columns: bool = True) -> Column:
    """Comma-joined reasons to reject a bar; empty for a good one."""
    bad = [F.when(F.isnan(c) | (F.abs(c) == float("inf")) | F.col(c).isNull(), f"invalid_{c}") for c in ("open", "high", "low", "close")]
    order = F.when((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")), "invalid_ohlc")
    return F.concat_ws(",", *(bad if price_columns else []), order, F.when(F.least("open", "high", "low", "close") <= 0, "non_positive"), F.when(F.col("volume") < 0, "negative_volume"))


def quarantine(rows: DataFrame) -> DataFrame:
    """Adds ``reject``: why a bar goes, with ``duplicate_timestamp`` for every copy of a repeated start."""
    copies = F.count("*").over(Window.partitionBy("bar_start"))
    return rows.withColumn("reject", F.concat_ws(",", F.nullif(reasons(), F.lit("")), F.when(copies > 1, "duplicate_timestamp")))


def expected_hours(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Hours of each weekday session that holidays do not cover wholly: days (session_date) and holidays (from_ts, till_ts).

    Holidays count together: an hour that several of them cover without a gap is no expected one.
    """
    from ..functions.columns import from_zone

    close = from_zone(F.col("session_date").cast("timestamp_ntz") + F.expr("INTERVAL 17 HOURS"), "America/New_York")
    opened = from_zone(F.date_sub("session_date", 1).cast("timestamp_ntz") + F.expr("INTERVAL 17 HOURS"), "America/New_York")
    hours = days.where(F.dayofweek("session_date").between(2, 6)).select("session_date", opened.alias("opened"), close.alias("closed"))
    hours = hours.select("session_date", F.explode(F.sequence("opened", F.col("closed") - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    # the hours that each holiday touches, with the minutes that it covers of them; holidays that overlap within an hour are merged there
    hour_of = lambda ts: F.to_timestamp_ntz(F.date_format(ts, "yyyy-MM-dd HH"), F.lit("yyyy-MM-dd HH"))
    touched = holidays.where("from_ts < till_ts").select("from_ts", "till_ts", F.explode(F.sequence(hour_of(F.col("from_ts")), hour_of(F.col("till_ts")), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    end = F.col("hour") + F.expr("INTERVAL 1 HOUR")
    parts = touched.select("hour", F.greatest("from_ts", "hour").cast("timestamp_ntz").alias("a"), F.least(F.col("till_ts"), end).cast("timestamp_ntz").alias("b")).where("a < b").distinct()
    line = Window.partitionBy("hour").orderBy("a", "b")
    reached = F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1))
    gapless = parts.withColumn("joins", F.col("a") <= F.coalesce(reached, F.col("hour")))
    covered = gapless.groupBy("hour").agg(F.bool_and("joins").alias("whole"), F.max("b").alias("b")).where(F.col("whole") & (F.col("b") >= F.col("hour") + F.expr("INTERVAL 1 HOUR"))).select("hour")
    return hours.join(covered, "hour", "left_anti").select("session_date", "hour")


def missing_hours(expected: DataFrame, hourly: DataFrame) -> DataFrame:
    return expected.join(hourly.select(F.col("bar_start").alias("hour")), "hour", "left_anti")
