"""Event studies: aligning events with market sessions and summarising what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..folders import cut
from . import ordered


def session_targets(events: DataFrame, sessions: DataFrame, horizons: tuple[int, ...] = (1, 5, 20, 60)) -> DataFrame:
    """Returns from an event's anchor price over whole sessions.

    ``events``: event_id, anchor_day (its session), anchor_price. ``sessions``: day, close, complete. The h-th session after the anchor's
    ends horizon h. The first incomplete session blanks its own and all longer horizons.
    """
    line = Window.orderBy("day")
    numbered = sessions.withColumn("i", F.row_number().over(line)).withColumn("broken_upto", F.sum((~F.col("complete")).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    at = numbered.select(F.col("day").alias("anchor_day"), F.col("i").alias("start"), F.col("broken_upto").alias("broken_before"))
    out = events.join(at, "anchor_day")
    ends = out.select("event_id", "start", "broken_before", "anchor_price", F.explode(F.array(*(F.lit(h) for h in horizons))).alias("horizon"))
    later = numbered.select(F.col("i").alias("end"), F.col("day").alias("end_day"), "close", "broken_upto")
    joined = ends.withColumn("end", F.col("start") + F.col("horizon")).join(later, "end", "left")
    clean = F.col("broken_upto") == F.col("broken_before")
    status = F.when(F.col("end_day").isNull(), "insufficient_future_sessions").when(~clean, "incomplete_market_path").otherwise("complete")
    good = status == "complete"
    return joined.select("event_id", "horizon", status.alias("status"), F.when(good, F.col("end_day")).alias("end_day"), F.when(good, F.col("close") / F.col("anchor_price") - 1).alias("ret"), F.when(good, F.log(F.col("close") / F.col("anchor_price"))).alias("log_ret"))


def overlapping(rows: DataFrame, by: list[str], start: str, end: str, key: list[str]) -> DataFrame:
    """Adds ``overlaps``: the window starts before an earlier one of its group has ended."""
    reached = ordered.running_max_before(rows, by, [start, end, *key], end, "_reached")
    return reached.withColumn("overlaps", F.coalesce(F.col(start) < F.col("_reached"), F.lit(False))).drop("_reached")


def summary(rows: DataFrame, by: list[str], ret: str, least: int = 8) -> DataFrame:
    """Count, mean, median, sample sd, share of positive returns, errors against zero and overlaps of each group."""
    value = F.col(ret)
    rows = cut(rows.where(value.isNotNull()).select(*by, ret, "overlaps"))
    median = ordered.quantiles(rows, by, ret, {"median": 0.5})
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.avg((value > 0).cast("double")).alias("positive_share"), F.avg(F.abs(value)).alias("mae_zero"), F.sqrt(F.avg(value * value)).alias("rmse_zero"), F.count_if("overlaps").alias("n_overlapping"),
    )
    return out.join(median, by).withColumn("status", F.when(F.col("n") < least, "insufficient").otherwise("diagnostic"))


def trailing_percentile(events: DataFrame, history: DataFrame, value: str, least: int = 8, most: int = 52) -> DataFrame:
    """Mid-rank percentile of the latest value known at each event among the last ``most`` known ones, and its regime.

    ``events``: event_id, at. ``history``: available_at, obs_id and the value. The history gets its ranks once; an as-of join does the rest.
    """
    from .temporal import as_of_bucketed

    line = Window.orderBy("available_at", "obs_id").rowsBetween(-(most - 1), 0)
    window = F.collect_list(value).over(line)
    known = history.withColumn("_w", window)
    rank = (F.size(F.filter("_w", lambda x: x < F.col(value))) + 0.5 * F.size(F.filter("_w", lambda x: x == F.col(value)))) / F.size("_w")
    known = known.withColumn("history", F.size("_w")).withColumn("percentile", rank)
    out = as_of_bucketed(events, known, "at", "available_at", ["obs_id", "history", "percentile"], F.year, order=["obs_id"])
    regime = F.when(F.col("history").isNull(), "no_available_position").when(F.col("history") < least, "insufficient_position_history").when(F.col("percentile") <= 1 / 3, "short_crowded").when(F.col("percentile") >= 2 / 3, "long_crowded").otherwise("neutral")
    return out.withColumn("regime", regime)
