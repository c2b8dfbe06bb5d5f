"""Series that the queries use, from the test tables, with the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

SERIES = 8

PANEL = "panel AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(l_suppkey % 8 AS BIGINT) AS s, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY ALL)"
GRID = PANEL + ", grid AS (SELECT d, " + ", ".join(f"max(v) FILTER (s = {i}) AS s{i}" for i in range(SERIES)) + " FROM panel GROUP BY d HAVING count(*) = 8)"
TICKS = "ticks AS (SELECT event_id AS tick_id, ts, value AS price FROM events WHERE event_type = 'purchase')"
HOURLY = TICKS + ", hourly AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS bar_start, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, count(*) AS ticks FROM ticks GROUP BY 1)"
DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) / count(*) AS v, count(*) AS n FROM orders GROUP BY 1)"
RELEASES = "releases AS (SELECT CAST(l_suppkey % 4 AS BIGINT) AS s, CAST(l_shipdate AS DATE) + 7 AS available, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1, 2)"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily panel: d, s (series), v."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_shipdate").cast("date").alias("d"), (F.col("l_suppkey") % SERIES).cast("long").alias("s")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide panel of the days on which every series has a value."""
    wide = panel(spark, sf_dir).groupBy("d").agg(*(F.max(F.when(F.col("s") == i, F.col("v"))).alias(f"s{i}") for i in range(SERIES)))
    return wide.dropna()


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("tick_id"), "ts", F.col("value").alias("price"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One market series by day: mean order price, and how many orders stand behind it."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg((F.round(F.sum("o_totalprice"), 2) / F.count("*")).alias("v"), F.count("*").alias("n"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of four sources that become available a week after their day."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy((F.col("l_suppkey") % 4).cast("long").alias("s"), F.date_add(F.col("l_shipdate").cast("date"), 7).alias("available")).agg(F.round(F.sum("l_quantity"), 2).alias("v"))
