"""Streaming bars: the hourly bars of a tick stream, with a watermark for late ticks, and a running memory by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tick_stream(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", **options: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_bars(ticks: DataFrame, late: str = "2 hours") -> DataFrame:
    """OHLC bars by hour and event type. A tick later than the watermark is dropped; a bar closes when the watermark has passed it."""
    order = F.struct("ts", "event_id")
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("ticks")).select(F.col("w.start").alias("bar_start"), "event_type", "open", "high", "low", "close", "ticks")


def memory(ticks: DataFrame, half_life: float) -> DataFrame:
    """Exponential memory of the values of each event type over a stream, kept as state; one row for each key and trigger."""
    p = 2.0 ** (-1.0 / half_life)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        m = state.get[0] if state.exists else None
        n = state.get[1] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for x in rows["value"]:
            m = x if m is None else p * m + (1 - p) * x
        state.update((float(m), int(n + len(rows))))
        yield pd.DataFrame({"event_type": [key[0]], "m": [float(m)], "n": [int(n + len(rows))]})

    return ticks.groupBy("event_type").applyInPandasWithState(step, "event_type string, m double, n long", "m double, n long", "update", "NoTimeout")
