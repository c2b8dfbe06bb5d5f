"""Every query of the engine with its SQL; the plan modules register them on import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import bars, features
from .plans import checks, data, exchange, knowledge, market, payloads, reports, research, spectra, suites, timing
from .plans.registry import ORACLES, QUERIES, Query

MODULES = (market, research, spectra, knowledge, payloads, reports, checks, suites, timing, exchange)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session bars with a rolling z-score of the close and forward returns."""
    line = Window.partitionBy(F.lit(0)).orderBy("session_date")
    days = bars.session_bars(bars.bars(data.ticks(spark, sf_dir), "hour"))
    days = days.withColumn("z", features.zscore(F.col("close"), line, 5))
    return features.forward_targets(days, "close", "session_date", line, (1, 5))
