"""Coverage, cleaning and integrity of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(rows: DataFrame, by: str, day: str) -> DataFrame:
    """First and last day of each series, its rows, the weekdays in between and how many are missing."""
    weekday = F.dayofweek(day).between(2, 6)
    seen = rows.groupBy(by).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n"), F.count_if(weekday).alias("present"))
    days = F.filter(F.sequence("first", "last"), lambda d: F.dayofweek(d).between(2, 6))
    out = seen.withColumn("weekdays", F.size(days).cast("long")).withColumn("missing", F.col("weekdays") - F.col("present"))
    return out.withColumn("status", F.when(F.col("missing") == 0, "READY").otherwise("PARTIAL"))


def clip(rows: DataFrame, day: str, first: str, last: str) -> DataFrame:
    return rows.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def last_wins(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The last finite value of each key."""
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))
    return finite.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def integrity(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """How often a key repeats and a value breaks the rules; all counts should be zero."""
    per_key = rows.groupBy(*key).agg(F.count("*").alias("c"), F.count_if(F.isnan(value) | (F.abs(value) == float("inf"))).alias("odd"), F.count_if(F.col(value) <= 0).alias("low"))
    return per_key.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated"), F.coalesce(F.sum("odd"), F.lit(0)).alias("not_finite"), F.coalesce(F.sum("low"), F.lit(0)).alias("not_positive")).select(F.lit(",".join(key)).alias("key"), "*")


def assert_empty(rows: DataFrame, what: str) -> None:
    """Fail with an example if there is a row."""
    found = rows.take(1)
    if found:
        raise ValueError(f"{what}: {found[0].asDict()}")


def latest(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The newest rows by the first column (ties by the others)."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be from 1 to 10000")
    return rows.orderBy(F.desc(order[0]), *order[1:]).limit(limit)
