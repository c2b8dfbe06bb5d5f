"""Point-in-time joins: what was known when. Every as-of join here is one union and one sort for each key (``as_of``) or key and stretch of time
(``as_of_bucketed``), not a range join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_known(records: DataFrame, at: Column, key: list[str], order: list[str], known: str = "available_at", strict: Column | None = None) -> DataFrame:
    """The latest version of each key that is available at ``at``; ``strict`` is a further condition on the rows. Unknown availability never counts."""
    usable = records.where(F.col(known).isNotNull() & (F.col(known) <= at))
    if strict is not None:
        usable = usable.where(strict)
    ranked = usable.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in (known, *order)))))
    return ranked.where("_rank = 1").drop("_rank")


def as_of(grid: DataFrame, records: DataFrame, grid_time: str, record_time: str, payload: list[str], by: list[str] | None = None, direction: str = "backward", strict: bool = False, order: list[str] | None = None) -> DataFrame:
    """Joins to each grid row the last record at or before its time (``forward``: the first at or after), or null.

    ``strict`` leaves out records at the very time. ``order`` breaks ties between records (the last wins; forward, the first). Adds the
    payload columns and ``matched_at``.
    """
    by = by or []
    backward = direction == "backward"
    side_first = (0 if not strict else 1) if backward else (1 if strict else 0)
    left = grid.select("*", F.col(grid_time).alias("_t"), F.lit(1 - side_first).alias("_side"), F.lit(None).alias("_p"))
    value = F.struct(F.col(record_time).alias("matched_at"), *payload)
    ties = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [])]
    right = records.select(*by, F.col(record_time).alias("_t"), F.lit(side_first).alias("_side"), value.alias("_p"), *ties)
    both = left.drop("_p").withColumn("_grid", F.lit(True)).unionByName(right.withColumn("_grid", F.lit(False)), allowMissingColumns=True)
    tie_names = [f"_o{i}" for i in range(len(ties))]
    keys = ["_t", "_side", *tie_names]
    line = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    line = line.orderBy(*keys) if backward else line.orderBy(F.desc("_t"), F.asc("_side"), *(F.desc(c) for c in tie_names))
    seen = F.last("_p", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_seen", seen).where("_grid")
    return out.select(*grid.columns, "_seen.matched_at", *(F.col(f"_seen.{c}").alias(c) for c in payload))


def as_of_bucketed(grid: DataFrame, records: DataFrame, grid_time: str, record_time: str, payload: list[str], bucket: Callable[[Column], Column], by: list[str] | None = None, direction: str = "backward", strict: bool = False, order: list[str] | None = None) -> DataFrame:
    """An as-of join of long series: sorted by key and time bucket (say ``F.year``) rather than by key, so that a series of any length is dealt to many tasks.

    The last record of each bucket is carried to the first rows of later ones (forward: the first record to the last rows of earlier ones); that table has one row for each key and bucket. ``bucket`` must not fall
    as time rises; keys must not be null.
    """
    by = by or []
    g = grid.withColumn("_b", bucket(F.col(grid_time)))
    r = records.withColumn("_b", bucket(F.col(record_time)))
    inside = as_of(g, r, grid_time, record_time, payload, [*by, "_b"], direction, strict, order)
    value = F.struct(F.col(record_time).alias("matched_at"), *payload)
    last = r.groupBy(*by, F.col("_b").alias("_rb")).agg((F.max_by if direction == "backward" else F.min_by)(value, F.struct(record_time, *(order or []))).alias("_carry"))
    carried = as_of(g.select(*by, "_b").distinct(), last, "_b", "_rb", ["_carry"], by, direction, strict=True).drop("matched_at")
    joined = inside.join(carried, [*by, "_b"], "left")
    own = F.col("matched_at").isNotNull()
    return joined.select(*grid.columns, F.coalesce("matched_at", "_carry.matched_at").alias("matched_at"), *(F.when(own, F.col(c)).otherwise(F.col(f"_carry.{c}")).alias(c) for c in payload))


def prediction_modes(events: DataFrame) -> DataFrame:
    """One row for each prediction that an event allows: before it, after its release, and an hour later when the reaction shows."""
    modes = F.array(
        F.struct(F.lit("pre_event").alias("prediction_mode"), F.col("reference_at").alias("prediction_time")),
        F.struct(F.lit("post_release").alias("prediction_mode"), F.col("available_at").alias("prediction_time")),
        F.struct(F.lit("reaction_confirmed").alias("prediction_mode"), (F.col("available_at") + F.expr("INTERVAL 1 HOUR")).alias("prediction_time")),
    )
    return events.select("*", F.explode(F.filter(modes, lambda m: m["prediction_time"].isNotNull())).alias("_m")).select("*", "_m.*").drop("_m")


def next_scheduled(days: DataFrame, schedule: DataFrame, within: int = 10) -> DataFrame:
    """The first scheduled release in (day, day + within], null where there is none."""
    nearest = as_of_bucketed(days.select("day").distinct(), schedule.where(F.col("release").isNotNull()), "day", "release", [], F.year, direction="forward", strict=True)
    return nearest.select("day", F.when(F.col("matched_at") <= F.date_add("day", within), F.col("matched_at")).alias("release"))


def local_instant(day: Column, clock: str, zone: str, offset_days: int = 0) -> Column:
    """Naive UTC instant of a wall clock 'HH:MM' on a day in a zone."""
    hours, minutes = clock.split(":")
    local = F.date_add(day, offset_days).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(int(hours)), F.lit(int(minutes)), F.lit(0))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
