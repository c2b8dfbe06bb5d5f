"""Order within large groups without a window over a whole group: rows are dealt by ranges, and what one range passes on to the next is a few numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import cut

#: Slices of groups (a range's rows of one group) up to which their table is broadcast; more are joined by shuffle.
MOST_SLICES = 100_000
#: Rows of a stretch in which neighbours are looked up.
STRETCH = 1 << 16


def _spread(rows: DataFrame, slices: DataFrame, on: list[str]) -> DataFrame:
    small = slices.count() <= MOST_SLICES
    return rows.join(F.broadcast(slices) if small else slices, on)


def ranged(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The rows in ranges of (``by``, ``order``): ``_b`` rises from range to range and ``_m`` from row to row. Written once, so that the ranges stay as they are. ``by`` must not be null."""
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    return cut(dealt.withColumns({"_b": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))


def placed(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "_pos") -> DataFrame:
    """Adds the place of each row in its group from 0; ``order`` should tell rows apart, else equal ones are numbered as they come."""
    dealt = ranged(rows, by, order)
    slices = dealt.groupBy(*by, "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    line = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*by, "_b", "_first", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    return _spread(dealt, slices, [*by, "_b"]).withColumn(name, F.col("_before") + F.col("_m") - F.col("_first")).select(*rows.columns, name)


def running_max_before(rows: DataFrame, by: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """Adds the largest ``value`` of the rows before each row of its group; null for the first."""
    dealt = ranged(rows, by, order)
    slices = dealt.groupBy(*by, "_b").agg(F.max(value).alias("_top"))
    carried = slices.select(*by, "_b", F.max("_top").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = F.max(value).over(Window.partitionBy(*by, "_b").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1))
    return _spread(dealt, carried, [*by, "_b"]).withColumn(name, F.greatest(inside, F.col("_carried"))).select(*rows.columns, name)


def with_lags(rows: DataFrame, by: list[str], order: list[str | Column], value: str, lags: int, name: str = "_l") -> DataFrame:
    """Adds ``<name>1`` .. ``<name><lags>``: the value so many rows before. The last rows of a stretch also go to the next one."""
    if lags < 1:
        return rows
    at = placed(rows, by, order).withColumn("_s", F.expr(f"_pos div {STRETCH}"))
    edge = F.col("_pos") % STRETCH >= STRETCH - lags
    both = at.withColumn("_own", F.lit(True)).unionByName(at.where(edge).withColumns({"_s": F.col("_s") + 1, "_own": F.lit(False)}))
    line = Window.partitionBy(*by, "_s").orderBy("_pos")
    return both.select("*", *(F.lag(value, k).over(line).alias(f"{name}{k}") for k in range(1, lags + 1))).where("_own").drop("_own", "_s", "_pos")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of the non-null values of each group, interpolated between neighbours: the rows at two places for each share are picked from the ordered ranges."""
    given = placed(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), by, ["_v"])
    sizes = cut(given.groupBy(*by).agg((F.max("_pos") + 1).alias("_size")))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("q"), (F.lit(p) * (F.col("_size") - 1)).alias("x")) for name, p in shares.items())))
    places = sizes.select(*by, wanted.alias("_w")).select(*by, "_w.q", "_w.x", F.explode(F.array_distinct(F.array(F.floor("_w.x"), F.ceil("_w.x")))).alias("_pos"))
    picked = _spread(given, places, [*by, "_pos"]).groupBy(*by, "q", "x").agg(F.min_by("_v", "_pos").alias("_low"), F.max_by("_v", "_pos").alias("_high"))
    at = picked.withColumn("_q", F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("x") - F.floor("x")))
    return at.groupBy(*by).agg(*(F.max(F.when(F.col("q") == name, F.col("_q"))).alias(name) for name in shares))
