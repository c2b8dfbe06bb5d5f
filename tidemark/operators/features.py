"""Features on a grid: every function takes the window that orders a series and returns a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import FLAT


def zscore(x: Column, line: WindowSpec, n: int) -> Column:
    """Population z-score over the last n rows, the own included; null until n values are there, 0 on a constant stretch."""
    last = line.rowsBetween(-(n - 1), 0)
    var = F.var_pop(x).over(last)
    full = F.count(x).over(last) == n
    return F.when(full, F.when(var <= FLAT, 0.0).otherwise((x - F.avg(x).over(last)) / F.nullif(F.sqrt(var), F.lit(0.0))))


def log_return(x: Column, line: WindowSpec, k: int) -> Column:
    """ln(x / x k rows ago); null where either is not positive."""
    before = F.lag(x, k).over(line)
    return F.when((x > 0) & (before > 0), F.log(x / F.nullif(before, F.lit(0.0))))


def asinh_change(x: Column, line: WindowSpec, k: int, scale: float = 20.0) -> Column:
    """Change of asinh(x / scale): behaves like a log return but allows prices at and below zero."""
    return F.asinh(x / scale) - F.asinh(F.lag(x, k).over(line) / scale)


def standardise(x: Column, whole: WindowSpec) -> Column:
    """(x - mean) / population sd over the whole series; null on a constant one."""
    sd = F.stddev_pop(x).over(whole)
    return (x - F.avg(x).over(whole)) / F.when(sd * sd > FLAT, sd)


def forward_targets(df: DataFrame, price: str, date: str, line: WindowSpec, horizons: tuple[int, ...] = (1, 5, 20, 60)) -> DataFrame:
    """Log return to the h-th next row, with the dates where it starts and ends."""
    for h in horizons:
        df = df.withColumns({f"target_return_{h}d": F.log(F.lead(price, h).over(line) / F.col(price)), f"target_end_{h}d": F.lead(date, h).over(line)})
    return df.withColumn("target_start", F.lead(date, 1).over(line))


def ema(df: DataFrame, by: str, order: str, value: str, half_life: float, name: str, bucket: Callable[[Column], Column]) -> DataFrame:
    """Exponential memory m0 = x0, m = p m + (1 - p) x, p = 2 ** (-1 / half_life), by series; rows without a value are left out.

    Rows are numbered in stretches of ``bucket`` (of ``order``; it must not fall as that rises) and cut into blocks. Within a block the recursion is a
    running sum of x / p**j. What a block adds and how far it decays make one row; only these rows are walked through in order, as a stream.
    """
    log_p = -1.0 / half_life  # powers of two
    block = max(1, min(256, int(500 * half_life)))  # so that 1 / p**j stays a double
    stretch = Window.partitionBy(by, "_b").orderBy(order)
    rows = df.where(F.col(value).isNotNull()).select(by, order, value, bucket(F.col(order)).alias("_b")).withColumn("_j", F.row_number().over(stretch) - 1)
    rows = rows.select(by, order, value, "_b", F.expr(f"int(_j div {block})").alias("_k"), (F.col("_j") % block).alias("_j"))
    inside = Window.partitionBy(by, "_b", "_k").orderBy("_j")
    rows = rows.withColumn("_sum", F.sum(F.col(value) * F.pow(F.lit(2.0), -log_p * F.col("_j")) * (1 - 2.0**log_p)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_own", F.col("_sum") * F.pow(F.lit(2.0), log_p * F.col("_j")))
    blocks = rows.groupBy(by, "_b", "_k").agg(F.max_by("_own", "_j").alias("_own"), F.pow(F.lit(2.0), log_p * F.count("*")).alias("_decay"), F.min_by(value, "_j").alias("_first"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, memory = None, 0.0
        for frame in frames:
            before = []
            for key, own, decay, first in zip(frame[by], frame["_own"], frame["_decay"], frame["_first"], strict=True):
                if series is None or key != series:  # m0 = x0: as if the memory had been x0 all along
                    series, memory = key, float(first)
                before.append(memory)
                memory = own + decay * memory
            yield frame[[by, "_b", "_k"]].assign(_before=before)

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    carried = blocks.repartition(by).sortWithinPartitions(by, "_b", "_k").mapInPandas(walk, f"`{by}` {kinds[by]}, _b {kinds['_b']}, _k int, _before double")
    memory = F.col("_own") + F.col("_before") * F.pow(F.lit(2.0), log_p * (F.col("_j") + 1))
    return rows.join(carried, [by, "_b", "_k"]).select(by, order, value, memory.alias(name))


def trimmed(df: DataFrame, by: list[str], order: str, warmup: int, tail: int) -> DataFrame:
    """Without the first and last rows of each series."""
    line = Window.partitionBy(*by).orderBy(order)
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("_i", F.row_number().over(line)).withColumn("_n", n).where((F.col("_i") > warmup) & (F.col("_i") <= F.col("_n") - tail)).drop("_i", "_n")
