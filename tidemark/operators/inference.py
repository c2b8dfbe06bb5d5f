"""Tests and resampling: HAC means, multiple testing, sign tests, bootstraps and permutations with hashed randomness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import cut
from ..functions.columns import erfc
from . import ordered


def hac_mean(rows: DataFrame, by: list[str], order: list[str], value: str, lags: int) -> DataFrame:
    """Mean of each group with its Newey-West standard error (Bartlett weights, autocovariances over n), t and two-sided p."""
    given = cut(rows.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("_v")))
    means = given.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    # groups are a few or each is small; either way their means are no more than a row each
    centred = ordered.with_lags(given.join(means, by).withColumn("_e", F.col("_v") - F.col("mean")), by, order, "_e", lags)
    products = [F.sum(F.col("_e") * F.col("_e")).alias("_g0")]
    products += [F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"_g{k}") for k in range(1, lags + 1)]
    out = centred.groupBy(*by, "n", "mean").agg(*products)
    long_run = F.col("_g0") / F.col("n")
    for k in range(1, lags + 1):
        long_run = long_run + 2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) / F.col("n")
    out = out.withColumn("se", F.when((F.col("n") > lags + 1) & (long_run > 0), F.sqrt(long_run / F.col("n"))))
    out = out.withColumn("t", F.col("mean") / F.col("se"))
    return out.withColumn("p", erfc(F.abs("t") / F.sqrt(F.lit(2.0)))).select(*by, "n", "mean", "se", "t", "p")


def benjamini_hochberg(rows: DataFrame, p: str, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds the step-up adjusted ``q`` of the non-null p values of each family."""
    by = by or []
    family = Window.partitionBy(*(by or [F.lit(0)]))
    rank = F.row_number().over(family.orderBy(F.asc_nulls_last(p), *key))
    ranked = rows.withColumn("_k", rank).withColumn("_m", F.count(p).over(family))
    step = F.when(F.col(p).isNotNull(), F.col(p) * F.col("_m") / F.col("_k"))
    q = F.least(F.lit(1.0), F.min(step).over(family.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn("q", F.when(F.col(p).isNotNull(), q)).drop("_k", "_m")


def bonferroni(p: Column, family: int) -> Column:
    return F.least(F.lit(1.0), p * family)


def _draw(seed: int, *parts: Column) -> Column:
    """A hash that stands for a random number: the same on every machine and however the data are partitioned."""
    return F.xxhash64(F.lit(seed), *parts)


#: Cumulative chances of a Poisson number of mean 1, and rows whose weights are drawn at once.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))
AT_ONCE = 512


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def poisson_weights(hashes: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """How often each replicate (column) counts each row: Poisson numbers of mean 1 from the row's hash, the replicate and the seed."""
    salt = _mixed(np.arange(reps, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    u = (_mixed(hashes.astype(np.uint64)[:, None] ^ salt[None, :]) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, u, side="right")


def _replicate_sums(rows: DataFrame, by: list[str], reps: int, seed: int) -> DataFrame:
    """(``by``, _r, _t, _c): what each task's rows (``_q``, ``_h``) add to every replicate of their group: a row for each group and replicate of a task, however many rows it has."""
    kinds = {f.name: f for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            q, h = batch.column("_q").to_numpy(), batch.column("_h").to_numpy().view(np.uint64)
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            group = np.fromiter((names[k] for k in keys), np.int64, len(keys))
            for k, i in names.items():
                own = np.flatnonzero(group == i)
                sums = held.setdefault(k, np.zeros((2, reps), np.int64))
                for at in range(0, len(own), AT_ONCE):
                    part = own[at : at + AT_ONCE]
                    w = poisson_weights(h[part], reps, seed)
                    sums[0] += q[part] @ w
                    sums[1] += w.sum(axis=0)
        for k, sums in held.items():
            columns = [pa.array([x] * reps, batch.schema.field(c).type) for x, c in zip(k, by, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(reps, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], [*by, "_r", "_t", "_c"])

    schema = "".join(f"`{c}` {kinds[c].dataType.simpleString()}, " for c in by) + "_r int, _t long, _c long"
    return rows.mapInArrow(run, schema)


def bootstrap_mean(rows: DataFrame, by: list[str], order: list[str], value: str, reps: int = 1000, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean of each group: resampled means in order, those at 2.5 % and 97.5 %.

    A replicate counts each row a Poisson number of times (mean 1), hashed from the seed, the replicate and ``order``, which must tell the
    rows of a group apart. So no group is ever in one place: tasks send sums for each group and replicate. The sums are whole numbers at a scale of
    the group, thus the same in any order of the rows. Replicates without any row (only in groups of a few) are left out, as are null values.
    """
    given = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), _draw(seed, *(F.col(c) for c in order)).alias("_h"))
    exact = given.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.max(F.abs("_v")).alias("_top"))
    bits = F.when(F.col("_top") > 0, F.lit(59) - F.ceil(F.log2(F.col("_top")) + F.log2(F.col("n"))))
    exact = exact.select(*by, "n", "mean", F.pow(F.lit(2.0), F.coalesce(F.least(bits, F.lit(1000)), F.lit(0)).cast("double")).alias("_scale"))
    whole = given.join(exact, by)
    scaled = whole.select(*by, F.round(F.col("_v") * F.col("_scale")).cast("long").alias("_q"), "_h")
    sums = _replicate_sums(scaled, by, reps, seed).groupBy(*by, "_r").agg(F.sum("_t").alias("_t"), F.sum("_c").alias("_c")).where("_c > 0")
    means = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.col("_t") / F.col("_c"))).alias("_m"))
    size = F.size("_m")
    low, high = F.greatest(F.floor(size * 0.025).cast("int") - 1, F.lit(0)), F.greatest(F.floor(size * 0.975).cast("int") - 1, F.lit(0))
    return exact.join(means, by, "left").select(*by, "n", "mean", (F.get("_m", low) / F.col("_scale")).alias("low"), (F.get("_m", high) / F.col("_scale")).alias("high"))


def permuted(rows: DataFrame, by: list[str], key: str, columns: list[str], reps: int, seed: int = 7) -> DataFrame:
    """Each group's ``columns`` shuffled jointly within the group, ``reps`` times: key, rep and ``<column>_permuted``."""
    many = rows.select(*by, key, *columns, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    group = Window.partitionBy(*by, "rep")
    given = many.withColumn("_i", F.row_number().over(group.orderBy(key)))
    taken = many.withColumn("_i", F.row_number().over(group.orderBy(_draw(seed, F.col("rep"), F.col(key)), key))).select(*by, "rep", "_i", *(F.col(c).alias(f"{c}_permuted") for c in columns))
    return given.join(taken, [*by, "rep", "_i"]).drop("_i")


def block_bootstrap_p(pairs: DataFrame, by: list[str], order: str, x: str, y: str, reps: int = 200, block: int = 20, seed: int = 7, least: int = 30) -> DataFrame:
    """p of a correlation by a circular moving-block bootstrap of the regression's residuals under slope zero: (exceedances + 1) / (reps + 1).

    The residuals of y on x are drawn in blocks and correlated with x; a constant added to them (the intercept) changes no correlation. p is null
    with fewer than ``least`` rows or where x or y is constant.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    whole = pairs.groupBy(*by).agg(F.count("*").cast("int").alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("_b"))
    numbered = pairs.select(*by, place.alias("i"), F.col(x).alias("_x"), F.col(y).alias("_y")).join(whole, by).withColumn("_e", F.col("_y") - F.col("_b") * F.col("_x"))
    rows = numbered.where((F.col("n") >= least) & F.col("r").isNotNull()).select(*by, "n", "i", "_x", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    start = F.pmod(_draw(seed, F.col("rep"), F.expr(f"i div {block}")), F.col("n"))
    drawn = rows.select(*by, "rep", "_x", F.pmod(start + F.col("i") % block, F.col("n")).cast("int").alias("_j"))
    shaken = drawn.join(numbered.select(*by, F.col("i").alias("_j"), "_e"), [*by, "_j"])
    spread = F.stddev_pop("_x") * F.stddev_pop("_e")
    each = shaken.groupBy(*by, "rep").agg((F.covar_pop("_x", "_e") / F.nullif(spread, F.lit(0.0))).alias("_rr"))
    counted = each.join(whole.select(*by, "r"), by).groupBy(*by).agg(((F.count_if(F.abs("_rr") >= F.abs("r")) + 1) / (F.count("*") + 1)).alias("p"))
    return whole.join(counted, by, "left").select(*by, "n", "r", "p")
