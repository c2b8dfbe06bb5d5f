"""Interaction and regime models over walk-forward folds.

A product of two features is one more column of the Gram matrix, which then holds moments up to the fourth degree. So the base model, one model for each term, the joint model and every
model without one feature follow from a single aggregation of the rows; regimes add a key to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import FLAT, sign_test
from . import inference, linear

KEYS = ["target", "year"]
#: (name of the regime, feature that tells it, threshold, level above it, level at or below it)
Regime = tuple[str, str, float, str, str]


def with_terms(rows: DataFrame, terms: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows with a column ``term__<name>`` for each product of two columns."""
    return rows.withColumns({f"term__{name}": F.col(a) * F.col(b) for name, (a, b) in terms.items()})


def variants(features: Sequence[str], terms: dict[str, tuple[str, str]]) -> dict[str, list[str]]:
    """The features of every model: baseline, one for each term, one without each feature. The joint model is walk_forward's 'full'."""
    own = {"baseline": list(features)} | {f"term__{t}": [*features, f"term__{t}"] for t in terms}
    return own | {f"loo__{c}": [x for x in features if x != c] for c in features}


def interaction_models(stats: DataFrame, features: Sequence[str], terms: dict[str, tuple[str, str]], penalties: Sequence[float], minimum: tuple[int, int, int]) -> DataFrame:
    """Every model of every fold (see ``linear.walk_forward``); 'full' is called joint. ``stats`` are Gram matrices over the features, then the terms in order."""
    columns = [*features, *(f"term__{t}" for t in terms)]
    models = linear.walk_forward(stats, columns, penalties, variants(features, terms), minimum=minimum, least="train")
    return models.withColumn("variant", F.when(F.col("variant") == "full", "joint").otherwise(F.col("variant")))


def paired(models: DataFrame, family: int, reps: int, alpha: float = 0.05) -> DataFrame:
    """Each variant's yearly errors against the baseline's: ``target variant delta low high folds in_favour p threshold significant``.

    A term or the joint model is favoured in a year in which its error is smaller, a model without a feature in one in which it is larger: that feature was worth having. The interval is a bootstrap
    over years, p the two-sided sign test, and the threshold alpha over the family's size.
    """
    base = models.where("variant = 'baseline'").select(*KEYS, F.col("mse").alias("_base"))
    delta = models.where("variant <> 'baseline'").join(base, KEYS).withColumn("delta", F.col("mse") - F.col("_base"))
    without = F.col("variant").startswith("loo__")
    counted = delta.groupBy("target", "variant").agg(F.count("*").alias("folds"), F.count_if(F.when(without, F.col("delta") > 0).otherwise(F.col("delta") < 0)).alias("in_favour"))
    interval = inference.bootstrap_mean(delta, ["target", "variant"], ["year"], "delta", reps).select("target", "variant", F.col("mean").alias("delta"), "low", "high")
    out = interval.join(counted, ["target", "variant"]).withColumn("p", sign_test(F.col("in_favour"), F.col("folds")))
    return out.withColumns({"threshold": F.lit(alpha / family), "significant": F.col("p") < alpha / family})


def marginal_correlations(stats: DataFrame, models: DataFrame, features: Sequence[str], width: int) -> DataFrame:
    """Correlation of each feature with the target over all test rows: ``target feature n r``, from the test years' Gram matrices. A diagnosis, not a choice of features.

    ``width`` is the number of columns in the matrices, the constant and the target among them; r is null on a constant side or with fewer than three rows.
    """
    fitted = models.select(*KEYS).distinct()
    test = stats.where("role = 'test'").join(fitted, KEYS)
    place = lambda i, j: i * width - i * (i - 1) // 2 + j - i
    last = width - 1
    each = F.array(*(F.struct(F.lit(c).alias("feature"), *(F.get("gram", F.lit(place(*at))).alias(name) for name, at in (("x", (0, i)), ("y", (0, last)), ("xx", (i, i)), ("xy", (i, last)), ("yy", (last, last))))) for i, c in enumerate(features, 1)))
    sums = test.select("target", "n", F.explode(each).alias("e")).groupBy("target", F.col("e.feature").alias("feature")).agg(F.sum("n").alias("n"), *(F.sum(f"e.{c}").alias(c) for c in ("x", "y", "xx", "xy", "yy")))
    n = F.col("n")

    def spread(a: str, b: str, ab: str) -> Column:
        return F.col(ab) / n - F.col(a) / n * F.col(b) / n

    vx, vy = spread("x", "x", "xx"), spread("y", "y", "yy")
    return sums.select("target", "feature", "n", F.when((n >= 3) & (vx > FLAT) & (vy > FLAT), spread("x", "y", "xy") / F.sqrt(vx * vy)).alias("r"))


def with_regimes(folds: DataFrame, regimes: Sequence[Regime]) -> DataFrame:
    """Each row once for every regime, with ``regime`` and ``level``."""
    levels = F.array(*(F.struct(F.lit(name).alias("regime"), F.when(F.col(c) > threshold, above).otherwise(below).alias("level")) for name, c, threshold, above, below in regimes))
    return folds.withColumn("_r", F.explode(levels)).select(*folds.columns, "_r.*")


def regime_models(folds: DataFrame, features: Sequence[str], regimes: Sequence[Regime], penalties: Sequence[float], minimum: tuple[int, int, int]) -> DataFrame:
    """The features' model refitted inside each regime level of each fold, with the mean of the level's fit rows as its baseline."""
    keys = ["target", "regime", "level", "year"]
    stats = linear.gram(with_regimes(folds, regimes), [*keys, "role"], features, "y")
    return linear.walk_forward(stats, features, penalties, minimum=minimum, keys=keys, details=True, least="train")


def regime_summary(models: DataFrame, folds: DataFrame, features: Sequence[str], regimes: Sequence[Regime]) -> DataFrame:
    """``target regime level folds skipped_folds n_test mse mse_mean skill coefficients``: means over the level's folds; coefficients are those on standardised columns, by feature.

    Skipped are years of the target whose level had too few rows; a level without any fold stays, with nulls.
    """
    years = folds.groupBy("target").agg(F.count_distinct("year").alias("_years"))
    levels = F.array(*(F.struct(F.lit(r[0]).alias("regime"), F.lit(level).alias("level")) for r in regimes for level in r[3:]))
    every = years.withColumn("_l", F.explode(levels)).select("target", "_l.*", "_years")
    scaled = F.zip_with(F.slice("coefficients", 2, len(features)), F.col("scales"), lambda c, s: c * s)
    means = [F.avg(F.get("_c", F.lit(i))).alias(f"_c{i}") for i in range(len(features))]
    own = models.withColumn("_c", scaled).groupBy("target", "regime", "level").agg(F.count("*").alias("folds"), F.sum("n_test").alias("n_test"), F.avg("mse").alias("mse"), F.avg("mse_mean").alias("mse_mean"), *means)
    out = every.join(own, ["target", "regime", "level"], "left")
    named = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("coefficient")) for i, c in enumerate(features)))
    folds_ = F.coalesce("folds", F.lit(0).cast("long"))
    return out.select("target", "regime", "level", folds_.alias("folds"), (F.col("_years") - folds_).alias("skipped_folds"), F.coalesce("n_test", F.lit(0).cast("long")).alias("n_test"), "mse", "mse_mean", (1 - F.col("mse") / F.col("mse_mean")).alias("skill"), F.when(F.col("folds").isNotNull(), named).alias("coefficients"))
