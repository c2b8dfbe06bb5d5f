"""Boosted regression trees for walk-forward folds: every setting of every fold is a task of its own.

Trees are grown leaf by leaf on binned columns. A fold's rows are the days of one calendar, so they fit one task whatever lies behind the days.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Setting(NamedTuple):
    rate: float
    leaves: int
    l2: float


GRID = tuple(Setting(*x) for x in product((0.03, 0.06), (7, 15), (0.1, 1.0)))
ROUNDS, LEAST, BINS = 200, 30, 63


def edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of each column's bins but the last: its quantiles, without repeats."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(ends, x.T, strict=True)], axis=1)


class Tree(NamedTuple):
    splits: list[tuple[int, int, int]]  # leaf that is split, column, last bin that stays; what goes is the next new leaf
    values: np.ndarray

    def leaf_of(self, b: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(b), dtype=np.int64)
        for new, (old, column, last) in enumerate(self.splits, 1):
            leaf[(leaf == old) & (b[:, column] > last)] = new
        return leaf

    def predict(self, b: np.ndarray) -> np.ndarray:
        return self.values[self.leaf_of(b)]


def best_split(b: np.ndarray, residual: np.ndarray, l2: float, least: int, bins: int) -> tuple[float, int, int]:
    """Gain, column and bin of the best split of one leaf's rows; the gain is minus infinity where no split leaves ``least`` rows on both sides."""
    n, columns = b.shape
    flat = (b + np.arange(columns) * bins).ravel()
    count = np.bincount(flat, minlength=columns * bins).reshape(columns, bins).cumsum(axis=1)
    total = np.bincount(flat, weights=np.repeat(residual, columns), minlength=columns * bins).reshape(columns, bins).cumsum(axis=1)
    rest, whole = n - count, residual.sum()
    gain = total**2 / (count + l2) + (whole - total) ** 2 / (rest + l2) - whole**2 / (n + l2)
    gain[(count < least) | (rest < least)] = -np.inf
    at = int(gain.argmax())
    return float(gain.flat[at]), at // bins, at % bins


def grow(b: np.ndarray, residual: np.ndarray, s: Setting, least: int = LEAST, bins: int = BINS) -> Tree:
    """The leaf with the greatest gain is split next, up to ``s.leaves`` leaves; a leaf's value is its shrunk mean residual times the rate."""
    rows, splits = [np.arange(len(b))], []
    found = [best_split(b, residual, s.l2, least, bins)]
    while len(rows) < s.leaves:
        leaf = max(range(len(rows)), key=lambda i: found[i][0])
        gain, column, last = found[leaf]
        if gain <= 1e-12:
            break
        away = b[rows[leaf], column] > last
        splits.append((leaf, column, last))
        rows.append(rows[leaf][away])
        rows[leaf] = rows[leaf][~away]
        found.append((-np.inf, 0, 0))
        for i in (leaf, len(rows) - 1):
            found[i] = best_split(b[rows[i]], residual[rows[i]], s.l2, least, bins) if len(rows) < s.leaves else found[i]
    return Tree(splits, np.array([s.rate * residual[r].sum() / (len(r) + s.l2) for r in rows]))


def boost(x: np.ndarray, y: np.ndarray, other: np.ndarray, s: Setting, rounds: int = ROUNDS, least: int = LEAST) -> np.ndarray:
    """Predictions for the rows of ``other`` of trees fitted to (x, y) by squared error."""
    ends = edges(x)
    b, o = binned(x, ends), binned(other, ends)
    now, out = np.full(len(y), y.mean()), np.full(len(other), y.mean())
    for _ in range(rounds):
        tree = grow(b, y - now, s, least)
        now += tree.predict(b)
        out += tree.predict(o)
    return out


def walk_forward(folds: DataFrame, features: Sequence[str], day: str = "d", minimum: tuple[int, int, int] = (750, 100, 40), grid: Sequence[Setting] = GRID, rounds: int = ROUNDS, least: int = LEAST) -> DataFrame:
    """Predictions (target, year, day, y, prediction, rate, leaves, l2) for each test year, by the setting that errs least on the validation year; on a tie fewer leaves, the lower rate, the greater l2."""
    keys, names = ["target", "year"], list(features)
    counts = folds.groupBy(*keys).agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("train", "validation", "fit", "test")))
    enough = counts.where(f"train > 0 and fit >= {minimum[0]} and validation >= {minimum[1]} and test >= {minimum[2]}").select(*keys)
    rows = folds.join(F.broadcast(enough), keys).select(*keys, "role", day, "y", *names)

    def split(pdf: pd.DataFrame, learn: str, see: str) -> tuple[pd.DataFrame, pd.DataFrame]:
        pdf = pdf.sort_values(day)
        return pdf[pdf.role == learn], pdf[pdf.role == see]

    def tried(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        train, check = split(pdf, "train", "validation")
        p = boost(train[names].to_numpy(), train.y.to_numpy(), check[names].to_numpy(), grid[key[2]], rounds, least)
        return pd.DataFrame([(*key, *grid[key[2]], float(np.mean((check.y.to_numpy() - p) ** 2)))], columns=[*keys, "setting", "rate", "leaves", "l2", "error"])

    each = rows.where("role in ('train', 'validation')").select("*", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("setting"))
    errors = each.repartition(*keys, "setting").groupBy(*keys, "setting").applyInPandas(tried, "target string, year int, setting int, rate double, leaves int, l2 double, error double")
    order = Window.partitionBy(*keys).orderBy("error", "leaves", "rate", F.desc("l2"))
    chosen = errors.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*keys, "setting")

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        s = grid[int(pdf.setting.iloc[0])]
        fit, test = split(pdf, "fit", "test")
        p = boost(fit[names].to_numpy(), fit.y.to_numpy(), test[names].to_numpy(), s, rounds, least)
        return test[[*keys, day, "y"]].assign(prediction=p, rate=s.rate, leaves=s.leaves, l2=s.l2)

    last = rows.where("role in ('fit', 'test')").join(chosen, keys)
    kind = dict(folds.dtypes)[day]
    return last.groupBy(*keys).applyInPandas(final, f"target string, year int, {day} {kind}, y double, prediction double, rate double, leaves int, l2 double")
