"""Walk-forward linear models from sufficient statistics.

A fold's rows are aggregated once into a Gram matrix (one shuffle of some hundred numbers a map task). Every model of the fold comes from it:
each penalty, every set of columns left out, and the mean squared error of a validation or test year, without another pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAT = 1e-18


def folds(rows: DataFrame, day: str, end: str, burn_in: int = 6) -> DataFrame:
    """Role of each row in each test year's fold, purged: no target reaches into the next part.

    train: the target ends before the validation year; validation: the day is in the year before the test year and the target ends in it; fit: the target ends
    before the test year; test: the day is in the test year and the target ends in it. ``rows`` gets (year, role); a row can have several roles.
    """
    years = rows.agg(F.min(F.year(day)).alias("lo"), F.max(F.year(day)).alias("hi")).where("lo is not null").select(F.explode(F.when(F.col("lo") + burn_in <= F.col("hi"), F.sequence(F.col("lo") + burn_in, F.col("hi"))).otherwise(F.array().cast("array<int>"))).alias("year"))
    first, before, last = F.make_date("year", F.lit(1), F.lit(1)), F.make_date(F.col("year") - 1, F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))
    d, e = F.col(day), F.col(end)
    roles = F.array(
        F.when(e < before, "train"), F.when((F.year(day) == F.col("year") - 1) & (e < first), "validation"), F.when(e < first, "fit"), F.when((F.year(day) == F.col("year")) & (e <= last), "test"))
    joined = rows.where(e.isNotNull() & d.isNotNull()).join(F.broadcast(years), F.year(day) <= F.col("year"))
    return joined.select("*", F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("role"))


def gram(rows: DataFrame, by: list[str], features: Sequence[str], target: str) -> DataFrame:
    """n, and the sums and products of the columns 1, features, target, of each group: an upper triangle in one array. Complete rows only."""
    columns = [F.lit(1.0), *(F.col(c) for c in features), F.col(target)]
    parts = [F.sum(columns[i] * columns[j]) for i in range(len(columns)) for j in range(i, len(columns))]
    return rows.dropna(subset=[*features, target]).groupBy(*by).agg(F.count("*").alias("n"), F.array(*parts).alias("gram"))


def full_matrix(flat: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = flat
    return out + np.triu(out, 1).T


class Moments:
    """Means, population scales and standardised products of one group's Gram matrix."""

    def __init__(self, flat: Sequence[float], k: int):
        g = full_matrix(flat, k)
        self.g, self.n = g, g[0, 0]
        self.mean = g[0] / self.n
        centred = g / self.n - np.outer(self.mean, self.mean)
        self.cov = centred
        var = np.diag(centred).copy()
        self.scale = np.where(var <= FLAT, 1.0, np.sqrt(np.maximum(var, FLAT)))


def ridge(m: Moments, use: Sequence[int], penalty: float) -> np.ndarray:
    """Coefficients on the raw columns (intercept first, unused ones 0): standardised by the training rows, the intercept free, the penalty on the raw Gram matrix."""
    k = len(m.mean)
    use = list(use)
    z = m.n * m.cov[np.ix_(use, use)] / np.outer(m.scale[use], m.scale[use])
    w = np.linalg.solve(z + penalty * np.eye(len(use)), m.n * m.cov[use, k - 1] / m.scale[use]) if use else np.empty(0)
    out = np.zeros(k - 1)
    out[use] = w / m.scale[use]
    out[0] = m.mean[k - 1] - out[1:] @ m.mean[1 : k - 1]
    return out


def elastic_net(m: Moments, use: Sequence[int], alpha: float, l1_ratio: float, rounds: int = 20000, tolerance: float = 1e-8) -> np.ndarray:
    """Cyclic coordinate descent on the standardised Gram matrix for 1/(2n) |y - Xw|^2 + alpha (l1 |w|_1 + (1 - l1)/2 |w|^2). Not converging is an error."""
    k = len(m.mean)
    use = list(use)
    q = m.cov[np.ix_(use, use)] / np.outer(m.scale[use], m.scale[use])
    b = m.cov[use, k - 1] / m.scale[use]
    w = np.zeros(len(use))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(use)):
            part = b[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(part) * max(abs(part) - alpha * l1_ratio, 0.0) / (q[j, j] + alpha * (1 - l1_ratio)) if q[j, j] > FLAT else 0.0
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tolerance:
            out = np.zeros(k - 1)
            out[use] = w / m.scale[use]
            out[0] = m.mean[k - 1] - out[1:] @ m.mean[1 : k - 1]
            return out
    raise ValueError("coordinate descent did not converge")


def mse(g: np.ndarray, coefficients: np.ndarray) -> float:
    """Mean squared error of a model over the rows behind a Gram matrix."""
    v = np.append(-coefficients, 1.0)
    return float(v @ g @ v / g[0, 0])


def choose(train: Moments, validation: np.ndarray, fits: list[tuple[float, np.ndarray]], stronger: bool = False) -> float:
    """The penalty of the least validation error; on a tie the first, or the stronger one."""
    scored = [(mse(validation, c), -p if stronger else i, p) for i, (p, c) in enumerate(fits)]
    return min(scored)[2]


def first_component(m: Moments, use: Sequence[int]) -> tuple[np.ndarray, float]:
    """First principal component of the columns' correlations and its share; the sign makes the loadings' sum positive, else the largest one."""
    use = list(use)
    c = m.cov[np.ix_(use, use)] / np.outer(m.scale[use], m.scale[use])
    values, vectors = np.linalg.eigh(c)
    v = vectors[:, -1]
    lead = v.sum() if abs(v.sum()) > 1e-12 else v[np.argmax(np.abs(v))]
    return (v if lead > 0 else -v), float(values[-1] / max(np.trace(c), FLAT))


def states(m: Moments, blocks: dict[str, Sequence[int]]) -> np.ndarray:
    """Matrix that maps (1, columns, target) to (1, first component of each block's standardised columns, target)."""
    k = len(m.mean)
    out = np.zeros((len(blocks) + 2, k))
    out[0, 0] = out[-1, -1] = 1.0
    for i, use in enumerate(blocks.values(), 1):
        v, _ = first_component(m, use)
        out[i, list(use)] = v / m.scale[list(use)]
        out[i, 0] = -(v / m.scale[list(use)]) @ m.mean[list(use)]
    return out


def block_states(stats: DataFrame, features: Sequence[str], blocks: dict[str, Sequence[str]], penalties: Sequence[float], minimum: tuple[int, int, int] = (750, 100, 40)) -> DataFrame:
    """Walk-forward ridge on the blocks' first components. Components for the choice of the penalty come from the training rows, those of the forecast from the fit rows; each is a
    linear map, so the states' Gram matrices follow from the columns' ones."""
    k = len(features) + 2
    places = {b: [features.index(c) + 1 for c in own] for b, own in blocks.items()}
    leave_out(features, blocks)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {r.role: full_matrix(np.asarray(r.gram), k) for r in pdf.itertuples()}
        sizes = {r.role: r.n for r in pdf.itertuples()}
        rows = []
        if {"train", "validation", "fit", "test"} <= parts.keys() and sizes["fit"] >= minimum[0] and sizes["validation"] >= minimum[1] and sizes["test"] >= minimum[2]:
            flat = lambda g: g[np.triu_indices(len(g))]
            use = list(range(1, len(blocks) + 1))
            first = states(Moments(flat(parts["train"]), k), places)
            train = Moments(flat(first @ parts["train"] @ first.T), len(first))
            best = choose(train, first @ parts["validation"] @ first.T, [(p, ridge(train, use, p)) for p in penalties], stronger=True)
            raw = Moments(flat(parts["fit"]), k)
            final = states(raw, places)
            fit = Moments(flat(final @ parts["fit"] @ final.T), len(final))
            test = final @ parts["test"] @ final.T
            c, mean = ridge(fit, use, best), np.zeros(len(blocks) + 1)
            mean[0] = fit.mean[-1]
            for name, own in places.items():
                rows.append((*key, name, float(best), first_component(raw, own)[1], float(c[1 + list(places).index(name)]), int(sizes["test"]), mse(test, c), mse(test, mean)))
        return pd.DataFrame(rows, columns=["target", "year", "block", "penalty", "explained", "coefficient", "n_test", "mse", "mse_mean"])

    return stats.groupBy("target", "year").applyInPandas(solve, "target string, year int, block string, penalty double, explained double, coefficient double, n_test long, mse double, mse_mean double")


def walk_forward(stats: DataFrame, features: Sequence[str], penalties: Sequence[float], variants: dict[str, Sequence[str]] | None = None, kind: str = "ridge", l1_ratios: Sequence[float] = (0.5,), minimum: tuple[int, int, int] = (750, 100, 40), stronger: bool | None = None, keys: Sequence[str] = ("target", "year"), details: bool = False, least: str = "fit") -> DataFrame:
    """Fits each variant (name: its features; 'full' always) in each fold and scores it on the test year.

    ``stats``: (``keys``, role, n, gram), one row for each fold and role. Folds below the minimum sizes of ``least`` (fit or train), validation and test are left out. Of penalties with equal validation errors
    the elastic net takes the stronger one (a larger penalty, then a larger L1 share), the ridge the first, or with ``stronger`` the stronger one. Returns the keys, variant, penalty, coefficients,
    n_test, mse, mse_mean (historical mean), mse_zero; with ``details`` also ``selection``, the coefficients that the training rows gave under the chosen penalty, and ``scales``, the columns' deviations among the fit rows.
    """
    k = len(features) + 2
    stronger = kind == "elastic_net" if stronger is None else stronger
    places = {c: i + 1 for i, c in enumerate(features)}
    every = {"full": list(features), **(variants or {})}
    grid = [(p, r) for p in sorted(penalties) for r in (sorted(l1_ratios) if kind == "elastic_net" else (0.0,))]

    def fit(m: Moments, use: list[int], p: float, r: float) -> np.ndarray:
        return ridge(m, use, p) if kind == "ridge" else elastic_net(m, use, p, r)

    def solve(key: tuple, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        parts = {r.role: np.asarray(r.gram) for r in pdf.itertuples()}
        sizes = {r.role: r.n for r in pdf.itertuples()}
        rows = []
        if {"train", "validation", "fit", "test"} <= parts.keys() and sizes[least] >= minimum[0] and sizes["validation"] >= minimum[1] and sizes["test"] >= minimum[2]:
            train, final = Moments(parts["train"], k), Moments(parts["fit"], k)
            check, test = full_matrix(parts["validation"], k), full_matrix(parts["test"], k)
            mean, zero = np.zeros(k - 1), np.zeros(k - 1)
            mean[0] = final.mean[k - 1]
            for name, own in every.items():
                use = [places[c] for c in own]
                tried = [fit(train, use, p, r) for p, r in grid]
                best = int(choose(train, check, list(enumerate(tried)), stronger))
                c = fit(final, use, *grid[best])
                more = (tried[best].tolist(), final.scale[1:-1].tolist()) if details else ()
                rows.append((*key, name, float(grid[best][0]), float(grid[best][1]), c.tolist(), int(sizes["test"]), mse(test, c), mse(test, mean), mse(test, zero), *more))
        return pd.DataFrame(rows, columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in stats.schema}
    names = [*keys, "variant", "penalty", "l1_ratio", "coefficients", "n_test", "mse", "mse_mean", "mse_zero", *(["selection", "scales"] if details else [])]
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", variant string, penalty double, l1_ratio double, coefficients array<double>, n_test long, mse double, mse_mean double, mse_zero double"
    return stats.groupBy(*keys).applyInPandas(solve, schema + ", selection array<double>, scales array<double>" * details)


def predict(rows: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str] = ("year",)) -> DataFrame:
    """Adds ``prediction`` to the rows of each model's fold (``by``): a sum of products, in the JVM."""
    joined = rows.join(F.broadcast(models.select(*by, "variant", "coefficients")), list(by))
    value = F.get("coefficients", F.lit(0))
    for i, c in enumerate(features):
        value = value + F.get("coefficients", F.lit(i + 1)) * F.col(c)
    return joined.withColumn("prediction", value)


def leave_out(features: Sequence[str], blocks: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Variants for an ablation: all features but those of one block."""
    known = [c for b in blocks.values() for c in b]
    if sorted(known) != sorted(features):
        raise ValueError("blocks must partition the features")
    return {f"without_{name}": [c for c in features if c not in set(members)] for name, members in blocks.items()}


def anchored(child: DataFrame, parent: DataFrame, on: list[str], column: str, tolerance: float = 1e-9) -> DataFrame:
    """``column`` of both tables and their difference. A key that only one of them has, or a difference over the tolerance, ends the job."""
    both = child.select(*on, F.col(column).alias("child")).join(parent.select(*on, F.col(column).alias("parent")), on, "full_outer")
    gap = F.abs(F.col("child") - F.col("parent"))
    return both.select(*on, "child", "parent", F.when(gap <= tolerance, gap).otherwise(F.raise_error("differs from its parent").cast("double")).alias("difference"))
