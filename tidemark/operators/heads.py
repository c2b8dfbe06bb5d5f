"""A ridge head on wide vectors: three or more classes as one-hot targets, penalty and temperature from a validation part, refit on both.

Sums of outer products are the only pass over the vectors for all fits: each task adds up its rows' blocks of ``BLOCK`` columns square, and a block's sums meet by key. So no task or key ever holds more
than one task's sums or one block of all tasks, whatever the number of rows. The moments of training and validation rows add up to those of the refit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block of the matrix of products.
BLOCK = 256
PENALTIES, TEMPERATURES = (0.1, 1.0, 10.0, 100.0), (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
SCALE_FLOOR = 1e-6


def _vectors(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def outer_sums(rows: DataFrame, vector: str, label: str, classes: int, width: int, by: str, block: int = BLOCK) -> DataFrame:
    """(``by``, i, j, products): blocks of the sums of outer products of (1, one-hot label, vector), the upper triangle of blocks only. Rows whose vector is null or of another width, or whose label is no class, are left out."""
    total = 1 + classes + width
    edges = _edges(total, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _vectors(batch, "v", width), batch.column("y").to_numpy()
            whole = np.concatenate([np.ones((len(x), 1)), np.eye(classes)[y], x], axis=1)
            keys = np.array(batch.column("k").to_pylist())
            for k in np.unique(keys).tolist():
                own = whole[keys == k]
                g = own.T @ own
                held[k] = held[k] + g if k in held else g
        for k, g in held.items():
            for i in range(len(edges) - 1):
                for j in range(i, len(edges) - 1):
                    part = np.ascontiguousarray(g[edges[i] : edges[i + 1], edges[j] : edges[j + 1]])
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "i", "j", "products"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_ = None
        for batch in batches:
            for one in batch.column("products"):
                part = np.frombuffer(one.as_py(), np.float64)
                total_ = part.copy() if total_ is None else total_ + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int32()), pa.array([total_.tobytes()], pa.binary())], ["k", "i", "j", "products"])

    sound = rows.where((F.size(vector) == width) & F.col(label).between(0, classes - 1) & ~F.exists(vector, lambda x: x.isNull()))
    given = sound.select(F.col(by).cast("string").alias("k"), F.col(label).cast("int").alias("y"), F.col(vector).cast("array<double>").alias("v"))
    schema = "k string, i int, j int, products binary"
    return given.mapInArrow(run, schema).groupBy("k", "i", "j").applyInArrow(add, schema)


def _edges(total: int, block: int) -> list[int]:
    return [*range(0, total, block), total]


def _whole(blocks: pd.DataFrame, edges: list[int]) -> np.ndarray:
    total = edges[-1]
    g = np.zeros((total, total))
    for r in blocks.itertuples():
        a, b, c, d = edges[r.i], edges[r.i + 1], edges[r.j], edges[r.j + 1]
        part = np.frombuffer(r.products, np.float64).reshape(b - a, d - c)
        g[a:b, c:d] = part
        g[c:d, a:b] = part.T
    return g


class Moment:
    """Means, scales and standardised products of a sum of outer products of (1, one-hot, vector)."""

    def __init__(self, g: np.ndarray, classes: int):
        self.n = g[0, 0]
        at = 1 + classes
        self.share, self.mean = g[0, 1:at] / self.n, g[0, at:] / self.n
        cov = g[at:, at:] / self.n - np.outer(self.mean, self.mean)
        self.scale = np.sqrt(np.maximum(np.diag(cov), 0.0)) + SCALE_FLOOR
        self.z = self.n * cov / np.outer(self.scale, self.scale)
        self.zy = self.n * (g[at:, 1:at] / self.n - np.outer(self.mean, self.share)) / self.scale[:, None]

    def heads(self, penalties: Sequence[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights on raw vectors, intercepts) for each penalty, from one decomposition."""
        values, vectors = np.linalg.eigh(self.z)
        turned = vectors.T @ self.zy
        out = []
        for penalty in penalties:
            w = vectors @ (turned / (values[:, None] + penalty)) / self.scale[:, None]
            out.append((w, self.share - self.mean @ w))
        return out


@dataclass(frozen=True)
class Head:
    """A fitted head: weights (width x classes), intercepts, the chosen penalty and temperature and the validation loss that chose them."""

    weights: np.ndarray
    bias: np.ndarray
    penalty: float
    temperature: float
    validation_loss: float


def _solved(blocks: DataFrame, classes: int, width: int, penalties: Sequence[float], parts: Sequence[str], block: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The heads that the named parts' rows together give; one task solves, and the driver gets the weights."""
    edges = _edges(1 + classes + width, block)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = sum(_whole(own, edges) for _, own in pdf.groupby("k"))
        heads = Moment(g, classes).heads(penalties)
        return pd.DataFrame({"at": range(len(heads)), "w": [w.tobytes() for w, _ in heads], "b": [b.tobytes() for _, b in heads]})

    rows = blocks.where(F.col("k").isin(*parts)).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, "at int, w binary, b binary").orderBy("at").collect()
    return [(np.frombuffer(bytes(r.w)).reshape(width, classes), np.frombuffer(bytes(r.b))) for r in rows]


def scores(rows: DataFrame, vector: str, heads: list[tuple[np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """The rows with ``scores``: for each head an array of its classes' scores."""
    held = rows.sparkSession.sparkContext.broadcast(heads)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, vector, width)
            each = [x @ w + b for w, b in held.value]
            nested = pa.array([[s[i].tolist() for s in each] for i in range(len(x))], pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, nested], [*names, "scores"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", scores array<array<double>>"
    return rows.where(F.size(vector) == width).mapInArrow(run, schema)


def probabilities(scores_: Column, temperature: Column) -> Column:
    """Softmax of scores divided by the temperature."""
    top = F.array_max(scores_)
    powers = F.transform(scores_, lambda s: F.exp((s - top) / temperature))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def fit_head(rows: DataFrame, vector: str, label: str, part: str, classes: int, width: int, penalties: Sequence[float] = PENALTIES, temperatures: Sequence[float] = TEMPERATURES, block: int = BLOCK) -> Head:
    """Fit on the rows of part 'train', choose by the log loss of 'validation', refit on both.

    Vectors are standardised by the rows of the fit (a constant column has the scale ``SCALE_FLOOR``); the intercepts are not penalised. Of equal losses the larger penalty counts, then the smaller temperature. Without rows in one of the two parts there is no head.
    """
    sums = outer_sums(rows.where(F.col(part).isin("train", "validation")), vector, label, classes, width, part, block).persist(StorageLevel.DISK_ONLY)
    try:
        sizes = {r.k for r in sums.select("k").distinct().collect()}
        if sizes != {"train", "validation"}:
            raise ValueError("a head needs training and validation rows")
        first = _solved(sums, classes, width, penalties, ["train"], block)
        checked = scores(rows.where(F.col(part) == "validation").where(F.col(label).between(0, classes - 1)).select(label, vector), vector, first, width)
        tried = checked.select(label, F.posexplode("scores").alias("at", "s")).select(label, "at", "s", F.explode(F.array(*map(F.lit, temperatures))).alias("t"))
        own = F.get(probabilities(F.col("s"), F.col("t")), F.col(label).cast("int"))
        losses = tried.groupBy("at", "t").agg(F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("loss")).collect()
        best = min(losses, key=lambda r: (r.loss, -penalties[r["at"]], r.t))
        penalty = penalties[best["at"]]
        ((w, b),) = _solved(sums, classes, width, [penalty], ["train", "validation"], block)
    finally:
        sums.unpersist()
    return Head(w, b, penalty, best.t, best.loss)


def predict_head(rows: DataFrame, vector: str, head: Head, width: int) -> DataFrame:
    """The rows with ``probabilities`` and ``predicted``, the class of the largest (the first on a tie)."""
    scored = scores(rows, vector, [(head.weights, head.bias)], width)
    p = probabilities(F.get("scores", F.lit(0)), F.lit(head.temperature))
    out = scored.withColumn("probabilities", p).drop("scores")
    return out.withColumn("predicted", F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1)


def head_report(predicted: DataFrame, label: str, classes: int) -> DataFrame:
    """n, accuracy, log loss, Brier score, the accuracy of always naming the most frequent class, and how often each class is predicted."""
    own = F.get("probabilities", F.col(label).cast("int"))
    brier = F.aggregate(F.transform("probabilities", lambda p, i: (p - (i == F.col(label)).cast("double")) ** 2), F.lit(0.0), lambda a, b: a + b)
    counts = [F.count_if(F.col(label) == k) for k in range(classes)]
    return predicted.agg(
        F.count("*").alias("n"), F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"), F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("log_loss"), F.avg(brier).alias("brier"),
        (F.greatest(*counts) / F.count("*")).alias("majority_accuracy"), F.array(*(F.count_if(F.col("predicted") == k) for k in range(classes))).alias("predicted_counts"))
