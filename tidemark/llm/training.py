"""Bounded training samples, and models fitted in one retryable task.

A model learns from at most ``limit`` labelled rows (a documented bound): those with the smallest hash of the id, so
the choice does not depend on how the tables are stored. Everything else covers all rows.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trained_fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(label, text) of a bounded sample of labelled documents outside the held-out fold.

    Null labels and ids are left out; of several labels of an id the largest counts, of several texts the first in order. The sample's
    ids are broadcast: there are ``limit`` of them at most.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & trained_fold()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


#: Bytes of text that a fit reads, at most.
TRAINING_BYTES = 64 << 20


def fit_in_task(sample: DataFrame, fit: Callable[[list[str], np.ndarray], dict[str, np.ndarray]], max_bytes: int = TRAINING_BYTES) -> dict[str, np.ndarray]:
    """Run ``fit`` over the bounded sample in one task and return its arrays. The task can be run again anywhere. Without labelled rows ``fit`` gets none.

    A text that no longer fits in ``max_bytes`` of those before it (in the sample's order) is not learned from, so very long texts do not fill the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        labels: list[int] = []
        room = max_bytes
        for batch in slices(batches):
            for text, label, size in zip(batch.column("text"), batch.column("label").to_pylist(), pc.binary_length(batch.column("text")).to_pylist(), strict=True):
                if size <= room:
                    room -= size
                    texts.append(text.as_py())
                    labels.append(label)
        held = io.BytesIO()
        np.savez(held, **fit(texts, np.array(labels, dtype=np.float64)))
        yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], ["model"])

    packed = sample.select("label", "text").coalesce(1).mapInArrow(run, "model binary").first()
    if packed is None:  # an empty sample may have no task at all
        return fit([], np.empty(0))
    with np.load(io.BytesIO(bytes(packed[0]))) as arrays:
        return {k: arrays[k] for k in arrays.files}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def platt(margins: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over the margins (Newton's method, smoothed targets)."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ beta)
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * w[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-6)), float(beta[1])
