"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its lower-cased words stripped of outer punctuation, their 2-grams and the pairs with one
word between them. FTRL-proximal keeps a learning rate for each coordinate and, by its L1 term, leaves
most weights at exactly zero, so what is broadcast is a short sorted list of (hash bucket, weight).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_strings, mix, slices, texts, words_of
from .training import fit_in_task, sigmoid, training_rows

BITS = 20
#: Labelled rows that the model learns from, at most.
TRAINING_ROWS = 12000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 6.0, 0.5, 3
PREDICT_FROM = 0.5
BIAS = 1 << BITS


def featurise(text: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct buckets of each text's n-grams and skip-grams."""
    words, rows = words_of(text)
    offsets = np.searchsorted(rows, np.arange(len(text) + 1))
    if len(words):
        plain = pc.ascii_lower(pc.ascii_trim(words.dictionary, ".,;:!?\"'()[]|*#%&$-"))
        hashes = hash_strings(plain)[words.indices.to_numpy()]
    shift = np.uint64(64 - BITS)
    for i in range(len(text)):
        h = hashes[offsets[i] : offsets[i + 1]] if len(words) else np.empty(0, np.uint64)
        parts = [mix(h), mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(5)), mix(h[:-2] * np.uint64(7) + h[2:] * np.uint64(11))]
        yield np.unique(np.concatenate(parts) >> shift).astype(np.int64)


def fit(texts_: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> dict[str, np.ndarray]:
    """FTRL-proximal over the sample, one text at a time in a seeded order.

    A coordinate's weight is 0 while ``|z| <= L1``, else ``-(z - sign(z) L1) / ((BETA + sqrt(n)) / ALPHA + L2)``.
    """
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    l1 = np.full(BIAS + 1, L1)
    l1[BIAS] = 0.0

    def weights(ids: np.ndarray | slice) -> np.ndarray:
        own, limit = z[ids], l1[ids]
        return np.where(np.abs(own) <= limit, 0.0, -(own - np.sign(own) * limit) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2))

    rows = [np.append(x, BIAS) for at in range(0, len(texts_), 256) for x in featurise(pa.array(texts_[at : at + 256], pa.string()))]
    if rows and 0 < labels.sum() < len(labels):
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)).tolist():
                ids = rows[i]
                w = weights(ids)
                g = float(sigmoid(np.array(w.sum()))) - labels[i]
                sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
                z[ids] += g - sigma * w
                n[ids] += g * g
    full = weights(slice(None))
    at = np.flatnonzero(full)
    return {"ids": at.astype(np.int32), "weights": full[at].astype(np.float32)}


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> dict[str, np.ndarray]:
    return fit_in_task(training_rows(docs, labels, "toxic", limit), fit)


def score_toxicity(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Probability of toxicity of every whole text: ``doc_id held_out score predicted``, one row for each row.

    A null or empty text has no features and gets the bias alone. A null id is in no fold (``held_out`` false).
    Repeated rows score alike; other columns are not read. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(5)) == 0
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BIAS + 1, np.float32)
        dense[held.value["ids"]] = held.value["weights"]
        for batch in slices(batches):
            margins = np.array([dense[BIAS] + dense[x].sum() for x in featurise(texts(batch))], dtype=np.float64)
            score = sigmoid(margins)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= PREDICT_FROM).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
