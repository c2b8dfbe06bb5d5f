"""Quality rules: hashed word and character n-grams under a calibrated logistic regression.

Rules that need no labels (length, repetition) come first. The verdict on the rest is a logistic
regression over relative frequencies of hashed word 1- and 2-grams, word-shape 2-grams and character 3- and
4-grams (code points), trained on labelled quality rows, calibrated on a part of the sample that it did not learn from, and
compared with a fixed threshold. Scoring goes by Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, grams, hash_strings, mix, release, slices, texts, words_of
from .training import fit_in_task, platt, sigmoid, training_rows

#: Buckets of each n-gram family (a power of two) and their number.
BITS = 16
FAMILIES = 5
#: Labelled rows that the model learns from, at most.
TRAINING_ROWS = 4000
#: A document is kept from this calibrated probability of good quality on.
KEEP_FROM = 0.3
#: Fixed values of the base rules.
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = "[#*$%&|<>]"
#: Distinct words of which three number a 3-word window in 63 bits.
MOST_CODES = 2_000_000


def bucket(hashes: np.ndarray, family: int) -> np.ndarray:
    return (mix(hashes + np.uint64(family)) >> np.uint64(64 - BITS)).astype(np.int64) + (family << BITS)


def character_grams(points: np.ndarray, width: int, family: int) -> np.ndarray:
    """Buckets of the ``width`` consecutive code points that start at each place."""
    n = len(points) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = points[:n].astype(np.uint64)
    for j in range(1, width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += points[j : j + n]
    out *= np.uint64(0x9E3779B97F4A7C15)
    out >>= np.uint64(64 - BITS)
    return out.astype(np.int64) + (family << BITS)


def shapes(codes: np.ndarray, lengths: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """A word's shape: equal to the word before or the one before that, its length class, only letters or not."""
    same = np.zeros(len(codes), np.uint64)
    same[1:] += codes[1:] == codes[:-1]
    same[2:] += 2 * (codes[2:] == codes[:-2]).astype(np.uint64)
    return same * np.uint64(64) + np.minimum(lengths, 15).astype(np.uint64) * np.uint64(2) + plain.astype(np.uint64)


def featurise(text: pa.Array) -> Iterator[tuple[int, str, np.ndarray, list[np.ndarray]]]:
    """For each text: its number, the text, its words' codes, and bucket numbers of its n-grams by family."""
    words, rows = words_of(text)
    offsets = np.searchsorted(rows, np.arange(len(text) + 1))
    codes = words.indices.to_numpy().astype(np.int64) if len(words) else np.empty(0, np.int64)
    if len(words):
        hashes = hash_strings(words.dictionary)
        lengths = pc.utf8_length(words.dictionary).to_numpy().astype(np.int64)
        plain = pc.utf8_is_alpha(words.dictionary).to_numpy(zero_copy_only=False)
    for i, one in enumerate(text.to_pylist()):
        own = codes[offsets[i] : offsets[i + 1]]
        if len(own):
            h = hashes[own]
            word_part = [bucket(h, 0), bucket(grams(h, 2), 1), bucket(grams(shapes(own, lengths[own], plain[own]), 2), 2)]
        else:
            word_part = [np.empty(0, np.int64)] * 3
        points = np.frombuffer(one.encode("utf-32-le"), np.uint32)
        yield i, one, own, [*word_part, character_grams(points, 3, 3), character_grams(points, 4, 4)]


def margin(weights: np.ndarray, families: list[np.ndarray]) -> float:
    """The linear score: in each family the mean weight of the n-grams, plus the bias in the last place."""
    return float(weights[-1]) + sum(float(weights[x].mean()) for x in families if len(x))


def fit(texts_: list[str], labels: np.ndarray, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> dict[str, np.ndarray]:
    """AdaGrad over the first four fifths of the sample; the last fifth calibrates."""
    size = (FAMILIES << BITS) + 1
    weights, seen = np.zeros(size, np.float32), np.full(size, 1e-8, np.float32)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    sizes: list[int] = []
    for at in range(0, len(texts_), 256):
        rows = []
        for _, _, _, families in featurise(pa.array(texts_[at : at + 256], pa.string())):
            ids, values = [], []
            for x in families:
                if len(x):
                    u, n = np.unique(x, return_counts=True)
                    ids.append(u.astype(np.int32))
                    values.append((n / len(x)).astype(np.float32))
            rows.append((np.append(np.concatenate(ids), np.int32(size - 1)) if ids else np.array([size - 1], np.int32), np.append(np.concatenate(values), np.float32(1)) if ids else np.ones(1, np.float32)))
        sizes += [len(ids) for ids, _ in rows]
        parts.append((np.concatenate([ids for ids, _ in rows]), np.concatenate([values for _, values in rows])))
    # two long arrays, which go back to the system in whole
    every_id, every_value = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int32), np.empty(0, np.float32))
    del parts
    ends = np.cumsum([0, *sizes])
    row = lambda i: (every_id[ends[i] : ends[i + 1]], every_value[ends[i] : ends[i + 1]])
    count = len(sizes)
    learn = max(1, count * 4 // 5)
    if count and 0 < labels[:learn].sum() < learn:
        order = np.random.default_rng(seed)
        balance = {1.0: 0.5 * learn / labels[:learn].sum(), 0.0: 0.5 * learn / (learn - labels[:learn].sum())}
        for _ in range(epochs):
            for i in order.permutation(learn).tolist():
                ids, values = row(i)
                p = float(sigmoid(np.array(weights[ids] @ values)))
                g = (p - labels[i]) * balance[float(labels[i])] * values
                seen[ids] += g * g
                weights[ids] -= rate * g / np.sqrt(seen[ids])
    held = list(range(learn, count))
    slope, shift = platt(np.array([float(weights[row(i)[0]] @ row(i)[1]) for i in held]), labels[held]) if held else (1.0, 0.0)
    del every_id, every_value, row
    release()
    return {"weights": weights, "curve": np.array([slope, shift])}


def base_counts(text: str, codes: np.ndarray) -> tuple[int, int, int]:
    """(lines equal to an earlier line, words in 3-word windows found twice or more, white space)."""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    n = len(codes)
    repeat = 0
    if n >= 4:
        wide = np.int64(codes.max()) + 1
        pair = codes[:-2] * wide + codes[1:-1]
        if wide > MOST_CODES:  # three codes would not fit in 63 bits; the ranks of pairs do
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        tri = pair * wide + codes[2:]
        _, inverse, counts = np.unique(tri, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        if again.any():
            cover = np.zeros(n, bool)
            for j in range(3):
                cover[j : n - 2 + j] |= again
            repeat = int(cover.sum())
    return dup, repeat, sum(map(text.count, SPACE))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> dict[str, np.ndarray]:
    return fit_in_task(training_rows(docs, labels, "quality", limit), fit)


def score_quality(docs: DataFrame, model: dict[str, np.ndarray], keep_from: float = KEEP_FROM, carry: list[str] | None = None) -> DataFrame:
    """Base rules and verdict for every whole text.

    Returns ``doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed score kept``, one row
    for each row; ``carry`` names columns of ``docs`` that come along under a leading ``carried_``. A null text counts as
    empty: no words, so its base rules fail. Null and repeated ids stay. No shuffle; the weights, of a fixed
    size, are broadcast.
    """
    carry = carry or []
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    own = [F.col(c).alias(f"carried_{c}") for c in carry]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own)
    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    schema += "".join(f", `carried_{c}` {kinds[c]}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, (slope, shift) = held.value["weights"], held.value["curve"]
        for batch in slices(batches):
            text = texts(batch)
            n = len(text)
            out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            margins = np.zeros(n)
            chars = pc.utf8_length(text).to_numpy(zero_copy_only=False)
            out["n_symbols"][:] = pc.count_substring_regex(text, SYMBOLS).to_numpy(zero_copy_only=False)
            for i, one, codes, families in featurise(text):
                dup, repeat, space = base_counts(one, codes)
                out["n_words"][i], out["word_chars"][i], out["n_dup_lines"][i], out["n_repeat_words"][i] = len(codes), chars[i] - space, dup, repeat
                margins[i] = margin(weights, families)
            failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
            score = sigmoid(slope * margins + shift)
            columns = [batch.column("doc_id"), *map(pa.array, out.values()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_from))]
            names = ["doc_id", *out, "base_failed", "score", "kept"]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(f"carried_{c}") for c in carry], names + [f"carried_{c}" for c in carry])

    return source.mapInArrow(run, schema)
