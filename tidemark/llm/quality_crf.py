"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line with a word gets features of its own and of its neighbours; the chain has two states, bad and good. Lines
carry no labels, so the field learns from documents: every line of a training document takes the document's
label, and the marginals show how far a line agrees with lines of good or bad documents and with its
neighbours. A document's quality is the mean of its lines' forward-backward marginals, weighted by their length, sent
through a calibration curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts
from .training import fit_in_task, platt, sigmoid, training_rows

#: Labelled rows that the model learns from, at most.
TRAINING_ROWS = 4000
PREDICT_FROM = 0.3
EPOCHS, RATE, L2 = 400, 0.05, 1e-4
# Classes of characters that are counted in a line.
CLASSES = ("[\\x20\\x09-\\x0D]+", "[#*$%&|<>]", "[0-9]", "[.,;:!?]", "[A-Z]", "\\|", "[^\\x00-\\x7F]", "@|://|\\+[0-9]")
OWN = 18


def lines_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines that have a word, and the row of each."""
    lists = pc.split_pattern(text, "\n")
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(text), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0)
    return flat.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def own_features(lines: pa.Array, rows: np.ndarray) -> np.ndarray:
    """One row of features for each line."""
    m = len(lines)
    out = np.zeros((m, OWN))
    if not m:
        return out
    chars = np.maximum(pc.utf8_length(lines).to_numpy(zero_copy_only=False), 1).astype(float)
    counts = [pc.count_substring_regex(lines, c).to_numpy(zero_copy_only=False) for c in CLASSES]
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lines))
    words = lists.flatten().dictionary_encode()
    codes, sizes = words.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(m), sizes)
    same = np.zeros(len(codes))
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    lengths = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False)[codes].astype(float)
    ends = np.cumsum(sizes)
    distinct = np.bincount(np.unique(owner * (np.int64(codes.max()) + 1) + codes) // (np.int64(codes.max()) + 1), minlength=m)
    line_codes = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    key = rows * (line_codes.max() + 1) + line_codes
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    out[:, 0] = 1.0
    out[:, 1] = np.log1p(sizes) / 5
    out[:, 2:10] = np.stack([np.minimum(c / chars * s, 3.0) for c, s in zip(counts, (5, 10, 10, 10, 10, 20, 3, 20), strict=True)], 1)
    out[:, 10] = np.add.reduceat(same, ends - sizes) / sizes * 3
    out[:, 11] = 1 - distinct / sizes
    out[:, 12] = np.add.reduceat(lengths, ends - sizes) / sizes / 6
    out[:, 13] = np.minimum(np.maximum.reduceat(lengths, ends - sizes) / 20, 3)
    out[:, 14] = first[inverse] != np.arange(m)
    out[:, 15] = sizes < 5
    out[:, 16] = pc.match_substring_regex(lines, "[.!?][\"')]*[\\x20\\x09-\\x0D]*$").to_numpy(zero_copy_only=False)
    out[:, 17] = np.log1p(chars / sizes) / 3
    return out


def features(lines: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at the edges), and marks of the two edges."""
    own = own_features(lines, rows)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(rows) > 1:
        same = (rows[1:] == rows[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    return np.concatenate([own, before, after], 1)


WIDTH = 3 * OWN


def chains(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each row's run of lines."""
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(rows)))


def forward_backward(score: np.ndarray, trans: np.ndarray, rows: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the good state by line, and (with ``pairs``) the expected counts of the four transitions of each line with the next.

    ``score`` is the good state's advantage. Chains are walked together, position by position, in the order of their lengths.
    """
    m = len(score)
    starts, sizes = chains(rows)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    emit = np.stack([np.zeros(m), score], 1)
    peak = emit.max(1, keepdims=True)
    emit = np.exp(np.maximum(emit - peak, -30))
    t = np.exp(trans)
    alpha, beta = np.zeros((m, 2)), np.ones((m, 2))
    longest = int(sizes[0]) if m else 0
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # chains of at least that length
    for k in range(longest):
        at = starts[: live[k]] + k
        a = emit[at] if not k else (alpha[at - 1] @ t) * emit[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for k in range(longest - 2, -1, -1):
        at = starts[: live[k + 1]] + k
        b = (beta[at + 1] * emit[at + 1]) @ t.T
        beta[at] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    both /= both.sum(1, keepdims=True)
    pair = np.zeros((m if pairs else 0, 2, 2))
    if not pairs:
        return both[:, 1], pair
    inner = np.flatnonzero(rows[1:] == rows[:-1]) if m > 1 else np.empty(0, np.int64)
    if len(inner):
        p = alpha[inner][:, :, None] * t[None] * (emit[inner + 1] * beta[inner + 1])[:, None, :]
        pair[inner] = p / p.sum((1, 2), keepdims=True)
    return both[:, 1], pair


def document_scores(marginals: np.ndarray, weight: np.ndarray, rows: np.ndarray, n: int, empty: float) -> np.ndarray:
    """Length-weighted mean marginal of each document; ``empty`` where there is no line."""
    total = np.bincount(rows, weight, n)
    return np.where(total > 0, np.bincount(rows, weight * marginals, n) / np.maximum(total, 1e-12), empty)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts_: list[str], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Maximum likelihood by Adam on four fifths of the sample, each document counting once; calibration on the last fifth."""
    w, trans = np.zeros(WIDTH), np.zeros((2, 2))
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if not 0 < labels.sum() < len(labels):
        return {"w": w, "trans": trans, "curve": np.array([1.0, logit(prior)]), "empty": np.array(0.5)}
    text = pa.array(texts_, pa.string())
    lines, rows = lines_of(text)
    x = features(lines, rows)
    weight = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(float)
    learn = len(labels) * 4 // 5
    use = rows < learn
    xs, rs = x[use], rows[use]
    share = (weight[use] / np.bincount(rs, weight[use], len(labels))[rs]) * np.where(labels[rs] > 0, 0.5 / max(labels[:learn].sum(), 1), 0.5 / max(learn - labels[:learn].sum(), 1))
    truth = labels[rs]
    gold = np.zeros((len(rs), 2, 2))
    inner = np.flatnonzero(rs[1:] == rs[:-1])
    gold[inner, truth[inner].astype(int), truth[inner + 1].astype(int)] = 1
    # an Adam step for the unary weights and for the transitions
    moments = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, EPOCHS + 1):
        marginal, pair = forward_backward(xs @ w, trans, rs)
        g_w = xs.T @ ((marginal - truth) * share) + L2 * w
        g_t = ((pair - gold) * share[:, None, None]).sum(0) + 10 * L2 * trans
        for k, (p, g) in enumerate(((w, g_w), (trans, g_t))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
            p -= RATE * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    marginal, _ = forward_backward(x @ w, trans, rows, pairs=False)
    score = document_scores(marginal, weight, rows, len(labels), 0.5)
    return {"w": w, "trans": trans, "curve": np.array(platt(logit(score[learn:]), labels[learn:])), "empty": np.array(0.5)}


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> dict[str, np.ndarray]:
    return fit_in_task(training_rows(docs, labels, "quality", limit), fit)


def score_lines(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Calibrated quality of every whole text: ``doc_id held_out score predicted n_lines n_bad_lines``, one row for each row.

    A text without words (null, empty, blank) has no line and scores as an undecided document does. A null id is in
    no fold. Repeated rows score alike; other columns are not read. No shuffle; the weights are a few hundred numbers.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(5)) == 0
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches):
            lines, rows = lines_of(texts(batch))
            n = batch.num_rows
            marginal, _ = forward_backward(features(lines, rows) @ m["w"], m["trans"], rows, pairs=False)
            weight = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(float)
            raw = document_scores(marginal, weight, rows, n, float(m["empty"]))
            score = sigmoid(m["curve"][0] * logit(raw) + m["curve"][1])
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= PREDICT_FROM).astype(np.int32)), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), pa.array(np.bincount(rows, marginal < 0.5, n).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "n_lines", "n_bad_lines"])

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_lines long, n_bad_lines long")
