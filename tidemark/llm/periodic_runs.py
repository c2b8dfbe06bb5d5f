"""Periodic runs of words: maximal stretches that repeat a period at least four times.

A run is a stretch of words with smallest period q (words q apart are equal) and length ``max(6, 4 q)`` or more that no neighbour extends.

1. **Repeated k-gram masking.** The part of a run that stands q further on again has ``length - q`` words, five at least. So each word of a run lies in a
   5-gram that occurs twice in the document; words outside such grams cannot join runs. Grams of a batch are compared as 64-bit hashes: two grams of one hash only
   let more words survive.
2. **Main-Lorentz** goes over the surviving segments only: a segment is halved, and the runs that cross the middle follow from how far the words around the
   middle agree with those p further left or right, for all p at once. The agreement comes from ranks of the 2^j-grams (equal ranks are equal words), so it is exact. Halves of at
   most ``LEAF`` words are compared with themselves at each distance. What the halves find is joined, made maximal and kept with its smallest period.

A document is one row of work; memory is proportional to its longest surviving segment (times the logarithm).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import mix, slices, texts, words_of

#: A run has so many words and periods at least. The overlap of a run with itself moved by a period is then five words or more: 6 - 1, or 4 q - q from q = 2 on.
LEAST_WORDS, LEAST_PERIODS, OVERLAP = 6, 4, 5
#: Words up to which a segment is compared with itself directly.
LEAF = 128


def surviving(codes: np.ndarray, offsets: np.ndarray, k: int = OVERLAP) -> np.ndarray:
    """Whether each word lies in a k-gram that its document holds twice; documents begin at ``offsets``."""
    n = len(codes)
    out = np.zeros(n, bool)
    if n < k:
        return out
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h = mix(rows[: n - k + 1].astype(np.uint64) + np.uint64(1))
    for j in range(k):
        h = mix(h ^ codes[j : n - k + 1 + j].astype(np.uint64)) + np.uint64(j)
    whole = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(n + 1, np.int64)
    edge[order[twice]] += 1
    np.add.at(edge, order[twice] + k, -1)
    return np.cumsum(edge[:-1]) > 0


class Ranks:
    """Ranks of the 2^j-grams of a sequence, and how far two places agree."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        level = np.unique(x, return_inverse=True)[1].astype(np.int64)
        self.levels = [level.astype(np.int32)]
        width = 1
        while 2 * width <= self.n:
            pairs = level[: len(level) - width] * np.int64(self.n + 1) + level[width:]
            level = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            self.levels.append(level.astype(np.int32))
            width *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from places a and b on."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[j], 1 << j
            fits = np.maximum(a, b) + width <= self.n
            same = fits.copy()
            same[fits] = level[a[fits]] == level[b[fits]]
            a += same * width
            b += same * width
            total += same * width
        return total

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree up to and with places a and b."""
        a, b, total = a + 1, b + 1, np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[j], 1 << j
            fits = np.minimum(a, b) >= width
            same = fits.copy()
            same[fits] = level[a[fits] - width] == level[b[fits] - width]
            a -= same * width
            b -= same * width
            total += same * width
        return total


def _leaf(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches of a short sequence that may be runs."""
    found = []
    for q in range(1, len(x) // LEAST_PERIODS + 1):
        same = x[q:] == x[:-q]
        need = max(LEAST_WORDS, LEAST_PERIODS * q) - q
        if np.count_nonzero(same) < need:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= need:
                found.append((a, b + q, q))
    return found


def segment_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of a sequence, in order."""
    n = len(x)
    if n <= LEAF:
        found = _leaf(x)
    else:
        ranks, found, parts = Ranks(x), [], [(0, n)]
        while parts:
            low, high = parts.pop()
            if high - low <= LEAF:
                found += [(low + a, low + b, q) for a, b, q in _leaf(x[low:high])]
                continue
            middle = (low + high) // 2
            parts += [(low, middle), (middle, high)]
            # a run over the middle has two periods on one of its sides, so that words p apart agree there; its period is a quarter of this part at most, or it had crossed a middle before
            for first, second in ((middle, 1), (middle - 1, -1)):
                p = np.arange(1, (high - low) // LEAST_PERIODS + 1)
                p = p[(first + second * p < n) & (first + second * p >= 0)]
                a = np.minimum(first, first + second * p)
                ahead, behind = ranks.forward(a, a + p), np.where(a > 0, ranks.backward(a - 1, a + p - 1), 0)
                fit = ahead + behind + p >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
                start = (a - behind)[fit]
                found += zip(start.tolist(), (start + (ahead + behind + p)[fit]).tolist(), p[fit].tolist(), strict=True)
        found = _widened(ranks, found)
    smallest: dict[tuple[int, int], int] = {}
    for a, b, q in found:
        smallest[a, b] = min(q, smallest.get((a, b), q))
    return sorted((a, b - a, q) for (a, b), q in smallest.items())


def _widened(ranks: Ranks, found: list[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """The stretches, as long as their period lasts in the whole sequence."""
    if not found:
        return set()
    start, _, q = (np.array(c, np.int64) for c in zip(*set(found), strict=True))
    behind = np.where(start > 0, ranks.backward(start - 1, start + q - 1), 0)
    low = start - behind
    return set(zip(low.tolist(), (low + q + ranks.forward(low, low + q)).tolist(), q.tolist(), strict=True))


def runs_of(codes: np.ndarray, alive: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of one document: those of its surviving segments."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], alive.view(np.int8), [0]))))
    found = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= LEAST_WORDS:
            found += [(a + start, length, q) for start, length, q in segment_runs(codes[a:b])]
    return found


def find_runs(docs: DataFrame, reorder: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Runs of every document and its text without their repetitions: ``doc_id n_words runs collapsed``, one row for each row.

    ``runs`` is an array of (start, length, period) in order of start, then period; ``collapsed`` holds the words, joined by one space, that no run contains after its
    first period. A null or blank text has no words and no runs. Rows of one id, or equal ones, are looked at one by one. Null ids stay; other columns are not read.

    ``reorder`` may name, for a doc_id and its number of words, the places of the words to read instead (null: the text as it is).
    """
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=2 << 20):
            words, rows = words_of(texts(batch))
            offsets = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            codes = words.indices.to_numpy() if len(words) else np.empty(0, np.int32)
            ids = batch.column("doc_id").to_pylist()
            if reorder is not None:
                codes = codes.copy()
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    places = reorder(ids[i], b - a)
                    if places is not None:
                        codes[a:b] = codes[a:b][places]
            alive = surviving(codes, offsets)
            found, kept = [], np.ones(len(codes), bool)
            hit = np.add.reduceat(np.append(alive, False), offsets[:-1]) if len(offsets) > 1 else np.empty(0)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = runs_of(codes[a:b], alive[a:b]) if b > a and hit[i] else []
                for start, length, q in own:
                    kept[a + start + q : a + start + length] = False
                found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            left = np.append(0, np.cumsum(kept))[offsets]
            flat = words.dictionary.take(pa.array(codes[kept])) if len(words) else pa.array([], pa.string())
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat), " ")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(found, kind), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    keyed = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return keyed.mapInArrow(run, schema)

