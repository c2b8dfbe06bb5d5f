"""Byte-level BPE encoding and decoding.

The merge loop keeps a segment tree over the byte positions of one piece. Leaf ``i`` holds the rank
of the pair that starts at the live token ``i`` (or infinity); an inner node holds the smaller of its
children, the left one on a tie. The root is therefore the leftmost pair of the lowest rank. A merge
changes two leaves (the merged token's pair and its left neighbour's) and retires one, so it costs a
logarithmic number of updates, and a run of n bytes costs O(n log n) whatever its shape.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_path, release, slices, texts

#: Above every rank: no pair.
NONE = 1 << 62
VOID = np.int64(1 << 40)
#: Distinct pieces whose ids a task remembers before it starts anew.
CACHE_PIECES = 400_000
#: Pieces of at most so many bytes are merged together, so many trees at once; longer ones one by one.
SHORT, GROUP = 64, 8192


class Vocabulary:
    """Ranks of a tiktoken file with the split pattern; encodes and decodes without special tokens."""

    def __init__(self, path: str, pattern: str):
        self.ranks: dict[bytes, int] = {}
        with open(local_path(path), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.fromiter(map(len, self.tokens), dtype=np.int64, count=size)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [(self.ranks[t[:k]] * size + self.ranks[t[k:]], rank) for t, rank in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        pairs.sort()
        self.pair_keys, self.pair_ranks = np.array(pairs, dtype=np.int64).T.copy()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: repeatedly merge the leftmost pair of the lowest rank."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        base = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * base)
        for i in range(n - 1):
            tree[base + i] = ranks.get(piece[i : i + 2], NONE)
        for k in range(base - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left <= right else right
        after = list(range(1, n + 1))  # start of the next live token; n: none
        before = list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = base + i
            tree[k] = value
            k >>= 1
            while k:
                left, right = tree[2 * k], tree[2 * k + 1]
                low = left if left <= right else right
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while (low := tree[1]) < NONE:
            k = 1
            while k < base:
                k *= 2
                if tree[k] != low:
                    k += 1
            i = k - base
            gone = after[i]
            end = after[gone]
            after[i] = end
            put(gone, NONE)
            if end < n:
                before[end] = i
                put(i, ranks.get(piece[i : after[end]], NONE))
            else:
                put(i, NONE)
            if before[i] >= 0:
                put(before[i], ranks.get(piece[before[i] : end], NONE))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of ids, ``VOID`` where the joined bytes are no token."""
        wanted = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], VOID)

    def merge_many(self, pieces: list[bytes], base: int) -> list[bytes]:
        """Packed ids of many pieces of at most ``base`` bytes: the same trees, one in each row of an array."""
        count, levels = len(pieces), base.bit_length() - 1
        sizes = np.fromiter(map(len, pieces), np.int64, count)
        data = np.frombuffer(b"".join(x.ljust(base, b"\0") for x in pieces), np.uint8).reshape(count, base)
        ids = self.byte_ids[data]
        after = np.tile(np.arange(1, base + 1), (count, 1))
        before = np.tile(np.arange(-1, base - 1), (count, 1))
        tree = np.full((count, 2 * base), VOID, np.int64)
        tree[:, base : 2 * base - 1] = np.where(np.arange(1, base) < sizes[:, None], self.ranked(ids[:, :-1], ids[:, 1:]), VOID)
        for k in range(base - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])

        def put(rows: np.ndarray, k: np.ndarray) -> None:
            for _ in range(levels):
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        rows = np.flatnonzero(tree[:, 1] < VOID)
        while len(rows):
            low = tree[rows, 1]
            k = np.ones(len(rows), np.int64)
            for _ in range(levels):
                k = 2 * k
                k += tree[rows, k] != low
            i = k - base
            gone = after[rows, i]
            end = after[rows, gone]
            left = before[rows, i]
            after[rows, i] = end
            ids[rows, i] = low
            inner = end < sizes[rows]
            tree[rows, base + gone] = VOID
            tree[rows, k] = VOID
            r, e = rows[inner], end[inner]
            before[r, e] = i[inner]
            tree[r, k[inner]] = self.ranked(low[inner], ids[r, e])
            some = left >= 0
            r, p = rows[some], left[some]
            tree[r, base + p] = self.ranked(ids[r, p], low[some])
            put(rows, base + gone)
            put(rows, k)
            put(r, base + p)
            rows = rows[tree[rows, 1] < VOID]
        live = np.zeros((count, base + 1), bool)
        at, row = np.zeros(count, np.int64), np.arange(count)
        while len(row):
            live[row, at] = True
            at = after[row, at]
            more = at < sizes[row]
            at, row = at[more], row[more]
        live = live[:, :base]
        flat = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that are not known yet. Short ones are remembered and merged together, by tree size."""
        if len(self.known) + len(pieces) > CACHE_PIECES:
            self.known.clear()
        groups: dict[int, list[str]] = {}
        found: dict[str, bytes] = {}
        for piece in pieces:
            data = piece.encode("utf-8")
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(data) <= SHORT:
                groups.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append(piece)
            else:
                found[piece] = np.array(self.merge(data), dtype="<u4").tobytes()
        for base, group in groups.items():
            for at in range(0, len(group), GROUP):
                part = group[at : at + GROUP]
                self.known.update(zip(part, self.merge_many([x.encode("utf-8") for x in part], base), strict=True))
        return found

    def encode_all(self, texts_: list[str]) -> Iterator[bytes]:
        """Ids of whole texts, packed; pieces new to this task are merged together first."""
        split = [self.split(x) for x in texts_]
        every = set().union(*split)
        known = self.known
        fresh = every - known.keys()
        if fresh and len(known) + len(fresh) > CACHE_PIECES:
            fresh = every
        found = self.learn(fresh) if fresh else {}
        for pieces in split:
            yield b"".join([known[p] if p in known else found[p] for p in pieces])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, joined."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    return Vocabulary(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``n_bytes`` and ``lossless`` to ``doc_id``; with ``with_ids``
    also ``ids`` (array of int). A null text counts as empty (no tokens). A null or repeated ``doc_id``
    stays as it is: one row out for each row in. Other columns are not read. Nothing is shuffled; a
    lost task is simply run again.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, lossless boolean"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in slices(batches, max_bytes=2 << 20):
            counts, encoded, decoded, sizes, same, all_ids = [], [], [], [], [], []
            every = texts(batch).to_pylist()
            for text, packed in zip(every, vocab.encode_all(every), strict=True):
                ids = np.frombuffer(packed, dtype="<u4")
                back = vocab.decode(ids)
                counts.append(len(ids))
                encoded.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                sizes.append(len(back))
                same.append(back == text.encode("utf-8"))
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded), pa.array(sizes, pa.int64()), pa.array(same)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "lossless"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        vocab.known.clear()
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Text of every row's ``ids`` (bytes that are not UTF-8 become U+FFFD); a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            out = [None if ids is None else b"".join(vocab.tokens[i] for i in ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
