"""Token counts for the sections of a document by offset mapping.

A document is encoded once, as a whole. Each token's byte span becomes a span of characters, and an
interval join (binary search over the section starts) hands the tokens to sections. Sections here are the
``\\n``-separated lines with their line break; they tile the text. A token that crosses a border goes to one
section by an explicit rule:

``start``     the section of its first character (the default)
``end``       the section of its last character
``majority``  the section that holds most of its characters, the first of those on a tie
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import vocabulary
from .common import slices, texts

RULES = ("start", "end", "majority")


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token, from the tokens' byte lengths. A character that two tokens
    share belongs to the spans of both."""
    chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    ends = np.cumsum(lengths)
    return chars[ends - lengths] - 1, chars[ends - 1] - 1


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a border."""
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, last, "right") - 1
    if rule == "start":
        return a, a != b
    if rule == "end":
        return b, a != b
    owner = a.copy()
    for t in np.flatnonzero(a != b).tolist():
        edges = np.concatenate([[first[t]], starts[a[t] + 1 : b[t] + 1], [last[t] + 1]])
        owner[t] = a[t] + int(np.argmax(np.diff(edges)))
    return owner, a != b


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "start") -> DataFrame:
    """Tokens of each section of each document.

    One row for each section: ``doc_id``, ``section`` (from 0), ``start``, ``end`` (code points, end exclusive),
    ``n_tokens`` allocated, ``n_crossing`` (allocated tokens that also reach into another section) and ``doc_tokens``. A null
    or empty text is one empty section without tokens. Null and repeated ids stay; other columns are not read. No
    shuffle, one pass.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in slices(batches, max_bytes=2 << 20):
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            rows = []
            every = texts(batch).to_pylist()
            for row, (text, packed) in enumerate(zip(every, vocab.encode_all(every), strict=True)):
                data = text.encode("utf-8")
                ids = np.frombuffer(packed, "<u4")
                starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in text.split("\n")][:-1])]).astype(np.int64)
                k = len(starts)
                if len(ids):
                    owner, crosses = allocate(*token_spans(data, vocab.lengths[ids]), starts, rule)
                    per, crossing = np.bincount(owner, minlength=k), np.bincount(owner[crosses], minlength=k)
                else:
                    per = crossing = np.zeros(k, np.int64)
                rows.append(np.full(k, row))
                for at, x in zip(range(1, 7), (np.arange(k), starts, np.append(starts[1:], len(text)), per, crossing, np.full(k, len(ids))), strict=True):
                    out[at].append(x)
            columns = [batch.column("doc_id").take(pa.array(np.concatenate(rows)))]
            columns += [pa.array(np.concatenate(x), pa.int32() if at == 1 else pa.int64()) for at, x in enumerate(out) if at]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
