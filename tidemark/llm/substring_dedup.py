"""Exact substring dedup over word windows by super-k-mer partitioning.

A window is ``k`` consecutive words of one document; it is repeated if its word sequence starts anywhere else in the corpus, too.
Every word that a repeated window covers goes.

1. A window's minimiser is its ``m``-word sequence of the smallest hash (the leftmost of equal ones). Consecutive windows
   with the same minimiser at the same place form a super-k-mer. Equal windows have equal minimisers, at different places,
   so a minimiser that occurs once cannot lead to a repeated window.
2. Super-k-mers whose minimiser occurs again travel as one packed string of words to the bucket of that minimiser, where the
   windows of a bucket are sorted by their whole text and counted.
3. A minimiser with more than ``hot`` super-k-mers would make a large bucket. Its super-k-mers are dealt by place
   instead and cut into windows, which meet by a 128-bit hash with aggregation before the shuffle.
4. Repeated windows come back as ranges to the documents that have any. Key bitmaps, sized by the number of keys up to a bound and
   broadcast, keep the rest of the texts out of the shuffles; beyond the bound everything goes through them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, cut, grams, hash_strings, key_bitmap, mix, slices, texts, with_bitmap, words_of

WINDOW, MINIMISER, HOT = 35, 8, 256
PLACE = np.uint64(0xFFFFFFFF)


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbours, by doubling."""
    have = 1
    while have * 2 <= span:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (span - have)], x[span - have :]) if span > have else x


def super_kmers(hashes: np.ndarray, offsets: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, row, first word in the batch, windows) of each super-k-mer of the texts with these word offsets."""
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(sizes)), counts)
    starts = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][rows]
    g = grams(hashes, m)
    lowest = sliding_min((mix(g) & ~PLACE) | np.arange(len(g), dtype=np.uint64), k - m + 1)[starts]
    at = (lowest & PLACE).astype(np.int64)
    new = np.append(True, (at[1:] != at[:-1]) | (rows[1:] != rows[:-1]))
    first = np.flatnonzero(new)
    return mix(g[at[first]] + np.uint64(1)), rows[first], starts[first], np.diff(np.append(first, total))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and two hashes of the text; equal texts share all that follows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"))


def _emit(keyed: DataFrame, k: int, m: int, packed: bool) -> DataFrame:
    """The super-k-mers of every text: minimiser, k1 and k2 (the text), start, windows and, if wanted, the packed words."""
    names = ["minimiser", "k1", "k2", "start", "windows"] + ["packed"] * packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=2 << 20):
            text = texts(batch)
            words, word_rows = words_of(text)
            if not len(words):
                continue
            hashes = hash_strings(words.dictionary)[words.indices.to_numpy()]
            offsets = np.searchsorted(word_rows, np.arange(len(text) + 1))
            minimiser, rows, first, windows = super_kmers(hashes, offsets, k, m)
            if not len(rows):
                continue
            keys = [pa.array(batch.column(c).to_numpy()[rows]) for c in ("k1", "k2")]
            columns = [as_long(minimiser), *keys, pa.array((first - offsets[rows]).astype(np.int32)), pa.array(windows.astype(np.int32))]
            if packed:
                buffer = b" ".join(b" ".join(x.encode("utf-8").split()) for x, n in zip(text.to_pylist(), np.diff(offsets).tolist(), strict=True) if n)
                lengths = np.array([len(x) for x in (y.encode("utf-8") for y in words.dictionary.to_pylist())], np.int64)[words.indices.to_numpy()]
                ends = np.cumsum(lengths + 1) - 1
                a, b = (ends - lengths)[first], ends[first + windows + k - 2]
                columns.append(pa.array([buffer[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "minimiser long, k1 long, k2 long, start int, windows int" + ", packed binary" * packed
    return keyed.select("k1", "k2", "text").mapInArrow(run, schema)


def window_bytes(packed: pa.Array, windows: np.ndarray, k: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The text of every window of packed super-k-mers, with the number of its super-k-mer and its own number in it."""
    data = b" ".join(packed.to_pylist())
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begins, ends = np.append(0, spaces + 1), np.append(spaces, len(data))
    words = windows + k - 1
    first = np.cumsum(words) - words
    owner = np.repeat(np.arange(len(windows)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = first[owner] + inside
    return [data[i:j] for i, j in zip(begins[at].tolist(), ends[at + k - 1].tolist(), strict=True)], owner, inside


def _runs(k1: np.ndarray, k2: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k1, k2, first, last) of runs of consecutive starts, from rows sorted by super-k-mer and place."""
    new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k1)) - 1
    return k1[first], k2[first], start[first], start[last]


def _count_bucket(k: int):
    """Counts the windows of whole buckets; rows come sorted by minimiser. Windows of hot minimisers leave as hashes."""
    names = ["k1", "k2", "first", "last", "w1", "w2"]

    def ranges(table: pa.Table) -> pa.RecordBatch | None:
        windows, k1, k2, start = (table.column(c).to_numpy().astype(np.int64) for c in ("windows", "k1", "k2", "start"))
        cut_, owner, inside = window_bytes(table.column("packed").combine_chunks(), windows, k)
        codes = pa.array(cut_, pa.binary()).dictionary_encode().indices.to_numpy()
        where = mix(k1.view(np.uint64) ^ mix(k2.view(np.uint64)))[owner] + (start[owner] + inside).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(codes, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
        sorted_ = where[order]
        again = np.empty(len(codes), bool)
        again[order] = np.repeat(np.minimum.reduceat(sorted_, edges) != np.maximum.reduceat(sorted_, edges), np.diff(np.append(edges, len(codes))))
        if not again.any():
            return None
        a, b, first, last = _runs(k1[owner[again]], k2[owner[again]], start[owner[again]] + inside[again])
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), none, none], names)

    def hashed(table: pa.Table) -> pa.RecordBatch:
        windows, k1, k2, start = (table.column(c).to_numpy().astype(np.int64) for c in ("windows", "k1", "k2", "start"))
        cut_, owner, inside = window_bytes(table.column("packed").combine_chunks(), windows, k)
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in cut_), ">u8").astype(np.uint64).reshape(-1, 2)
        at = pa.array((start[owner] + inside).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(k1[owner]), pa.array(k2[owner]), at, at, as_long(both[:, 0].copy()), as_long(both[:, 1].copy())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            hot = batch.filter(batch.column("hot"))
            if hot.num_rows:
                yield hashed(pa.Table.from_batches([hot]))
            cold = batch.filter(pc.invert(batch.column("hot")))
            if not cold.num_rows:
                continue
            keys = cold.column("minimiser").to_numpy()
            # the last bucket may go on in the next batch; a cold bucket has a bounded number of rows
            border = int(np.searchsorted(keys, keys[-1]))
            if border:
                found = ranges(pa.Table.from_batches([*waiting, cold.slice(0, border)]))
                waiting = [cold.slice(border)]
                if found is not None:
                    yield found
            elif waiting and waiting[-1].column("minimiser")[0].as_py() != keys[0]:
                found = ranges(pa.Table.from_batches(waiting))
                waiting = [cold]
                if found is not None:
                    yield found
            else:
                waiting.append(cold)
        if waiting:
            found = ranges(pa.Table.from_batches(waiting))
            if found is not None:
                yield found

    return run


def _marked(packed: DataFrame, live: DataFrame) -> DataFrame:
    """The super-k-mers whose minimiser may be live, with ``hot``: by bitmaps, or by a shuffle where there are too many minimisers for one."""
    bitmap = key_bitmap(live, "minimiser")
    if bitmap is None:
        return packed.join(live, "minimiser")
    near = with_bitmap(packed, "minimiser", bitmap).where("maybe").drop("maybe")
    return with_bitmap(near, "minimiser", key_bitmap(live.where("hot"), "minimiser"), "hot")


def repeated_windows(keyed: DataFrame, k: int, m: int, hot: int) -> DataFrame:
    """(k1, k2, first, last): ranges of starts of repeated windows of each text, other texts and other places of it considered."""
    place = F.xxhash64("k1", "k2", "start")
    seen = _emit(keyed, k, m, packed=False).groupBy("minimiser").agg(F.count("*").alias("c"), F.min(place).alias("a"), F.max(place).alias("b"))
    live = cut(seen.where("a <> b").select("minimiser", (F.col("c") > hot).alias("hot")))
    sent = _marked(_emit(keyed, k, m, packed=True), live)
    bucket = F.when(F.col("hot"), place).otherwise(F.col("minimiser"))
    dealt = sent.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("minimiser").select("minimiser", "k1", "k2", "start", "windows", "packed", "hot")
    counted = cut(dealt.mapInArrow(_count_bucket(k), "k1 long, k2 long, first int, last int, w1 long, w2 long"))
    spread = counted.where("w1 is not null")
    # cut, so that the join deals out both sides itself and a frequent window's rows can be split between tasks
    here = F.xxhash64("k1", "k2", "first")
    again = cut(spread.groupBy("w1", "w2").agg(F.min(here).alias("a"), F.max(here).alias("b")).where("a <> b").select("w1", "w2"))
    own = ["k1", "k2", "first", "last"]
    return counted.where("w1 is null").select(*own).unionByName(spread.join(again, ["w1", "w2"], "left_semi").select(*own)).distinct()


def _strip(k: int):
    """Removes the covered words and joins the rest by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ranges = batch.column("ranges").to_pylist() if "ranges" in batch.schema.names else [None] * batch.num_rows
            copied = batch.column("copied").to_pylist() if "copied" in batch.schema.names else [False] * batch.num_rows
            totals, removed, kept = [], [], []
            for text, own, twice in zip(texts(batch).to_pylist(), ranges, copied, strict=True):
                words = text.encode("utf-8").split()
                n = len(words)
                if twice and n >= k:
                    left = []
                elif own:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, [r["first"] for r in own], 1)
                    np.add.at(step, [r["last"] + k for r in own], -1)
                    stay = np.flatnonzero(np.cumsum(step[:-1]) == 0)
                    left = [words[i] for i in stay.tolist()]
                else:
                    left = words
                totals.append(n)
                removed.append(n - len(left))
                kept.append(b" ".join(left).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """Every document without the words of repeated windows: ``doc_id n_words n_removed kept``, one row for each row.

    Null and blank texts have no words; texts shorter than ``k`` words lose nothing. Equal texts, also of rows with one id, repeat
    each other. Null ids stay; other columns are not read.
    """
    if not 0 < m <= k:
        raise ValueError("the minimiser has from one word to as many as the window")
    keyed = _keyed(docs)
    copies = keyed.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2", F.lit(True).alias("copied"))
    found = repeated_windows(keyed, k, m, hot)
    ranges = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    affected = cut(copies.join(ranges, ["k1", "k2"], "full_outer").select("k1", "k2", F.coalesce("copied", F.lit(False)).alias("copied"), F.when(F.col("copied").isNull(), F.col("ranges")).alias("ranges")))
    marked = with_bitmap(keyed, "k1", key_bitmap(affected, "k1"))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    whole = marked.where("not maybe").select("doc_id", "text").mapInArrow(_strip(k), schema)
    part = marked.where("maybe").join(affected, ["k1", "k2"], "left").select("doc_id", "text", "ranges", F.coalesce("copied", F.lit(False)).alias("copied")).mapInArrow(_strip(k), schema)
    return whole.unionByName(part)
