"""Shared helpers: table access, Arrow batch slicing, word hashing and lineage cuts."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import cut, shared_folder

#: ASCII white space, the only word separators of the operators here.
SPACE = " \t\n\r\x0b\x0c"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder. Unlike a checkpoint it takes its size from its files: the sizes that are
    estimated for joins are products, which in a loop soon have more digits than the planner can multiply."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the frame does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def release() -> None:
    """Give memory that a task has freed back to the system: its worker lives on and runs tasks of other kinds beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each piece stays near ``max_bytes`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > at and total + size > max_bytes:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += size
        yield batch.slice(at)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with nulls read as empty."""
    return pc.fill_null(batch.column(column), "")


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of an Arrow string array, equal on every machine."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x) for x in values.to_pylist()), dtype=np.uint64, count=len(values))


def words_of(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words (runs of anything but ASCII white space) of each text, dictionary encoded, and their row numbers."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(text), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.not_equal(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    return flat.filter(full).dictionary_encode(), rows[keep]


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the texts, and offsets (one more than texts) of each text's words."""
    words, rows = words_of(text)
    hashes = hash_strings(words.dictionary)[words.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    return hashes, np.searchsorted(rows, np.arange(len(text) + 1))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift multiply)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` consecutive word hashes that start at each place (``len - width + 1`` of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out + hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's signed longs."""
    return pa.array(x.view(np.int64), pa.int64())


def trained_fold(doc_id: str = "doc_id"):
    """Rows that a model may learn labels from: crc32 of the id as text, mod 5, is not 0."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) != 0


def local_path(path: str) -> str:
    """A vocabulary file's local path; tokenizer files are installed on every node."""
    return os.path.expanduser(path)


#: Bits of a key bitmap for each key, the most bits of one (32 MB) and those of one row of it.
BITS_EACH, MOST_BITS, ROW_BITS = 16, 1 << 28, 1 << 15


def key_bitmap(keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> tuple[int, DataFrame] | None:
    """A set of 64-bit hashes as a bitmap (its bits, rows of ``_row`` and ``_words``), sized by their count; ``keys`` should be cheap to read twice.

    Like a Bloom filter with one hash it may say yes to a key that is not in the set, never no to one that is; it spares rows a
    shuffle before an exact join. With too many keys for ``most_bits`` there is none: every row then goes through the shuffle.
    """
    count = keys.count()
    if count * 4 > most_bits:
        return None
    bits = max(ROW_BITS, min(most_bits, 1 << (count * BITS_EACH - 1).bit_length()))
    row, bit = _bit_place(key, bits)
    rows = keys.groupBy(row.alias("_row")).agg(F.bitmap_construct_agg(bit.cast("long")).alias("_packed"))
    words = F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1)), lambda i: F.conv(F.hex(F.substring(F.col("_packed"), i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    return bits, rows.select("_row", words.alias("_words"))


def _bit_place(key: str, bits: int) -> tuple[Column, Column]:
    place = F.pmod(F.col(key), F.lit(bits).cast("long"))
    return F.shiftright(place, 15).cast("int"), place.bitwiseAND(F.lit(ROW_BITS - 1).cast("long")).cast("int")


def with_bitmap(df: DataFrame, key: str, bitmap: tuple[int, DataFrame] | None, name: str = "maybe") -> DataFrame:
    """Adds a boolean: false if the key is surely not in the bitmap's set. Without a bitmap nothing is sure."""
    if bitmap is None:
        return df.withColumn(name, F.lit(True))
    row, bit = _bit_place(key, bitmap[0])
    joined = df.withColumns({"_row": row, "_bit": bit}).join(F.broadcast(bitmap[1]), "_row", "left")
    # the bitmap's bytes stand in their longs from the highest down
    found = F.expr("shiftright(get(_words, shiftright(_bit, 6)), 56 - (shiftright(_bit, 3) & 7) * 8 + (_bit & 7)) & 1L") == 1
    return joined.withColumn(name, F.coalesce(found, F.lit(False))).drop("_row", "_bit", "_words")


def among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is one of ``keys``, and at times a few others: by a bitmap, or by a shuffle where the keys are too many for one."""
    bitmap = key_bitmap(keys, key)
    if bitmap is None:
        return df.join(keys.select(key).distinct(), key, "left_semi")
    return with_bitmap(df, key, bitmap, "_maybe").where("_maybe").drop("_maybe")
