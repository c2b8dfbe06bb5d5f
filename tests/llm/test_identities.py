"""Rows, texts and sets whose first hashes are equal must not be taken for each other."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def test_texts_of_one_first_hash_keep_their_own_ranges(spark, monkeypatch):
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    shared = words(50)
    rows = [(i, " ".join(words(30) + (shared[: 36 + i] if i % 2 else words(45)) + words(20))) for i in range(12)] + [(20, rows_text := " ".join(words(40))), (21, rows_text), (22, " ".join(words(5)))]
    docs = table(spark, rows)
    before = sorted(map(str, substring_dedup.dedup_substrings(docs).collect()))
    real = substring_dedup._keyed
    monkeypatch.setattr(substring_dedup, "_keyed", lambda d: real(d).withColumn("k1", F.lit(7).cast("long")))
    assert sorted(map(str, substring_dedup.dedup_substrings(docs).collect())) == before
    assert sum("n_removed=0" not in r for r in before) >= 8


def test_rows_of_one_hash_keep_their_own_lines(spark, monkeypatch):
    rng = random.Random(2)
    line = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(8))
    often = line().split()
    rows = []
    for i in range(12):
        near = list(often)
        near[i % 8] = f"x{i}"
        rows.append((i, "\n".join([line(), " ".join(near if i % 2 else often), "", line()])))
    docs = table(spark, [*rows, (None, "\n".join([line(), " ".join(often)])), (3, line())])
    before = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(docs).collect())
    real = line_dedup._keyed
    one_hash = lambda d, carry: real(d, carry).withColumn("row_key", F.when((F.col("doc_id") == 3) & ~F.col("text").contains("\n"), 8).otherwise(7).cast("long"))
    monkeypatch.setattr(line_dedup, "_keyed", one_hash)
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(docs).collect()) == before
    assert sum(r[2] for r in before) >= 10


def test_sets_of_one_first_hash_get_names_of_their_own(spark):
    base = spark.createDataFrame([(1, 5, 50), (2, 5, 51), (3, 5, 50), (4, 6, 60), (5, None, 0), (6, -7, 70), (7, -7, 71)], "doc_id long, node long, set_check long")
    named, shared = ngram_join._told_apart(base)
    assert {r.doc_id: r.node for r in named.collect()} == {1: 50, 2: 51, 3: 50, 4: 6, 5: None, 6: 70, 7: 71}
    assert shared == {5, 2**64 - 7} and "set_check" not in named.columns
    sets = np.array([3, 9], np.uint64)
    assert ngram_join.node_of(sets, frozenset([ngram_join.node_of(sets)])) == ngram_join.check_of(sets) != ngram_join.node_of(sets)
    assert ngram_join._told_apart(base.where("doc_id > 3 and doc_id < 6"))[1] == frozenset()
