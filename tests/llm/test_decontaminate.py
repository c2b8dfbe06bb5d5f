"""Decontamination: the radius that the blocks guarantee, short items, broadcasts by size, and a hot passage."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as d

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [f"w{rng.randint(0, 3000)}" for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def plain(texts, benchmark, threshold=0.8):
    """Best similarity of every pair over all windows, by counting shingles."""
    found = {}
    for j, item in enumerate(benchmark):
        b = item.lower().split()
        width = min(5, len(b))
        own = [tuple(b[i : i + width]) for i in range(len(b) - width + 1)]
        n = len(own)
        for k, text in enumerate(texts):
            a = text.lower().split()
            every = [tuple(a[i : i + width]) for i in range(len(a) - width + 1)]
            best = 0.0
            for s in range(max(1, len(every) - n + 1)):
                window = every[s : s + n]
                common = sum(min(window.count(x), own.count(x)) for x in set(window))
                best = max(best, common / (len(window) + n - common) if window else 0.0)
            if n and best >= threshold - 1e-12:
                found[k, j] = round(best, 9)
    return found


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        at = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.4:
            w[at] = f"x{rng.randint(0, 10**6)}"
        elif kind < 0.7:
            del w[at]
        else:
            w.insert(at, f"y{rng.randint(0, 10**6)}")
    return " ".join(w)


def test_recall_about_the_threshold(spark):
    rng = random.Random(4)
    bench = [" ".join(words(rng, n)) for n in (3, 5, 6, 8, 9, 12, 15, 19, 20, 21, 25, 33, 40, 59, 70, 90, 140)] + ["a a a a a a a a a", "to be or not to be or not to be or not to be"]
    texts = []
    for item in bench:
        for _ in range(8):
            own = edited(rng, item, rng.randint(0, 1 + len(item.split()) // 25))
            texts.append(" ".join(words(rng, rng.randint(0, 40))) + " " + own + " " + " ".join(words(rng, rng.randint(0, 40))) if rng.random() < 0.8 else own)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in d.find_contamination(table(spark, texts).repartition(3), items(spark, bench)).collect()}
    expected = plain(texts, bench)
    assert got == expected and len(expected) > 50


@pytest.mark.parametrize("size", [30, 100])
def test_every_fingerprint_within_the_radius_meets(spark, size):
    """Flips spread over the blocks as evenly as can be, the worst case for blocks that must nearly agree, and at random."""
    rng = random.Random(size)
    text = " ".join(words(rng, size))
    item = items(spark, [text]).select("item_id", d._words(F.col("text")).alias("w")).select("item_id", F.size("w").alias("n_words"), d._shingles(F.col("w"), 5).alias("shingles"))
    lane = 8 if size < 64 else 16
    item = item.select("item_id", "n_words", F.size("shingles").alias("n"), "shingles", F.xxhash64("shingles").alias("own")).cache()
    n = item.first().n
    near = table(spark, [text]).selectExpr("doc_id", "1L AS row_key", "2L AS row_check", f"array({n}) AS lengths").crossJoin(item.select(F.col("shingles").alias("all")))
    (window,) = d._windows(near, item.select("n", F.explode("shingles").alias("h")).distinct(), F.broadcast, lane, 0.8).collect()
    places = [at + lane - 2 - j for at in range(0, 64, lane) for j in range(8 * lane // 64)]
    rows = []
    for apart in range(0, d.RADIUS + 4):
        for trial in range(6):
            if trial < 3:
                blocks = [(k % 32) for k in range(apart)]
                flips = [(b, blocks[:k].count(b)) for k, b in enumerate(blocks)]
                chosen = [(b, rng.sample(places, 8)) for b in range(32)]
                flips = [(b, chosen[b][1][k]) for b, k in flips]
            else:
                flips = rng.sample([(b, p) for b in range(32) for p in places], apart)
            fp = list(window.fp)
            for b, p in flips:
                fp[b] ^= 1 << p
            rows.append((apart * 10 + trial, 0, n, n, 0, fp))
    moved = spark.createDataFrame(rows, "row_key long, row_check long, n int, m int, start int, fp array<long>").withColumn("n", F.lit(n))
    met = {r.row_key for r in d._by_blocks(moved, item, lane, 1).collect()}
    assert met == {apart * 10 + trial for apart in range(d.RADIUS + 1) for trial in range(6)}


def test_tables_over_the_bound_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    bench = [" ".join(words(rng, 30)) for _ in range(20)]
    texts = [" ".join(words(rng, 20)) + " " + bench[i % 20] for i in range(40)]
    before = sorted(map(str, d.find_contamination(table(spark, texts), items(spark, bench)).collect()))
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = d.find_contamination(table(spark, texts), items(spark, bench))
        assert "ResolvedHint (strategy=broadcast)" not in out._jdf.queryExecution().toString()
        assert sorted(map(str, out.collect())) == before and len(before) == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_passage_that_most_documents_hold(spark):
    """A hot passage is an item itself, and its shingles are in every document and in several items."""
    rng = random.Random(7)
    hot = " ".join(words(rng, 40))
    bench = [hot, edited(rng, hot, 1), " ".join(words(rng, 12)) + " " + hot]
    texts = [" ".join(words(rng, 15)) + " " + (hot if i % 3 else edited(rng, hot, 2)) + " " + " ".join(words(rng, 15)) for i in range(90)]
    docs, marks = table(spark, texts).repartition(4), items(spark, bench)
    got = {(r.doc_id, r.item_id) for r in d.find_contamination(docs, marks).collect()}
    assert got == set(plain(texts, bench))
    clean = spark.createDataFrame([(1000, "nothing of the kind in this text at all", None, None, None), (None, None, None, None, None)], SCHEMA)
    left = d.drop_contaminated(docs.unionByName(clean).selectExpr("*", "1 AS maybe", "2 AS row_key"), marks)
    assert {r.doc_id for r in left.collect()} == {1000, None} | ({i for i in range(90)} - {k for k, _ in got}) and left.columns[-2:] == ["maybe", "row_key"]
