"""Benchmark decontamination, in DataFrame operations only.

A document is contaminated by an item if one of its windows, as long as the item in words, has a fingerprint near the
item's and the weighted Jaccard similarity of their word shingles (a shingle weighs as often as it occurs) is at
least ``threshold``. A document shorter than the item is one window. Texts are lower-cased; words are runs of anything but ASCII white
space; shingles have five words, or all words of a shorter item.

1. A window that is similar enough has all but a few of the item's n shingles, so it holds one of them at one of every ``stride``
   places, whatever its offset. Only documents with such a hit go on, with the lengths n of the items they hit. Of their windows only those go on that hold as many shingles of items of
   their length as a similar window must share. Neither loses anything.
2. Each of these windows gets a 256-bit SimHash. The bits are counted in lanes of longs that a
   window frame adds up; the frame's reach follows from the row, as rows are ordered by place divided by n.
3. Multi-index Hamming join over 32 blocks of 8 bits: an item stands under every value within one bit of each of its blocks, a window under its own blocks. Two fingerprints that
   meet nowhere differ in two bits of every block, so all within ``RADIUS`` = 63 bits meet for certain. At similarity 0.8 they are some 39 bits apart; fewer than 3 in 10,000 pairs that just reach
   it are beyond the radius. In items of fewer than ``EXACT_BELOW`` shingles one shingle moves many bits, so windows of these meet the items by their shingles instead.
4. Each candidate is verified with the exact weighted similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, cut, free_name, key_bitmap, with_bitmap

WIDTH, THRESHOLD = 5, 0.8
#: Bits of a fingerprint and of a block; an item's blocks stand under all values within ``NEAR`` bits, which makes every pair up to ``RADIUS`` bits apart meet.
BITS, BLOCK, NEAR = 256, 8, 1
RADIUS = BITS // BLOCK * (NEAR + 1) - 1
#: Items of fewer shingles are compared without fingerprints.
EXACT_BELOW = 16
#: Bytes up to which a table is broadcast, at ``ROW_BYTES`` for a row of some numbers; a larger one is joined by shuffle.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 32


def _words(text: Column) -> Column:
    """Words of a lower-cased text; null or blank: none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE_RUN), lambda w: w != "")


def _shingles(words: Column, width: int, step: int = 1) -> Column:
    """Hashes of the shingles that start at every ``step``-th word."""
    places = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(width))))


def _row_keys(doc_id: Column, text: Column) -> dict[str, Column]:
    """128 bits that stand for a row."""
    return {"row_key": F.xxhash64(doc_id, text), "row_check": F.xxhash64(F.lit(1), text, doc_id)}


def _lane(longest: int) -> int:
    """Bits of a counter: the count of up to ``longest`` shingles leaves its two highest bits alone."""
    return next(w for w in (8, 16, 32) if longest < 1 << (w - 2))


def _every_lane(value: int, lane: int) -> Column:
    return F.lit(sum(value << at for at in range(0, 64, lane))).cast("long")


def _longs(lane: int) -> int:
    return BITS * lane // 64


def _bits_of(h: Column, k: int, lane: int) -> Column:
    """One random bit of the shingle in each lane of the k-th long."""
    return F.xxhash64(h, F.lit(k)).bitwiseAND(_every_lane(1, lane))


def _blocks(sums: list[Column], m: Column, lane: int) -> Column:
    """The fingerprint, one block a long: a bit is set if it is set in more than half of the m shingles."""
    half = ((1 << (lane - 2)) - 1 - F.floor(m / 2).cast("long")) * _every_lane(1, lane)
    over = [(x + half).bitwiseAND(_every_lane(1 << (lane - 2), lane)) for x in sums]
    each = BLOCK * lane // 64
    out = []
    for b in range(BITS // BLOCK):
        block = over[b * each]
        for j in range(1, each):
            block = block.bitwiseOR(F.shiftrightunsigned(over[b * each + j], j))
        out.append(block)
    return F.array(*out)


def _apart(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(BITS // BLOCK)))


def _overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    often = F.aggregate(F.array_distinct(a), F.lit(0), lambda t, h: t + F.least(F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h))))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(often)


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of documents and benchmark items that they contain: ``doc_id row_key row_check item_id n_words start similarity``.

    ``start`` is the first word of the most similar window (the earliest on a tie); ``row_key`` and ``row_check`` are hashes of doc_id and text, so that
    null and repeated ids stay apart; rows equal in both give one row. Null and blank texts or items match nothing; an item that occurs
    twice under one id counts once. Items without an id are left out. Empty tables give no rows. Other columns are not read.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # words are a column of their own: inside the lambdas of _shingles the split would run once a place
    keyed = docs.select(doc_id.alias("doc_id"), *(x.alias(c) for c, x in _row_keys(doc_id, text).items()), text.alias("text"))
    items = cut(benchmark.where(F.col("item_id").isNotNull()).select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0).select("item_id", "words", F.size("words").alias("n_words")).dropDuplicates(["item_id", "words"]))
    # one row for each width and lane: a few
    n = F.col("n_words") - F.least("n_words", F.lit(WIDTH)) + 1
    items = items.select("*", F.least("n_words", F.lit(WIDTH)).alias("width"), n.alias("n")).withColumn("lane", F.when(F.col("n") < 64, 8).when(F.col("n") < 16384, 16).otherwise(32))
    kinds = items.groupBy("width", "lane").agg(F.sum("n").alias("total"), F.count("*").alias("items"), F.min(F.expr(f"int(n div (n - ceil(n * {2 * threshold / (1 + threshold)} - 1e-9) + 1))")).alias("stride")).collect()
    parts = [_of_kind(keyed, items.where((F.col("width") == r["width"]) & (F.col("lane") == r["lane"])), r["width"], r["lane"], max(1, r["stride"]), r["total"], r["items"], threshold) for r in kinds]
    if not parts:
        return keyed.where("false").select("doc_id", "row_key", "row_check", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("n_words"), F.lit(0).cast("long").alias("start"), F.lit(0.0).alias("similarity"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    best = out.groupBy("row_key", "row_check", "doc_id", "item_id").agg(F.max_by(F.struct("n_words", "start", "similarity"), F.struct("similarity", -F.col("start"))).alias("m"))
    return best.select("doc_id", "row_key", "row_check", "item_id", "m.*")


def _small(rows: int) -> bool:
    return rows * ROW_BYTES <= BROADCAST_BYTES


def _of_kind(keyed: DataFrame, items: DataFrame, width: int, lane: int, stride: int, total: int, count: int, threshold: float) -> DataFrame:
    """The pairs of items of one shingle width and lane: ``total`` shingles in ``count`` items."""
    hint = F.broadcast if _small(total) else (lambda df: df)
    items = cut(items.select("item_id", "n_words", "n", _shingles(F.col("words"), width).alias("shingles")).withColumn("own", F.xxhash64("shingles")))
    known = items.select("n", F.explode("shingles").alias("h")).distinct()

    sampled = keyed.select("row_key", _words(F.col("text")).alias("words")).select("row_key", F.explode(_shingles(F.col("words"), width, stride)).alias("h"))
    hit = cut(sampled.join(hint(known), "h").groupBy("row_key").agg(F.collect_set("n").alias("lengths")))
    held = with_bitmap(keyed, "row_key", key_bitmap(hit, "row_key")).where("maybe").drop("maybe")
    near = held.join(hit, "row_key").dropDuplicates(["row_key", "row_check"]).select("doc_id", "row_key", "row_check", "lengths", _words(F.col("text")).alias("words"))
    near = cut(near.select("doc_id", "row_key", "row_check", "lengths", _shingles(F.col("words"), width).alias("all")))

    windows = cut(_windows(near, known, hint, lane, threshold))
    pairs = _by_shingles(windows, near, items).unionByName(_by_blocks(windows, items, lane, count))
    shingles = items.select("item_id", "n_words", "own", F.col("shingles").alias("item_shingles"))
    both = pairs.join(near, ["row_key", "row_check"]).join(hint(shingles), ["item_id", "n_words", "own"])
    common = _overlap(F.expr("slice(all, start + 1, m)"), F.col("item_shingles"))
    found = both.select("doc_id", "row_key", "row_check", "item_id", "n_words", F.col("start").cast("long").alias("start"), (common / (F.col("m") + F.col("n") - common)).alias("similarity"))
    return found.where(F.col("similarity") >= threshold)


def _windows(near: DataFrame, known: DataFrame, hint, lane: int, threshold: float) -> DataFrame:
    """row_key, row_check, n, m, start and the fingerprint of every window of m shingles that holds enough shingles of items of n shingles to be similar to one."""
    least = F.ceil(F.col("n") * threshold - 1e-9)
    places = near.select("row_key", "row_check", "all", F.size("all").alias("size"), F.explode("lengths").alias("n")).where(F.col("size") >= least)
    places = places.select("row_key", "row_check", "n", "size", F.posexplode("all").alias("at", "h")).join(hint(known.withColumn("own", F.lit(1))), ["n", "h"], "left")
    dealt = places.withColumn("x", F.col("at") / F.col("n")).repartition("row_key", "row_check", "n").sortWithinPartitions("row_key", "row_check", "n", "x")
    reach = 1 - (1e-5 if lane < 32 else 1e-8)
    line = "OVER (PARTITION BY row_key, row_check, n ORDER BY x RANGE BETWEEN"
    behind, ahead = f"{line} {reach}D PRECEDING AND CURRENT ROW)", f"{line} CURRENT ROW AND {reach}D FOLLOWING)"
    m = F.least(F.col("at") + 1, F.col("n"))
    whole = (F.col("at") + 1 >= F.col("n")) | (F.col("at") + 1 == F.col("size"))
    shared = F.ceil((m + F.col("n")) * (threshold / (1 + threshold)) - 1e-9)
    held = dealt.select("*", F.expr(f"count(own) {behind}").alias("held")).withColumn("passes", whole & (F.col("held") >= shared))
    # only places of windows that pass are summed
    part = held.select("*", F.expr(f"max(passes) {ahead}").alias("part")).where("part").withColumns({f"s{k}": _bits_of(F.col("h"), k, lane) for k in range(_longs(lane))})
    summed = part.select("row_key", "row_check", "n", "at", "passes", *(F.expr(f"sum(s{k}) {behind}").alias(f"s{k}") for k in range(_longs(lane)))).where("passes").withColumn("m", m)
    return summed.select("row_key", "row_check", "n", "m", (F.col("at") + 1 - F.col("m")).alias("start"), _blocks([F.col(f"s{k}") for k in range(_longs(lane))], F.col("m"), lane).alias("fp"))


PAIR = ["row_key", "row_check", "n", "m", "start", "item_id", "n_words", "own"]


def _by_shingles(windows: DataFrame, near: DataFrame, items: DataFrame) -> DataFrame:
    """Windows and short items that share a shingle."""
    short = windows.where(F.col("n") < EXACT_BELOW).drop("fp").join(near.select("row_key", "row_check", "all"), ["row_key", "row_check"])
    each = short.select("row_key", "row_check", "n", "m", "start", F.explode(F.array_distinct(F.expr("slice(all, start + 1, m)"))).alias("h"))
    marks = items.where(F.col("n") < EXACT_BELOW).select("item_id", "n_words", "own", "n", F.explode(F.array_distinct("shingles")).alias("h"))
    return each.join(marks, ["n", "h"]).select(*PAIR).distinct()


def _near_values(bits: Column, lane: int) -> Column:
    """All values of a block within one bit. A block's bits stand in a long as ``_blocks`` puts them: from each lane's second highest bit down."""
    top = lane - 2
    each = [at + top - j for at in range(0, 64, lane) for j in range(BLOCK * lane // 64)]
    return F.array(bits, *(bits.bitwiseXOR(F.lit(1 << k).cast("long")) for k in each))


def _by_blocks(windows: DataFrame, items: DataFrame, lane: int, count: int) -> DataFrame:
    """Windows and items of one length whose fingerprints are within the radius."""
    hint = F.broadcast if _small(count * (BITS // BLOCK) * (BLOCK + 1)) else (lambda df: df)
    marks = items.where(F.col("n") >= EXACT_BELOW).select("item_id", "n", "n_words", "own", F.explode("shingles").alias("h"))
    sums = marks.groupBy("item_id", "n", "n_words", "own").agg(*(F.sum(_bits_of(F.col("h"), k, lane)).alias(f"s{k}") for k in range(_longs(lane))))
    prints = cut(sums.select("item_id", "n", "n_words", "own", _blocks([F.col(f"s{k}") for k in range(_longs(lane))], F.col("n"), lane).alias("item_fp")))
    # keys without fingerprints, which are fetched once for each pair
    theirs = prints.select("item_id", "n", "n_words", "own", F.posexplode("item_fp").alias("block", "b")).select("item_id", "n", "n_words", "own", "block", F.explode(_near_values(F.col("b"), lane)).alias("bits"))
    ours = windows.where(F.col("n") >= EXACT_BELOW).select("*", F.posexplode("fp").alias("block", "bits"))
    met = ours.join(hint(theirs), ["n", "block", "bits"]).drop("block", "bits").dropDuplicates(PAIR)
    fetch = F.broadcast if _small(count * (BITS // BLOCK)) else (lambda df: df)
    return met.join(fetch(prints), ["item_id", "n", "n_words", "own"]).where(_apart("fp", "item_fp") <= RADIUS).select(*PAIR)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that contain no benchmark item. Only rows that may be among those found are shuffled."""
    names = {c: free_name(docs, c) for c in ("row_key", "row_check")}
    found = cut(find_contamination(docs, benchmark, threshold).select(*(F.col(c).alias(x) for c, x in names.items())).distinct())
    keys = _row_keys(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    maybe = free_name(docs, "maybe")
    marked = with_bitmap(docs.withColumns({names[c]: x for c, x in keys.items()}), names["row_key"], key_bitmap(found, names["row_key"]), maybe)
    left = marked.where(F.col(maybe)).join(found, list(names.values()), "left_anti").select(*docs.columns)
    return marked.where(~F.col(maybe)).select(*docs.columns).unionByName(left)
