"""Filter interaction audit: what each of five document filters removes in every order of applying them.

1. Native expressions give each document a mask of the filters that it fails (bit 0 for A to bit 4 for E). Whether an equal text has a smaller id
   comes from a groupBy on the text's SHA-256, which supplies the smallest id of each text; only digests travel, not texts.
2. The masks are counted: 32 cells for each part, with the counts of good and of toxic documents beside them.
3. All 120 orders are read off the cells. A filter at some step removes the cells that hold its bit and none of the bits before it, so no
   order needs another pass over the documents. Its average removal over the orders (times 120) is a sum over the cells, too: a document that fails f filters
   is removed by each of them in 120 / f orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, stored

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
#: Fixed values of the filters: words of A, percent of B and C, characters of D.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
MARKS = "[#$%&*|]"


def _flag(condition: Column, letter: str) -> Column:
    return F.when(condition, F.lit(1 << LETTERS.index(letter))).otherwise(F.lit(0))


def failure_masks(docs: DataFrame) -> DataFrame:
    """``doc_id part mask`` of every row: the filters A to E that its text fails.

    A null text is empty (it fails A, and E if a smaller id is empty, too); a null source is the part ''. Rows of one id do not repeat each other, rows without
    an id repeat those of equal text that have one. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # arrays and counts are columns of their own, so that a text is split once
    rows = rows.select("doc_id", "part", "text", F.filter(F.split("text", SPACE_RUN), lambda w: w != "").alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    mask = (
        _flag(n < LEAST_WORDS, "A") + _flag(100 * distinct < DISTINCT_PERCENT * n, "B")
        + _flag(100 * capitals > CAPITAL_PERCENT * F.length("text"), "C") + _flag(F.col("text").rlike(MARKS), "D")
    )
    rows = stored(rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("own")))
    # rows meet the first of their text by text and id, so the copies of one text are dealt to many tasks
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumn("is_first", F.lit(True))
    one = rows.join(firsts, (rows["digest"] == firsts["digest"]) & rows["doc_id"].eqNullSafe(firsts["first"]), "left")
    return one.select("doc_id", "part", (F.col("own") + _flag(F.col("is_first").isNull(), "E")).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part: arrays of 32 counts of documents, of good (quality 1) and of toxic ones (toxic 1), by mask. An id counts as good or toxic if any of its labels says so."""
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "bad")))).where("good + bad > 0")
    cells = masks.join(marked, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("bad") == 1).alias("bad"))

    def spread(name: str) -> Column:
        return F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == k, F.col(name))), F.lit(0)).cast("long") for k in range(MASKS))).alias(name)

    return cells.groupBy("part").agg(spread("n"), spread("good"), spread("bad"))


def _over(cells: str, chosen: str, weight: str = "1") -> Column:
    """Sum of the cells whose mask k meets ``chosen``."""
    return F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (t, k) -> t + IF({chosen}, {cells}[k] * {weight}, 0L))")


def order_report(cells: DataFrame) -> DataFrame:
    """600 rows a part: ``part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley``."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.expr(f"sequence(1, {len(LETTERS)})")))
    bit = f"shiftleft(1, ascii(substring(filter_order, {{}}, 1)) - {ord('A')})"
    steps = steps.withColumns({"bit": F.expr(bit.format("step")), "before": F.expr(f"aggregate(filter(sequence(1, {len(LETTERS)}), j -> j < step), 0, (m, j) -> m | {bit.format('j')})")})
    removed = "(k & before) = 0 AND (k & bit) <> 0"
    return steps.select(
        "part", "filter_order", "step",
        _over("n", "(k & (before | bit)) = 0").alias("kept"),
        _over("n", removed).alias("removed"),
        _over("n", "(k & before) <> 0 AND (k & bit) <> 0").alias("redundant"),
        F.expr("n[bit]").alias("unique_fails"),
        _over("good", removed).alias("good_lost"),
        _over("bad", removed).alias("toxic_lost"),
        _over("n", "(k & bit) <> 0", "(120 div bit_count(k))").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report over ``docs``: see `order_report`. Parts are the values of ``source``; without documents there are no rows, without labels nothing is good or toxic.

    Odd rows are read as in `failure_masks`; repeated rows count as often as they occur; null labels say nothing.
    """
    return order_report(mask_cells(failure_masks(docs), labels))
