"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is what stands between ``\\n``, trimmed of ASCII white space; its words stand between single spaces. A line goes if an
earlier line (by doc_id, then place) of the corpus is equal to it, or differs by one word: one replaced, put in or left
out. The second rule holds between lines of ``min_words`` words or more: from five words on such lines are alike to 0.8 or more,
in shorter ones a changed word is a larger part. Whether the earlier line itself stays
does not matter. Blank lines stay.

1. Equal lines meet by a 128-bit hash, counted before the shuffle, so a line that a third of the corpus repeats
   costs one row in each map task.
2. One edited word leaves the first or the last half of the words as it was. Lines that share such a half with another
   distinct line go on; the rest have no neighbour. Two to four hashes a line decide that.
3. Those lines emit their deletion neighbourhood: for each word the hash of the line without it, by running XORs of placed
   word hashes (constant work a variant, whatever the line's length), and the hash of the whole line.
4. Equal variants meet. Lines with the same variant at the same place are all one replacement apart, a line and a variant
   equal to it are one insertion apart; so each variant needs only its earliest line, found by partial aggregation, and the
   number of pairs is that of the variants. The edit distance of each pair is then verified on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, among, cut, key_bitmap, with_bitmap

MIN_WORDS = 5


def _keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """doc_id, text (null: empty) and a hash of both. A row is told by the id and the hash together (``row``), so only texts of one id could be taken for each other; rows equal in both are one document. ``more``: columns that come along."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("row_key"), more.alias("more"))


def _row() -> Column:
    """What tells a row: null ids are equal in it."""
    return F.struct("doc_id", "row_key").alias("row")


def _place(line_no: Column) -> Column:
    """Order of lines: doc_id (nulls last), row, line."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", line_no.alias("line_no"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one replaced, inserted or deleted word apart."""

    def common(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        at = F.array_position(same, False)
        return F.when(at > 0, at - 1).otherwise(F.least(F.size(x), F.size(y)))

    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longer - 1)


def distinct_lines(keyed: DataFrame) -> DataFrame:
    """Each distinct line that is not blank: its first place (no_id, doc_id, row_key, line_no), its number of words and the hashes of its halves."""
    lines = keyed.select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = lines.select(_place(F.col("line_no")).alias("place"), F.btrim("raw", F.lit(SPACE)).alias("line")).where("line <> ''")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = lines.select("place", "line", words.alias("n")).withColumns({"low": F.expr("int((n - 1) div 2)"), "high": F.expr("int(n div 2)")})
    halves = F.expr("""array_distinct(array(
        xxhash64('first', low, substring_index(line, ' ', low)), xxhash64('last', low, substring_index(line, ' ', -low)),
        xxhash64('first', high, substring_index(line, ' ', high)), xxhash64('last', high, substring_index(line, ' ', -high))))""")
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), "place", "n", halves.alias("halves"))
    return hashed.groupBy("h1", "h2").agg(F.min(F.struct("place", "n", "halves")).alias("m")).select("m.place.*", "m.n", "m.halves")


def neighbours(keyed: DataFrame, firsts: DataFrame, min_words: int) -> DataFrame:
    """The distinct lines that share a half with another: ``place`` and ``words``."""
    halves = firsts.where(F.col("n") >= min_words).select("doc_id", "row_key", "line_no", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    live = cut(halves.join(shared, "half", "left_semi").groupBy("doc_id", "row_key").agg(F.collect_set("line_no").alias("wanted")))
    near = with_bitmap(keyed.drop("more"), "row_key", key_bitmap(live, "row_key")).where("maybe").drop("maybe")
    found = near.withColumn("row", _row()).join(live.select(_row(), "wanted"), "row").dropDuplicates(["doc_id", "row_key"]).select("doc_id", "row_key", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("line_no"))
    return cut(found.select(_place(F.col("line_no")).alias("place"), F.split(F.btrim(F.expr("lines[line_no]"), F.lit(SPACE)), " ").alias("words")))


def variants(lines: DataFrame) -> DataFrame:
    """The deletion neighbourhood: (key, size, gap) of the line without each word, and of the whole line with gap -1."""
    w = lines.select(F.xxhash64("place").alias("line"), "place", F.size("words").alias("n"), F.posexplode("words").alias("i", "w"))
    w = w.select("line", "place", "n", "i", F.xxhash64("w", "i").alias("here"), F.xxhash64("w", F.col("i") - 1).alias("moved"))
    line_of = Window.partitionBy("line", "place").orderBy("i")
    before, upto, whole = line_of.rowsBetween(Window.unboundedPreceding, -1), line_of.rowsBetween(Window.unboundedPreceding, 0), line_of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.select("place", "n", "i", F.coalesce(F.bit_xor("here").over(before), F.lit(0)).alias("head"), F.bit_xor("moved").over(upto).alias("passed"), F.bit_xor("moved").over(whole).alias("all_moved"), F.bit_xor("here").over(whole).alias("all_here"))
    without = F.col("head").bitwiseXOR(F.col("passed")).bitwiseXOR(F.col("all_moved"))
    both = F.array(
        F.struct(without.alias("key"), (F.col("n") - 1).alias("size"), F.col("i").alias("gap")),
        F.when(F.col("i") == 0, F.struct(F.col("all_here").alias("key"), F.col("n").alias("size"), F.lit(-1).alias("gap"))),
    )
    return w.select("place", F.explode(both).alias("v")).where("v is not null").select("place", "v.*")


def near_lines(keyed: DataFrame, firsts: DataFrame, min_words: int) -> DataFrame:
    """Places of distinct lines that differ by one word from an earlier line."""
    lines = neighbours(keyed, firsts, min_words)
    every = variants(lines)
    # most variants meet no other; those whose key occurs once stay out of the joins
    shared = cut(every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    every = cut(among(every, "key", shared))
    at_gap = every.where("gap >= 0").groupBy("key", "size", "gap").agg(F.min("place").alias("earliest"), F.count("*").alias("c")).where("c > 1").drop("c")
    replaced = every.join(at_gap, ["key", "size", "gap"]).where("earliest < place").select("place", "earliest")
    either = every.groupBy("key", "size").agg(F.min(F.when(F.col("gap") < 0, F.col("place"))).alias("full"), F.min(F.when(F.col("gap") >= 0, F.col("place"))).alias("short")).where("full is not null and short is not null")
    other = F.when(F.col("gap") < 0, F.col("short")).otherwise(F.col("full"))
    inserted = every.join(either, ["key", "size"]).select("place", other.alias("earliest")).where("earliest < place")
    pairs = replaced.unionByName(inserted).distinct()
    own, theirs = lines.select("place", F.col("words").alias("own")), lines.select(F.col("place").alias("earliest"), F.col("words").alias("theirs"))
    return pairs.join(own, "place").join(theirs, "earliest").where(one_edit(F.col("own"), F.col("theirs"))).select("place").distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, carry: list[str] | None = None) -> DataFrame:
    """The documents without repeated and near-repeated lines.

    Returns ``doc_id row_key n_lines n_removed text``, one row for each row. A null text counts as empty (one blank line,
    nothing removed). Rows equal in id and text are one document and keep the same lines. A null doc_id comes last
    in the order. Columns named in ``carry`` follow; others are not read. Lines of any length take work in proportion to their length.
    """
    keyed = _keyed(docs, carry or [])
    firsts = cut(distinct_lines(keyed))
    near = near_lines(keyed, firsts, min_words)
    gone = near.select("place.doc_id", "place.row_key", "place.line_no").select(_row(), "line_no")
    kept = firsts.select("doc_id", "row_key", _row(), "line_no").join(gone, ["row", "line_no"], "left_anti").groupBy("doc_id", "row_key").agg(F.collect_list("line_no").alias("kept"))
    rebuilt = _rebuilt(keyed, cut(kept))
    return rebuilt.select("doc_id", "row_key", "n_lines", "n_removed", "text", *(F.col(f"more.{c}").alias(c) for c in carry or []))


def _rebuilt(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """The texts of the kept and the blank lines. Only documents that may lose a line are joined; the rest pass as they are."""
    lines = F.split("text", "\n")
    full = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counted = keyed.select(_row(), F.size(full).alias("n")).where("n > 0").distinct()
    changed = cut(counted.join(kept.select(_row(), F.size("kept").alias("k")), "row", "left").where("k is null or k < n").select("row.row_key"))
    marked = with_bitmap(keyed, "row_key", key_bitmap(changed, "row_key"))
    whole = marked.where("not maybe").select("doc_id", "row_key", F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), "text", "more")
    joined = marked.where("maybe").withColumn("row", _row()).join(kept.select(_row(), "kept"), "row", "left").select("doc_id", "row_key", "more", lines.alias("lines"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))
    blank = F.filter(F.transform("lines", lambda x, i: F.when(F.btrim(x, F.lit(SPACE)) == "", i)), lambda i: i.isNotNull())
    stay = joined.withColumn("stay", F.array_sort(F.concat("kept", blank))).withColumn("stay", F.expr("transform(stay, i -> lines[i])"))
    cleaned = stay.select("doc_id", "row_key", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_removed"), F.array_join("stay", "\n").alias("text"), "more")
    return whole.unionByName(cleaned)
