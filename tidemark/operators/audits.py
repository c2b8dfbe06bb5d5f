"""Checks before and around a run: contracts, peers, sets, archives, sources that fail alone, chronological windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_peer(rows: DataFrame, peer: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Joins each row's frozen peer; a row without one fails the job when it is reached, rather than going missing. ``peer`` has one row a key."""
    marked = rows.join(peer.select(*keys, *values, F.lit(True).alias("_there")), keys, "left")
    told = F.raise_error(F.concat(F.lit("no peer for "), F.to_json(F.struct(*keys)))).cast("boolean")
    return marked.where(F.coalesce("_there", told)).drop("_there")


def set_relation(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: distinct keys only in a, only in b and in both, and whether the sets are equal, a within b, or disjoint."""
    both = a.select(*key).distinct().withColumn("_a", F.lit(1)).unionByName(b.select(*key).distinct().withColumn("_a", F.lit(2)))
    sides = both.groupBy(*key).agg(F.sum("_a").alias("_s"))
    out = sides.agg(*(F.count_if(F.col("_s") == v).alias(n) for n, v in (("only_a", 1), ("only_b", 2), ("shared", 3))))
    return out.select("*", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("is_equal"), (F.col("only_a") == 0).alias("is_subset"), (F.col("shared") == 0).alias("is_disjoint"))


def contract_breaches(rows: DataFrame, contract: dict[str, str]) -> DataFrame:
    """(field, expected, found, rows) where a provider's rows depart from the contract; a null departs, too."""
    fields = F.array(*(F.struct(F.lit(k).alias("field"), F.lit(v).alias("expected"), F.col(k).cast("string").alias("found")) for k, v in contract.items()))
    each = rows.select(F.explode(fields).alias("f")).select("f.*").where(~F.col("found").eqNullSafe(F.col("expected")))
    return each.groupBy("field", "expected", "found").agg(F.count("*").alias("rows"))


def require_contract(rows: DataFrame, contract: dict[str, str]) -> DataFrame:
    """The rows, if every one keeps the contract; else an error, before anything is published."""
    worst = contract_breaches(rows, contract).orderBy("field", "found").first()
    if worst is not None:
        raise ValueError(f"the provider's {worst['field']} is {worst['found']}, not {worst['expected']}")
    return rows


def archive_plan(spans: DataFrame, first_year: int, last_combined: int) -> DataFrame:
    """The files that cover each (start, end): one for all years from ``first_year`` to ``last_combined``, then one a year."""
    year = F.explode(F.sequence(F.greatest(F.year("start"), F.lit(first_year)), F.greatest(F.year("end"), F.lit(first_year)))).alias("year")
    years = spans.where((F.col("start") <= F.col("end")) & (F.year("end") >= first_year)).select("start", "end", year)
    name = F.when(F.col("year") <= last_combined, f"{first_year}-{last_combined}").otherwise(F.col("year").cast("string"))
    return years.select("start", "end", name.alias("period")).distinct()


def isolated(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Reads every source on its own: the frames of those that could be read and had rows, and (source, status, rows) for all.

    A source that fails or is empty is UNAVAILABLE and never filled in; the others go on.
    """
    found, told = {}, []
    for name, read in sources.items():
        try:
            frame = read()
            n = frame.count()
        except (PySparkException, ValueError, OSError):
            n = 0
        if n:
            found[name] = frame
        told.append((name, "READY" if n else "UNAVAILABLE", n))
    return found, spark.createDataFrame(told, "source string, status string, rows long")


def chronological_windows(numbered: DataFrame, size: int, step: int, least: int, grow: int) -> DataFrame:
    """Rows (with a place ``i`` from 0) once for each window that holds them: ``mode``, ``first`` and ``past`` (the place behind the last).

    Rolling windows of ``size`` start every ``step``; expanding ones start at 0 and end at ``least`` and every ``grow`` after. Of each kind a last one ends with
    the series. The windows' table has one row a window.
    """
    n = numbered.agg((F.max("i") + 1).cast("long").alias("n")).where("n is not null")
    starts = F.when(F.col("n") >= size, F.array_union(F.sequence(F.lit(0).cast("long"), F.col("n") - size, F.lit(step).cast("long")), F.array(F.col("n") - size)))
    ends = F.when(F.col("n") >= least, F.array_union(F.sequence(F.lit(least).cast("long"), F.col("n"), F.lit(grow).cast("long")), F.array(F.col("n"))))
    rolling = n.select(F.lit("rolling").alias("mode"), F.explode(starts).alias("first")).withColumn("past", F.col("first") + size)
    expanding = n.select(F.lit("expanding").alias("mode"), F.lit(0).cast("long").alias("first"), F.explode(ends).alias("past"))
    # every place of every window, so that the join has a key
    places = rolling.unionByName(expanding).select("*", F.explode(F.sequence("first", F.col("past") - 1)).alias("i"))
    return numbered.withColumn("i", F.col("i").cast("long")).join(places, "i")


def closed(bars: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """Bars that lie wholly in [start, end]."""
    return bars.where((F.col("bar_start") >= F.lit(start).cast("timestamp_ntz")) & (F.col("bar_start") + F.expr(f"INTERVAL {minutes} MINUTES") <= F.lit(end).cast("timestamp_ntz")))


def missing_phrases(documents: DataFrame, name: str, text: str, required: dict[str, list[str]]) -> DataFrame:
    """(``name``, missing): documents whose contract names phrases that their text does not hold any more, case aside; ``missing`` lists them in the contract's order. Documents without a contract are not looked at."""
    contract = F.create_map(*(x for key, phrases in required.items() for x in (F.lit(key), F.array(*(F.lit(p.lower()) for p in phrases)))))
    held = documents.where(F.col(name).isin(*required)).select(name, contract[F.col(name)].alias("_p"), F.lower(F.coalesce(text, F.lit(""))).alias("_t"))
    lost = held.withColumn("missing", F.filter("_p", lambda p: ~F.contains(F.col("_t"), p)))
    return lost.where(F.size("missing") > 0).select(name, "missing")
