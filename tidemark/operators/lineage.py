"""Datasets that come from others: ids from a configuration and the parents' ids, and what is out of date when a parent changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import cut


def _links(datasets: DataFrame) -> DataFrame:
    return datasets.select("name", F.explode("parents").alias("parent")).distinct()


def lineage_ids(datasets: DataFrame, most_depth: int = 1000) -> DataFrame:
    """``name depth dataset_id``: 20 hex digits of the configuration's hash and the parents' ids in order, level by level from the datasets without parents.

    ``datasets``: name (unique), config (a hash or text), parents (an array of names, possibly empty). A dataset with an unknown parent, or on or behind a cycle, never gets its turn: that is an error, as is more than ``most_depth`` levels.
    Each round joins only the datasets whose turn it is; the rounds are as many as the levels.
    """
    rows = cut(datasets.select("name", F.coalesce("config", F.lit("")).alias("config"), F.array_distinct(F.coalesce("parents", F.array().cast("array<string>"))).alias("parents")))
    links = cut(_links(rows))

    def id_of(parents):
        return F.substring(F.sha2(F.concat_ws("|", "config", F.array_join(F.array_sort(parents), ",")).cast("binary"), 256), 1, 20).alias("dataset_id")

    done = cut(rows.where("size(parents) = 0").select("name", F.lit(0).alias("depth"), id_of(F.array().cast("array<string>"))))
    front, total = done, rows.count()
    for depth in range(1, most_depth + 1):
        # children of the last level whose parents all have ids by now
        touched = links.join(front.select(F.col("name").alias("parent")), "parent", "left_semi").select("name").distinct()
        known = links.join(touched, "name", "left_semi").join(done.select(F.col("name").alias("parent"), "dataset_id"), "parent", "left")
        ready = known.groupBy("name").agg(F.collect_list("dataset_id").alias("_ids"), F.count("*").alias("_n")).where("size(_ids) = _n")
        front = cut(ready.join(rows, "name").select("name", F.lit(depth).alias("depth"), id_of(F.col("_ids"))))
        if front.isEmpty():
            break
        done = cut(done.unionByName(front))
    if done.count() != total:
        raise ValueError("datasets with unknown parents, on a cycle or too deep have no id")
    return done


def staleness(datasets: DataFrame, recorded: DataFrame, most_depth: int = 1000) -> DataFrame:
    """``name dataset_id recorded_id stale changed``: whether a dataset's recorded id (name, dataset_id) still is the one that its lineage gives, and whether it changed by itself rather than through a parent."""
    now = lineage_ids(datasets, most_depth)
    both = cut(now.join(recorded.select("name", F.col("dataset_id").alias("recorded_id")), "name", "left").withColumn("stale", ~F.coalesce(F.col("dataset_id") == F.col("recorded_id"), F.lit(False))))
    parents = _links(datasets).join(both.where("stale").select(F.col("name").alias("parent")), "parent", "left_semi").select("name").distinct().withColumn("_inherits", F.lit(True))
    return both.join(parents, "name", "left").select("name", "depth", "dataset_id", "recorded_id", "stale", (F.col("stale") & F.col("_inherits").isNull()).alias("changed"))
