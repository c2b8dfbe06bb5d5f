"""Queries that summarise others: stability of lags, correlations within blocks, selection frequencies, wide metrics, unions and joins of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded_corr
from ..operators import linear, spectral
from . import data
from .data import PANEL
from .registry import query, table
from .research import BLOCKS, FEATURES, FOLDS, PENALTIES, SMALL, _folds, _stats
from .spectra import CHANGES, CORR, changes

WINDOW_LAGS = CHANGES + f""", w AS (SELECT c.*, CAST(k AS INTEGER) AS w, i - k * 128 AS j FROM c, range(0, 1000) t(k) WHERE i >= k * 128 AND i < k * 128 + 256), wl AS (SELECT a.w, CAST(z.g AS INTEGER) AS lag, {CORR.format(x='a.f', y='b.t')} AS r
    FROM w a, range(-3, 4) z(g), w b WHERE b.w = a.w AND b.j = a.j + z.g GROUP BY a.w, z.g), bl AS (SELECT w, arg_max(lag, (abs(round(r, 12)), -lag)) AS lag FROM wl WHERE r IS NOT NULL GROUP BY w)"""


@query(f"""WITH {WINDOW_LAGS}, s AS (SELECT lag, count(*) AS windows FROM bl GROUP BY lag) SELECT lag, windows, round(windows::DOUBLE / sum(windows) OVER (), 6) AS share, row_number() OVER (ORDER BY windows DESC, lag) = 1 AS modal FROM s""")
def lag_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lag leads in each chronological window, and how often."""
    w = spectral.in_windows(changes(spark, sf_dir), 256, 128).select("s", "w", F.col("j").alias("i"), "f", "t")
    best = spectral.best_lag(spectral.lag_correlations(w, ["s", "w"], "f", "t", 3), ["s", "w"])
    counts = best.groupBy("s", "lag").agg(F.count("*").alias("windows"))
    every = Window.partitionBy("s")
    return counts.select("lag", "windows", F.round(F.col("windows") / F.sum("windows").over(every), 6).alias("share"), (F.row_number().over(every.orderBy(F.desc("windows"), "lag")) == 1).alias("modal"))


@query(f"""WITH {FOLDS} SELECT year, 'front' AS block, 'f1' AS a, 'f2' AS b, round({CORR.format(x='f1', y='f2')}, 6) AS r FROM fo WHERE role = 'test' GROUP BY year
    UNION ALL SELECT year, 'back', 'f3', 'f4', round({CORR.format(x='f3', y='f4')}, 6) FROM fo WHERE role = 'test' GROUP BY year""")
def block_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of the members of each block over the test years: redundant members explain small single ablations."""
    test = _folds(spark, sf_dir).where("role = 'test'")
    out = None
    for block, (a, b) in BLOCKS.items():
        one = test.groupBy("year").agg(F.round(guarded_corr(F.col(a), F.col(b)), 6).alias("r")).select("year", F.lit(block).alias("block"), F.lit(a).alias("a"), F.lit(b).alias("b"), "r")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def selection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an elastic net keeps each feature, and how often each penalty is chosen."""
    fits = linear.walk_forward(_stats(spark, sf_dir), FEATURES, (0.001, 0.01, 0.1), kind="elastic_net", l1_ratios=(0.5, 0.9), minimum=SMALL)
    names = F.array(*(F.lit(c) for c in FEATURES))
    each = fits.select("year", F.posexplode(F.slice("coefficients", 2, len(FEATURES))).alias("i", "c")).select(F.lit("feature").alias("kind"), F.get(names, F.col("i")).alias("name"), (F.abs("c") > 1e-12).alias("hit"))
    chosen = fits.select(F.lit("penalty").alias("kind"), F.col("penalty").cast("string").alias("name"), F.lit(True).alias("hit"))
    return each.unionByName(chosen).groupBy("kind", "name").agg(F.count_if("hit").alias("chosen"), F.count("*").alias("of"))


@query()
def ablation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaving out a block costs beyond the sum of leaving out its members one by one."""
    variants = {**linear.leave_out(FEATURES, BLOCKS), **{f"without_{c}": [x for x in FEATURES if x != c] for c in FEATURES}}
    fits = linear.walk_forward(_stats(spark, sf_dir), FEATURES, PENALTIES, variants, minimum=SMALL)
    full = fits.where("variant = 'full'").select("year", F.col("mse").alias("full_mse"))
    delta = fits.join(full, "year").withColumn("delta", F.col("mse") - F.col("full_mse")).groupBy("variant").agg(F.avg("delta").alias("delta"))
    members = spark.createDataFrame([(b, f"without_{b}", f"without_{c}") for b, own in BLOCKS.items() for c in own], "block string, whole string, single string")
    whole = members.select("block", F.col("whole").alias("variant")).distinct().join(delta, "variant").select("block", F.col("delta").alias("block_delta"))
    single = members.select("block", F.col("single").alias("variant")).join(delta, "variant").groupBy("block").agg(F.sum("delta").alias("members_delta"))
    return whole.join(single, "block").withColumn("gap", F.col("block_delta") - F.col("members_delta"))


@query(f"WITH {PANEL} SELECT year(d) AS year, " + ", ".join(f"round(avg(v) FILTER (WHERE s = {i}), 6) AS s{i}_mean, count(*) FILTER (WHERE s = {i}) AS s{i}_n" for i in range(8)) + " FROM panel GROUP BY 1")
def metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of series flattened into columns ``{series}_{metric}``."""
    rows = data.panel(spark, sf_dir).select(F.year("d").cast("long").alias("year"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("series"), "v")
    return rows.groupBy("year").pivot("series", [f"s{i}" for i in range(data.SERIES)]).agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))


@query("""WITH u AS (SELECT 'order' AS source, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT 'line', l_orderkey || '-' || l_linenumber, CAST(l_shipdate AS DATE) FROM lineitem UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), CAST(ts AS DATE) FROM events)
    SELECT source, count(*) AS n, count(*) - count(DISTINCT id) AS repeated, CAST(min(d) AS VARCHAR) AS first, CAST(max(d) AS VARCHAR) AS last FROM u GROUP BY source""")
def event_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three sources in one table, with a check of their keys; ids are counted by source, then summed."""
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("source"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    li = table(spark, sf_dir, "lineitem").select(F.lit("line").alias("source"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_shipdate").cast("date").alias("d"))
    e = table(spark, sf_dir, "events").select(F.lit("event").alias("source"), F.col("event_id").cast("string").alias("id"), F.col("ts").cast("date").alias("d"))
    keys = o.unionByName(li).unionByName(e).groupBy("source", "id").agg(F.count("*").alias("c"), F.min("d").alias("first"), F.max("d").alias("last"))
    return keys.groupBy("source").agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("repeated"), F.min("first").cast("string").alias("first"), F.max("last").cast("string").alias("last"))


@query("""SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' GROUP BY 1, 2""")
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and nation. Only columns and rows that count are read; Spark picks the joins by size."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority", "o_totalprice")
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_shipdate < TIMESTAMP '1995-04-01' AND l_suppkey IS NOT NULL)")
def unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers without a large delivery in the first quarter."""
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_shipdate < timestamp_ntz'1995-04-01 00:00:00'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(large, "s_suppkey", "left_anti")
