"""Jobs out and responses back: orders stand for events, and lines are written and read as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import shared_folder
from ..operators import exchange
from ..sources import lines
from .registry import query, table

HORIZONS = (1, 5, 20, 60)
SPLITS = {"train": ("1900-01-01", "1996-12-31"), "validation": ("1997-01-01", "1997-12-31"), "test": ("1998-01-01", "2100-12-31")}

JOBS = """jb AS (SELECT o_orderkey AS event_id, [1, 5, 20, 60][o_orderkey % 4 + 1] AS horizon, 'priority: ' || o_orderpriority || chr(10) || 'status: ' || o_orderstatus || chr(10) || 'month: ' || month(o_orderdate) AS state,
    o_orderdate::DATE AS day, ['down', 'flat', 'up'][CAST(floor(o_totalprice) AS BIGINT) % 3 + 1] AS actual, ['down', 'flat', 'up'][o_custkey % 3 + 1] AS frozen, ['down', 'flat', 'up'][day(o_orderdate) % 3 + 1] AS direction, ['down', 'flat', 'up'][o_orderkey % 3 + 1] AS other,
    0.4 + (o_custkey % 50) / 100.0 AS p, 0.4 + (o_orderkey % 40) / 100.0 AS q, o_orderkey % 97 AS k FROM orders)"""


def _direction(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, exchange.DIRECTIONS)), (n % 3).cast("int"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their states, and beside them the frozen forecast, what came true and what two runs of the model answer."""
    o = table(spark, sf_dir, "orders")
    horizon = F.get(F.array(*map(F.lit, HORIZONS)), (F.col("o_orderkey") % 4).cast("int"))
    state = F.concat_ws("\n", F.concat(F.lit("priority: "), "o_orderpriority"), F.concat(F.lit("status: "), "o_orderstatus"), F.concat(F.lit("month: "), F.month("o_orderdate").cast("string")))
    rows = o.select(
        F.col("o_orderkey").alias("event_id"), horizon.alias("horizon"), state.alias("state"), F.to_date("o_orderdate").alias("day"), _direction(F.floor("o_totalprice")).alias("actual_direction"), _direction(F.col("o_custkey")).alias("frozen_direction"),
        _direction(F.dayofmonth("o_orderdate")).alias("direction"), _direction(F.col("o_orderkey")).alias("other_direction"), (0.4 + F.col("o_custkey") % 50 / 100).alias("p"), (0.4 + F.col("o_orderkey") % 40 / 100).alias("q"))
    return rows.withColumn("job_id", exchange.job_id(F.col("event_id"), F.col("horizon"), F.col("state")))


def _probabilities(direction: str, p: str) -> Column:
    return F.struct(*(F.when(F.col(direction) == d, F.col(p)).otherwise((1 - F.col(p)) / 2).alias(d) for d in exchange.DIRECTIONS))


def _responses(asked: DataFrame, direction: str = "direction", p: str = "p") -> DataFrame:
    """What the model answers, in the fields of a response."""
    chars = F.length("state").cast("long")
    return asked.select(
        "job_id", "event_id", "horizon", F.lit("language").alias("track"), F.col(direction).alias("direction"), _probabilities(direction, p).alias("probabilities"), chars.alias("state_chars_total"), F.least(chars, F.lit(40).cast("long")).alias("state_chars_used"),
        (F.col("event_id") % 8 / 4).alias("elapsed_seconds"), F.lit(True).alias("actual_not_in_request"))


def _through_lines(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = f"{shared_folder(spark)}/responses-{uuid.uuid4().hex}"
    lines.write_lines(rows, path)
    return lines.read_lines(spark, path, exchange.RESPONSE)


FAULTS = {1: "no_response", 2: "broken", 3: "repeated", 4: "leaks", 5: "unknown_job", 6: "bad_probabilities", 7: "wrong_track", 8: "leaks", 9: "incomplete", 10: "other_job", 11: "bad_direction", 12: "broken"}


@query(f"""WITH {JOBS}, v AS (SELECT event_id, k, CASE k {' '.join(f"WHEN {k} THEN '{v}'" for k, v in FAULTS.items())} ELSE 'ok' END AS verdict FROM jb),
    l AS (SELECT verdict, CASE WHEN verdict = 'repeated' THEN 2 ELSE 1 END AS lines, CASE WHEN k IN (2, 12) THEN NULL ELSE event_id END AS job FROM v UNION ALL SELECT 'no_response', 1, event_id FROM v WHERE k IN (2, 5, 12))
    SELECT verdict, CAST(sum(lines) AS BIGINT) AS lines, count(DISTINCT job) AS jobs FROM l GROUP BY verdict""")
def exchange_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with one fault each in some of the lines: missing, cut off, repeated, leaking, unknown, unsound, of another track, incomplete, of another event, no object."""
    asked = jobs(spark, sf_dir)
    k = F.col("event_id") % 97
    answers = _responses(asked).withColumn("k", k).where("k <> 1")
    swap = lambda n, c, value: F.when(F.col("k") == n, value).otherwise(F.col(c))
    sums = F.struct(F.lit(0.9).alias("down"), F.lit(0.2).alias("flat"), F.lit(0.1).alias("up"))
    answers = answers.withColumns({
        "job_id": swap(5, "job_id", F.concat(F.lit("x"), "job_id")), "event_id": swap(10, "event_id", F.col("event_id") + 1), "track": swap(7, "track", F.lit("numeric")), "direction": F.when(F.col("k") != 9, swap(11, "direction", F.lit("sideways"))),
        "probabilities": swap(6, "probabilities", sums), "actual_not_in_request": F.col("k") != 8})
    line = F.to_json(F.struct(*(c for c in answers.columns if c != "k")))
    line = F.when(F.col("k") == 2, F.substring(line, 1, 90)).when(F.col("k") == 4, F.replace(line, F.lit('"track"'), F.lit('"actual_return":0.1,"track"'))).when(F.col("k") == 12, F.lit("[1, 2]")).otherwise(line)
    path = f"{shared_folder(spark)}/responses-{uuid.uuid4().hex}"
    answers.select(F.explode(F.when(F.col("k") == 3, F.array(line, line)).otherwise(F.array(line))).alias("value")).write.text(path)
    judged = exchange.reconcile(asked.select("job_id", "event_id", "horizon"), lines.read_lines(spark, path, exchange.RESPONSE), "language")
    return exchange.verdict_counts(judged)


@query(f"""WITH {JOBS} SELECT horizon, count(*) AS rows, count(*) FILTER (frozen = actual AND direction = actual) AS both_correct, count(*) FILTER (frozen = actual AND direction <> actual) AS frozen_only, count(*) FILTER (frozen <> actual AND direction = actual) AS response_only,
    count(*) FILTER (frozen <> actual AND direction <> actual) AS both_wrong, round(avg((frozen = actual)::INT), 8) AS frozen_accuracy, round(avg((direction = actual)::INT), 8) AS response_accuracy, round(avg((direction = frozen)::INT), 8) AS same_answer,
    count(*) FILTER (length(state) > 40) AS cut_states, round(avg((event_id % 8) / 4.0), 8) AS mean_seconds, CASE WHEN count(DISTINCT direction) = 1 THEN 'degenerate' ELSE 'operational' END AS verdict FROM jb GROUP BY horizon""")
def exchange_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted responses beside the frozen forecasts, by horizon."""
    asked = jobs(spark, sf_dir)
    judged = exchange.reconcile(asked.select("job_id", "event_id", "horizon"), _through_lines(spark, _responses(asked)), "language")
    report = exchange.comparison_report(exchange.compared(exchange.accepted(judged), asked.select("event_id", "horizon", "frozen_direction", "actual_direction")))
    return report.withColumns({c: F.round(c, 8) for c in ("frozen_accuracy", "response_accuracy", "same_answer", "mean_seconds")})


@query(f"""WITH {JOBS}, a AS (SELECT year(day) AS year, count(*) AS rows, count(*) FILTER (direction = actual AND other = actual) AS both_correct, count(*) FILTER (direction = actual AND other <> actual) AS with_only, count(*) FILTER (direction <> actual AND other = actual) AS without_only,
    count(*) FILTER (direction <> actual AND other <> actual) AS both_wrong, avg((direction = actual)::INT) AS wa, avg((other = actual)::INT) AS oa, avg(-ln(CASE WHEN direction = actual THEN p ELSE (1 - p) / 2 END)) AS wl, avg(-ln(CASE WHEN other = actual THEN q ELSE (1 - q) / 2 END)) AS ol,
    avg((direction = other)::INT) AS same FROM jb GROUP BY 1), v AS (SELECT *, CASE WHEN wa > oa AND ol > wl THEN 'helped' WHEN wa < oa AND ol < wl THEN 'hurt' ELSE 'mixed' END AS verdict FROM a)
    SELECT year, rows, both_correct, with_only, without_only, both_wrong, round(wa, 8) AS with_accuracy, round(oa, 8) AS without_accuracy, round(wl, 8) AS with_log_loss, round(ol, 8) AS without_log_loss, round(same, 8) AS same_direction, round(wa - oa, 8) AS accuracy_gain, round(ol - wl, 8) AS log_loss_gain, verdict,
    CASE WHEN year = min(year) OVER () THEN 'first' WHEN verdict = 'helped' AND first_value(verdict) OVER (ORDER BY year) = 'helped' THEN 'yes' ELSE 'no' END AS repeated FROM v""")
def text_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's answers with and without a part of the states, by year, and whether a gain of the first year comes again."""
    asked = jobs(spark, sf_dir)
    runs = []
    for direction, p in (("direction", "p"), ("other_direction", "q")):
        judged = exchange.reconcile(asked.select("job_id", "event_id", "horizon"), _through_lines(spark, _responses(asked, direction, p)), "language")
        runs.append(exchange.accepted(judged).select("job_id", "direction", "probabilities"))
    report = exchange.ablation(*runs, asked.select("job_id", "actual_direction", F.year("day").alias("year")), ["year"])
    numbers = [c for c, kind in report.dtypes if kind == "double"]
    return exchange.repeated_gain(report, F.col("year")).withColumns({c: F.round(c, 8) for c in numbers})


def _record_line() -> Column:
    """Events as lines whose fields differ by type: clicks have their value as text, signups as a whole number, views a null in place of the user, errors no properties, and purchases every seventh line cut off."""
    kind = F.col("event_type")
    value = F.when(kind == "click", F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).when(kind == "signup", F.floor("value").cast("string")).otherwise(F.format_string("%.2f", "value"))
    user = F.when(kind == "view", "null").otherwise(F.col("user_id").cast("string"))
    props = F.when(kind == "error", "").otherwise(F.concat(F.lit(', "props": '), "props"))
    line = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "user_id": '), user, F.lit(', "value": '), value, props, F.lit("}"))
    return F.when((kind == "purchase") & (F.col("event_id") % 7 == 0), F.substring(line, 1, 12)).otherwise(line)


@query("""WITH e AS (SELECT event_type, event_type = 'purchase' AND event_id % 7 = 0 AS cut FROM events), c AS (SELECT count(*) AS total, count(*) FILTER (NOT cut) AS sound, count(*) FILTER (NOT cut AND event_type <> 'error') AS with_props FROM e)
    SELECT 'event_id' AS field, 'BIGINT' AS kinds, 5::BIGINT AS files, sound AS lines, total - sound AS missing, 'optional' AS verdict FROM c UNION ALL SELECT 'user_id', 'BIGINT', 5, sound, total - sound, 'optional' FROM c
    UNION ALL SELECT 'value', 'BIGINT|DOUBLE|STRING', 5, sound, total - sound, 'conflict' FROM c UNION ALL SELECT 'props', 'OBJECT', 4, with_props, total - with_props, 'optional' FROM c""")
def field_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, a folder for each type; what their fields have in common and where they differ."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select("event_type", _record_line().alias("value")).write.partitionBy("event_type").text(path)
    counts = lines.field_counts(spark, path, F.regexp_extract(F.input_file_name(), "event_type=([^/]*)/", 1))
    return lines.drift(counts)


@query(f"""WITH {JOBS} SELECT CASE WHEN day < DATE '1997-01-01' THEN 'train' WHEN day < DATE '1998-01-01' THEN 'validation' ELSE 'test' END AS split, count(*) AS rows, CAST(sum(length(state)) AS BIGINT) AS chars, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last,
    count(DISTINCT state) AS states, count(*) FILTER (actual = 'up') AS ups, count(*) AS intact, 0::BIGINT AS labels_in_states FROM jb GROUP BY 1""")
def bundle_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs as a chronological bundle with the labels apart, read back: sizes, hashes that still hold, and whether any line of the bundle has a label."""
    asked = jobs(spark, sf_dir)
    folder = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    exchange.export_bundle(asked, asked.select("job_id", F.col("actual_direction").alias("label")), SPLITS, folder)
    rows = lines.read_lines(spark, f"{folder}/bundle", "job_id string, day date, split string, state string, state_sha256 string")
    labels = lines.read_lines(spark, f"{folder}/labels", "job_id string, label string").select("job_id", "label")
    return rows.join(labels, "job_id").groupBy("split").agg(
        F.count("*").alias("rows"), F.sum(F.length("state")).alias("chars"), F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"), F.count_distinct("state_sha256").alias("states"),
        F.count_if(F.col("label") == "up").alias("ups"), F.count_if(F.sha2(F.col("state").cast("binary"), 256) == F.col("state_sha256")).alias("intact"), F.count_if(F.array_contains("keys", "label")).alias("labels_in_states"))
