"""Exchange of questions with a model that runs elsewhere: frozen jobs out as JSON lines, responses back, every line judged before any of them counts.

Jobs hold states and no outcomes; labels are written apart. A response counts once, for a job that was asked, under the track that it belongs to, and without anything that it must not know.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.lines import read_lines, write_lines
from ..sources.raw import write_json
from .publish import content_id

RESPONSE = """job_id string, event_id long, horizon int, track string, direction string, probabilities struct<down: double, flat: double, up: double>,
    state_chars_total long, state_chars_used long, elapsed_seconds double, actual_not_in_request boolean"""
#: Names that neither a response nor a state may hold.
OUTCOMES = ("actual_return", "actual_direction", "forecast_return", "combined_score", "probability_up")
DIRECTIONS = ("down", "flat", "up")


def job_id(*parts: Column) -> Column:
    """24 hex digits of what identifies a job."""
    return F.substring(F.sha2(F.concat_ws("\n", *(p.cast("string") for p in parts)).cast("binary"), 256), 1, 24)


def holds_outcome(state: Column, names: Sequence[str] = OUTCOMES) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | state.contains(name)
    return found


def _first_of(*faults: tuple[str, Column]) -> Column:
    """The name of the first that holds, else null."""
    return F.coalesce(*(F.when(condition, name) for name, condition in faults))


def reconcile(jobs: DataFrame, lines: DataFrame, track: str) -> DataFrame:
    """One row for each line, and one for each job without any: ``job_id verdict`` and the response's columns.

    ``jobs`` (job_id, event_id, horizon) are frozen and their ids unique; ``lines`` come from ``read_lines`` with `RESPONSE`. The first fault in this order is the verdict: broken, leaks (a
    forbidden name, or no statement that the outcome was not shown), incomplete, unknown_job, other_job (another event or horizon than the job's), wrong_track, repeated (each of the lines of one job), bad_direction, bad_probabilities; else ok. A job that no
    line names is 'no_response'. The lines are read once, and those of one job are counted in one task, which puts what exceeds its memory on disk.
    """
    p = [F.col(f"probabilities.{d}") for d in DIRECTIONS]
    sound = F.lit(True)
    for x in p:
        sound = sound & x.isNotNull() & (x >= 0) & (x <= 1)
    sound = sound & (F.abs(p[0] + p[1] + p[2] - 1) <= 1e-6)
    required = ("job_id", "event_id", "horizon", "track", "direction", "probabilities", "state_chars_total", "state_chars_used", "elapsed_seconds")
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(c).isNull()
    leaks = F.arrays_overlap("keys", F.array(*map(F.lit, OUTCOMES))) | ~F.coalesce("actual_not_in_request", F.lit(False))
    own = [f for f in lines.columns if f not in ("line", "keys", "broken")]
    # What a line shows by itself is judged before the lines are dealt out by job: neither texts nor names move, and no text is read twice. Lines without a job are dealt out by number.
    key = F.concat(F.lit("="), "job_id")
    each = lines.select(
        *own, _first_of(("broken", F.col("broken")), ("leaks", leaks), ("incomplete", lacking)).alias("_before"), (F.col("track") != track).alias("_strange"),
        _first_of(("bad_direction", ~F.col("direction").isin(*DIRECTIONS)), ("bad_probabilities", ~sound)).alias("_after"), F.coalesce(key, F.monotonically_increasing_id().cast("string")).alias("_key"))
    counted = each.withColumn("_times", F.count("*").over(Window.partitionBy("_key")))
    asked = jobs.select(key.alias("_key"), F.col("job_id").alias("_job"), F.col("event_id").alias("_event"), F.col("horizon").alias("_horizon"), F.lit(True).alias("_asked"))
    of_job = _first_of(("unknown_job", F.col("_asked").isNull()), ("other_job", (F.col("event_id") != F.col("_event")) | (F.col("horizon") != F.col("_horizon"))), ("wrong_track", F.col("_strange")), ("repeated", F.col("_times") > 1))
    verdict = F.coalesce(_first_of(("no_response", F.col("_times").isNull())), "_before", of_job, "_after", F.lit("ok"))
    return counted.join(asked, "_key", "full_outer").withColumns({"verdict": verdict, "job_id": F.coalesce("job_id", F.when(F.col("_times").isNull(), F.col("_job")))}).select(*own, "verdict")


def verdict_counts(judged: DataFrame) -> DataFrame:
    """Lines and distinct jobs of each verdict."""
    return judged.groupBy("verdict").agg(F.count("*").alias("lines"), F.count_distinct("job_id").alias("jobs"))


def accepted(judged: DataFrame) -> DataFrame:
    """The responses if every line is ok; any other verdict than 'ok' and 'no_response' ends the job that reads them. A run that was cut short may lack answers, none may be wrong."""
    fault = F.when(~F.col("verdict").isin("ok", "no_response"), F.raise_error(F.concat(F.lit("response refused: "), F.col("verdict"), F.lit(" "), F.coalesce("job_id", F.lit("")))).cast("string")).otherwise(F.col("verdict"))
    return judged.withColumn("verdict", fault).where("verdict = 'ok'").drop("verdict")


def outcome(first: Column, second: Column, actual: Column, names: tuple[str, str] = ("first_only", "second_only")) -> Column:
    """Which of two directions is right. The two are never mixed into one."""
    a, b = first == actual, second == actual
    return F.when(a & b, "both_correct").when(a, names[0]).when(b, names[1]).otherwise("both_wrong")


def compared(responses: DataFrame, frozen: DataFrame) -> DataFrame:
    """Responses beside the frozen forecasts of the same event and horizon (``event_id horizon frozen_direction actual_direction``), with ``outcome``. A response without one ends the job."""
    both = responses.join(frozen, ["event_id", "horizon"], "left")
    actual = F.when(F.col("actual_direction").isNull(), F.raise_error(F.concat(F.lit("no frozen forecast for "), F.col("job_id"))).cast("string")).otherwise(F.col("actual_direction"))
    return both.withColumn("actual_direction", actual).withColumn("outcome", outcome(F.col("frozen_direction"), F.col("direction"), F.col("actual_direction"), ("frozen_only", "response_only")))


def comparison_report(pairs: DataFrame) -> DataFrame:
    """By horizon: rows, the four outcomes, both accuracies, equal answers, cut states, mean time and whether all answers are one direction ('degenerate')."""
    each = [F.count_if(F.col("outcome") == o).alias(o) for o in ("both_correct", "frozen_only", "response_only", "both_wrong")]
    right = lambda c: F.avg((F.col(c) == F.col("actual_direction")).cast("double"))
    out = pairs.groupBy("horizon").agg(
        F.count("*").alias("rows"), *each, right("frozen_direction").alias("frozen_accuracy"), right("direction").alias("response_accuracy"),
        F.avg((F.col("direction") == F.col("frozen_direction")).cast("double")).alias("same_answer"), F.count_if(F.col("state_chars_used") < F.col("state_chars_total")).alias("cut_states"),
        F.avg("elapsed_seconds").alias("mean_seconds"), F.count_distinct("direction").alias("_kinds"))
    return out.withColumn("verdict", F.when(F.col("_kinds") == 1, "degenerate").otherwise("operational")).drop("_kinds")


def ablation(with_part: DataFrame, without_part: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """Two runs over the same jobs, one whose states lacked a part: by ``by``, accuracies, log losses, outcomes and the verdict.

    Runs: ``job_id direction probabilities``; ``actual``: job_id, actual_direction and the columns of ``by``. A job that only one run has ends the job. The part helped if accuracy and log loss are both better with it, hurt if both are worse.
    """
    one = with_part.select("job_id", F.col("direction").alias("with_direction"), F.col("probabilities").alias("with_p"))
    two = without_part.select("job_id", F.col("direction").alias("without_direction"), F.col("probabilities").alias("without_p"))
    both = one.join(two, "job_id", "full_outer")
    both = both.withColumn("with_direction", F.when(F.col("with_p").isNull() | F.col("without_p").isNull(), F.raise_error("the runs do not hold the same jobs").cast("string")).otherwise(F.col("with_direction"))).join(actual, "job_id")
    kind = F.col("actual_direction")
    own = lambda p: F.greatest(F.when(kind == "down", F.col(f"{p}.down")).when(kind == "flat", F.col(f"{p}.flat")).otherwise(F.col(f"{p}.up")), F.lit(1e-12))
    parts = {"both_correct", "with_only", "without_only", "both_wrong"}
    both = both.withColumn("outcome", outcome(F.col("with_direction"), F.col("without_direction"), kind, ("with_only", "without_only")))
    out = both.groupBy(*by).agg(
        F.count("*").alias("rows"), *(F.count_if(F.col("outcome") == o).alias(o) for o in sorted(parts)),
        *(F.avg((F.col(f"{s}_direction") == kind).cast("double")).alias(f"{s}_accuracy") for s in ("with", "without")), *(F.avg(-F.log(own(f"{s}_p"))).alias(f"{s}_log_loss") for s in ("with", "without")),
        F.avg((F.col("with_direction") == F.col("without_direction")).cast("double")).alias("same_direction"))
    gain, saved = F.col("with_accuracy") - F.col("without_accuracy"), F.col("without_log_loss") - F.col("with_log_loss")
    return out.withColumns({"accuracy_gain": gain, "log_loss_gain": saved, "verdict": F.when((gain > 0) & (saved > 0), "helped").when((gain < 0) & (saved < 0), "hurt").otherwise("mixed")})


def repeated_gain(report: DataFrame, period: Column) -> DataFrame:
    """Whether a part that helped in the first period helps in each later one, too: adds ``repeated`` (first, yes or no). ``period`` orders the rows of one report; there are as many as periods."""
    first = report.withColumn("_period", period).agg(F.min_by("verdict", "_period").alias("_first"), F.min("_period").alias("_start")).withColumn("_one", F.lit(1))
    with_first = report.withColumns({"_one": F.lit(1), "_period": period}).join(F.broadcast(first), "_one")
    return with_first.withColumn("repeated", F.when(F.col("_period") == F.col("_start"), "first").when((F.col("verdict") == "helped") & (F.col("_first") == "helped"), "yes").otherwise("no")).drop("_one", "_period", "_first", "_start")


def export_bundle(jobs: DataFrame, labels: DataFrame, splits: dict[str, tuple[str, str]], folder: str) -> dict:
    """Write jobs with their states to ``bundle`` and labels to ``labels``, both as JSON lines in order of day and id, and a manifest with both content ids.

    ``jobs``: job_id, event_id, horizon, day, state; ``labels``: job_id, label. Ends with an error if a state holds an outcome, a job lacks its label or a split has no job. Splits are (first, last) days; jobs outside all of them stay out.
    """
    spark: SparkSession = jobs.sparkSession
    split = F.coalesce(*(F.when(F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date")), name) for name, (a, b) in splits.items()))
    checked = jobs.withColumns({"split": split, "state": F.when(holds_outcome(F.col("state")), F.raise_error(F.concat(F.lit("an outcome in the state of "), F.col("job_id"))).cast("string")).otherwise(F.col("state"))}).where("split is not null")
    rows = checked.select("job_id", "event_id", "horizon", "day", "split", "state", F.sha2(F.col("state").cast("binary"), 256).alias("state_sha256"), F.length("state").alias("state_chars_total"))
    label = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("no label for "), F.col("job_id"))).cast("string")).otherwise(F.col("label"))
    marks = rows.select("job_id", "day", "split").join(labels.select("job_id", "label"), "job_id", "left").withColumn("label", label)
    write_lines(rows, f"{folder}/bundle", ["day", "job_id"])
    write_lines(marks, f"{folder}/labels", ["day", "job_id"])
    back = read_lines(spark, f"{folder}/bundle", rows_schema := "job_id string, event_id long, horizon int, day date, split string, state string, state_sha256 string, state_chars_total int")
    sizes = {r["split"]: r["count"] for r in back.groupBy("split").count().collect()}
    if sizes.keys() != splits.keys():
        raise ValueError(f"empty split: {sorted(splits.keys() - sizes.keys())}")
    names = [c.split()[0] for c in rows_schema.split(", ")]
    report = {"bundle": content_id(back.select(*names), "bundle"), "labels": content_id(read_lines(spark, f"{folder}/labels", "job_id string, day date, split string, label string").select("job_id", "day", "split", "label"), "labels"), "rows": sum(sizes.values()), "splits": sizes}
    write_json(spark, f"{folder}/manifest.json", report)
    return report
