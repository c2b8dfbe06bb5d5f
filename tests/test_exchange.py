"""Job exchange: each fault of a line, refusals, the bundle's separation, and drift of fields."""

import json

import pytest

from tidemark.operators import exchange
from tidemark.sources import lines

JOBS = [("j1", 1, 5), ("j2", 2, 5), ("j3", 3, 20), ("j4", 4, 20)]


def answer(job, event, horizon=5, **changes):
    row = {"job_id": job, "event_id": event, "horizon": horizon, "track": "language", "direction": "up", "probabilities": {"down": 0.2, "flat": 0.3, "up": 0.5}, "state_chars_total": 9, "state_chars_used": 9, "elapsed_seconds": 1.5, "actual_not_in_request": True}
    return json.dumps({k: v for k, v in (row | changes).items() if v != "drop"})


def judged(spark, tmp_path, texts):
    (tmp_path / "r").mkdir(exist_ok=True)
    (tmp_path / "r" / "part.jsonl").write_text("\n".join(texts) + "\n")
    jobs = spark.createDataFrame(JOBS, "job_id string, event_id long, horizon int")
    return exchange.reconcile(jobs, lines.read_lines(spark, str(tmp_path / "r"), exchange.RESPONSE), "language")


FAULTS = [
    ("broken", answer("j1", 1)[:40]), ("broken", "[1, 2]"), ("broken", answer("j1", 1, event_id="one")), ("leaks", answer("j1", 1, actual_direction="up")), ("leaks", answer("j1", 1, actual_not_in_request="drop")),
    ("leaks", answer("j1", 1, actual_not_in_request=False)), ("incomplete", answer("j1", 1, direction=None)), ("incomplete", answer(None, 1)), ("unknown_job", answer("j9", 1)), ("other_job", answer("j1", 2)), ("other_job", answer("j1", 1, 20)),
    ("wrong_track", answer("j1", 1, track="numeric")), ("bad_direction", answer("j1", 1, direction="sideways")), ("bad_probabilities", answer("j1", 1, probabilities={"down": 0.5, "flat": 0.5, "up": 0.5})),
    ("bad_probabilities", answer("j1", 1, probabilities={"down": -0.5, "flat": 1.0, "up": 0.5})), ("bad_probabilities", answer("j1", 1, probabilities={"down": 0.5, "up": 0.5})), ("ok", answer("j1", 1)),
]


@pytest.mark.parametrize("verdict, text", FAULTS)
def test_every_fault_of_a_line(spark, tmp_path, verdict, text):
    rows = judged(spark, tmp_path, [text, "", answer("j2", 2)]).collect()
    own = [r.verdict for r in rows if r.verdict != "no_response" and r.job_id != "j2"]
    assert own == [verdict]
    silent = {r.job_id for r in rows if r.verdict == "no_response"}
    named = {json.loads(text).get("job_id")} if text.startswith("{") and text.endswith("}") else set()
    assert silent == {"j1", "j3", "j4"} - named


def test_repeated_lines_and_counts(spark, tmp_path):
    rows = judged(spark, tmp_path, [answer("j1", 1), answer("j1", 1), answer("j2", 2), answer("j3", 3, 20)])
    assert {r.verdict: (r.lines, r.jobs) for r in exchange.verdict_counts(rows).collect()} == {"repeated": (2, 1), "ok": (2, 2), "no_response": (1, 1)}
    with pytest.raises(Exception, match="response refused: repeated j1"):
        exchange.accepted(rows).collect()


def test_lines_are_parsed_once_and_those_without_a_job_are_spread(spark, tmp_path):
    texts = ["[1, 2]"] * 100 + [answer(None, 1)] * 100 + [answer("j1", 1), answer("j3", 3, 20), answer("j3", 3, 20)[:-9], answer("j9", 9), answer("j9", 9), answer("j4", 4, 20), answer("j4", 5, 20)]
    rows = judged(spark, tmp_path, texts)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("Relation [value"), plan.count("from_json("), plan.count("jsonObjectKeys(")) == (1, 1, 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows.withColumn("at", exchange.F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.job_id, r.verdict) for r in found if r.job_id) == [("j1", "ok"), ("j2", "no_response"), ("j3", "ok"), ("j4", "other_job"), ("j4", "repeated"), ("j9", "unknown_job"), ("j9", "unknown_job")]
    nameless = [r for r in found if r.job_id is None]
    assert sorted(r.verdict for r in nameless) == ["broken"] * 101 + ["incomplete"] * 100 and len({r["at"] for r in nameless}) > 1


def test_comparison_needs_a_frozen_forecast(spark, tmp_path):
    good = exchange.accepted(judged(spark, tmp_path, [answer("j1", 1), answer("j2", 2, direction="down")]))
    frozen = spark.createDataFrame([(1, 5, "up", "up"), (2, 5, "up", "flat")], "event_id long, horizon int, frozen_direction string, actual_direction string")
    assert sorted((r.job_id, r.outcome) for r in exchange.compared(good, frozen).collect()) == [("j1", "both_correct"), ("j2", "both_wrong")]
    (report,) = exchange.comparison_report(exchange.compared(good, frozen)).collect()
    assert (report.rows, report.verdict, report.frozen_accuracy) == (2, "operational", 0.5)
    with pytest.raises(Exception, match="no frozen forecast for j2"):
        exchange.compared(good, frozen.where("event_id = 1")).collect()


def test_ablation_verdicts_and_unequal_runs(spark):
    run = lambda rows: spark.createDataFrame([(j, d, (0.1, 0.1, p)) for j, d, p in rows], "job_id string, direction string, probabilities struct<down: double, flat: double, up: double>")
    actual = spark.createDataFrame([("a", "up", 2020), ("b", "up", 2021), ("c", "up", 2022)], "job_id string, actual_direction string, year int")
    with_text, without = run([("a", "up", 0.8), ("b", "up", 0.8), ("c", "up", 0.1)]), run([("a", "flat", 0.2), ("b", "flat", 0.2), ("c", "flat", 0.2)])
    report = exchange.repeated_gain(exchange.ablation(with_text, without, actual, ["year"]), exchange.F.col("year"))
    assert sorted((r.year, r.verdict, r.repeated) for r in report.collect()) == [(2020, "helped", "first"), (2021, "helped", "yes"), (2022, "mixed", "no")]
    with pytest.raises(Exception, match="same jobs"):
        exchange.ablation(with_text, without.where("job_id <> 'b'"), actual, ["year"]).collect()


def test_bundle_is_refused_or_written_apart(spark, tmp_path):
    jobs = spark.createDataFrame([("a", 1, 5, "2020-05-01", "state one"), ("b", 2, 5, "2021-05-01", "état\ntwo")], "job_id string, event_id long, horizon int, day string, state string").withColumn("day", exchange.F.to_date("day"))
    labels = spark.createDataFrame([("a", "up"), ("b", "down")], "job_id string, label string")
    splits = {"train": ("2020-01-01", "2020-12-31"), "test": ("2021-01-01", "2021-12-31")}
    first = exchange.export_bundle(jobs, labels, splits, str(tmp_path / "one"))
    again = exchange.export_bundle(jobs.repartition(3), labels, splits, str(tmp_path / "two"))
    assert first == again and first["splits"] == {"train": 1, "test": 1}
    written = "".join(p.read_text() for p in sorted((tmp_path / "one" / "bundle").glob("part-*")))
    assert "label" not in written and [json.loads(x)["state"] for x in written.splitlines()] == ["state one", "état\ntwo"]
    changed = exchange.export_bundle(jobs.withColumn("state", exchange.F.concat("state", exchange.F.lit("!"))), labels, splits, str(tmp_path / "three"))
    assert changed["bundle"] != first["bundle"] and changed["labels"] == first["labels"]
    with pytest.raises(Exception, match="an outcome in the state of [ab]"):
        exchange.export_bundle(jobs.withColumn("state", exchange.F.lit("actual_return 1")), labels, splits, str(tmp_path / "x"))
    with pytest.raises(Exception, match="no label for b"):
        exchange.export_bundle(jobs, labels.where("job_id = 'a'"), splits, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="empty split"):
        exchange.export_bundle(jobs, labels, splits | {"later": ("2030-01-01", "2030-12-31")}, str(tmp_path / "x"))


def test_drift_of_fields_over_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": 1, "y": "s", "z": null}\n\n{"id": 2, "x": 2.5, "y": "t"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 3, "x": 4, "y": 7, "w": [1]}\nnot json\n')
    found = {r.field: (r.kinds, r.files, r.lines, r.missing, r.verdict) for r in lines.drift(lines.field_counts(spark, str(tmp_path))).collect()}
    assert found == {"id": ("BIGINT", 2, 3, 1, "optional"), "x": ("BIGINT|DOUBLE", 2, 3, 1, "widened"), "y": ("BIGINT|STRING", 2, 3, 1, "conflict"), "z": ("", 1, 1, 3, "optional"), "w": ("ARRAY", 1, 1, 3, "optional")}
    assert {r.kind for r in lines.field_counts(spark, str(tmp_path)).where("field = ''").collect()} == {"BROKEN"}
