"""Candle payloads with their checks, versioned publication, the replay gate and two writers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, publish
from tidemark.sources import raw

GOOD = {"timestamp": 1704751200000, "multiplier": 0.00001, "shift": 3600000, "open": 1.1, "high": 1.1, "low": 1.1, "close": 1.1, "times": [22, 1, 3], "opens": [0, 50, 50], "highs": [60, 30, 10], "lows": [-10, 0, 0], "closes": [50, 30, -10], "volumes": [1.5, 2, 0]}
FAULTS = [
    ("shift", {"shift": 60000}), ("unaligned", {"timestamp": 1704751200001}), ("length", {"closes": [1]}), ("length", {c: [] for c in ("times", "opens", "highs", "lows", "closes", "volumes")}), ("negative_time", {"times": [22, -1, 3]}),
    ("fractional", {"opens": [0, 0.5, 50]}), ("fractional", {"lows": [0, None, 1]}), ("unreadable", {"highs": None}), ("unreadable", {"multiplier": "drop"}), (None, {}),
]


@pytest.mark.parametrize("fault, change", FAULTS)
def test_candle_contract(spark, fault, change):
    body = json.dumps({k: v for k, v in (GOOD | change).items() if v != "drop"})
    (r,) = bars.read_candles(spark.createDataFrame([("a", body)], "id string, content string")).collect()
    assert r.fault == fault


def test_candles_decode_and_broken_text_gives_nothing(spark):
    rows = bars.read_candles(spark.createDataFrame([("a", json.dumps(GOOD)), ("b", json.dumps(GOOD)[:60]), ("c", "")], "id string, content string"))
    assert {r.id: r.fault for r in rows.collect()} == {"a": None, "b": "unreadable", "c": "unreadable"}
    out = bars.explode_candles(rows.where("fault is null")).orderBy("pos").collect()
    start = dt.datetime(2024, 1, 8, 22)
    assert [r.bar_start for r in out] == [start + dt.timedelta(hours=h) for h in (22, 23, 26)]
    assert [round(r.open, 5) for r in out] == [1.1, 1.1005, 1.101] and [round(r.close, 5) for r in out] == [1.1005, 1.1008, 1.1007]


def store(spark, folder, bodies):
    rows = [("s", f"u{i}", 200, dt.datetime(2024, 1, 1), b) for i, b in enumerate(bodies)]
    raw.keep(spark.createDataFrame(rows, "source string, url string, status int, fetched_at timestamp, content binary"), folder)
    return raw.pinned(raw.receipts(spark, folder), raw.payloads(spark, folder))


def parsed(pins):
    return pins.select("url", F.decode("content", "utf-8").alias("v"))


def test_replay_keeps_the_old_version_when_a_body_changed(spark, tmp_path):
    folder, kept = str(tmp_path / "p"), str(tmp_path / "store")
    pins = store(spark, kept, [b"one", b"two"])
    first = publish.publish_version(parsed(pins), folder, "t", 0, pins=pins)
    assert first["version"] == 1 and publish.current(spark, f"{folder}/manifests") == (1, first)
    again = publish.replay(parsed(pins), folder, "t", pins)
    assert (again["version"], again["dataset"], again["replay_of"], again["payloads"]) == (2, first["dataset"], 1, first["payloads"])
    raw.payloads(spark, kept).select("source", "sha256", F.when(F.col("content") == b"two", b"2!").otherwise(F.col("content")).alias("content")).write.parquet(str(tmp_path / "changed" / "bodies"))
    broken = raw.pinned(raw.receipts(spark, kept), raw.payloads(spark, str(tmp_path / "changed")))
    with pytest.raises(publish.Refused, match="missing or changed: s u1"):
        publish.replay(parsed(broken), folder, "t", broken)
    with pytest.raises(publish.Refused, match="replay gives"):
        publish.replay(parsed(pins).withColumn("v", F.upper("v")), folder, "t", pins)
    assert publish.current(spark, f"{folder}/manifests") == (2, again)
    assert sorted(r.v for r in publish.published(spark, folder).collect()) == ["one", "two"] and publish.published(spark, folder, 1).count() == 2


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "p")
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    publish.publish_version(one, folder, "t", 0)
    with pytest.raises(publish.Refused, match="meanwhile"):
        publish.publish_version(two, folder, "t", 0)
    real = publish.create_json
    # the other writer comes between the look at the version and the new manifest
    monkeypatch.setattr(publish, "create_json", lambda s, path, value: (real(s, path, {"other": True}), real(s, path, value))[1])
    with pytest.raises(publish.Refused, match="meanwhile"):
        publish.publish_version(two, folder, "t", 1)
    assert publish.current(spark, f"{folder}/manifests") == (2, {"other": True}) and raw.versions(spark, f"{folder}/manifests") == [1, 2]
    assert [p.name for p in sorted((tmp_path / "p" / "manifests").glob("*")) if not p.name.startswith(".")] == ["0000000001.json", "0000000002.json"]


def test_nothing_to_replay_or_read(spark, tmp_path):
    with pytest.raises(publish.Refused, match="no version"):
        publish.replay(spark.range(1), str(tmp_path / "none"), "t", spark.createDataFrame([], "source string, url string, sha256 string, usable boolean"))
    with pytest.raises(ValueError, match="nothing was published"):
        publish.published(spark, str(tmp_path / "none"))


def test_holidays_that_cover_an_hour_together(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2024, 7, 3),), (dt.date(2024, 1, 6),)], "session_date date")
    at = lambda h, m=0: dt.datetime(2024, 1, 3, h, m)
    holidays = [(at(1), at(2, 30)), (at(2, 15), at(3)), (at(5), at(5, 20)), (at(5, 20), at(6)), (at(8), at(8, 30)), (at(8, 31), at(9)), (at(11), at(11)), (at(13, 59), at(15, 1))]
    left = bars.expected_hours(days, spark.createDataFrame(holidays * 2, "from_ts timestamp_ntz, till_ts timestamp_ntz"))
    gone = {h for h in range(24)} - {r.hour.hour for r in left.where("session_date = date'2024-01-03'").collect()}
    assert gone == {1, 2, 5, 14} and left.where("session_date = date'2024-07-03'").count() == 24 and left.where("session_date = date'2024-01-06'").count() == 0
