"""The command line, quoted cells, contracts of documents and sessions of payload bars."""

import datetime as dt

import pytest

from tidemark import __main__, catalog
from tidemark.operators import audits, bars
from tidemark.sources import series

SF = "/root/testdata/sf0.001"


def test_list_names_every_query(capsys):
    assert __main__.main(["list"]) == 0
    said = dict(line.split() for line in capsys.readouterr().out.splitlines())
    assert said.keys() == catalog.queries().keys() and {k for k, v in said.items() if v == "sql"} == catalog.oracle_sql().keys()


def test_run_writes_once_and_names_the_content(spark, tmp_path, capsys):
    out = str(tmp_path / "bars")
    assert __main__.main(["run", "session_bars", SF, "--out", out, "--id"]) == 0
    first = capsys.readouterr().out.strip().splitlines()[-1]
    assert spark.read.parquet(out).count() == catalog.queries()["session_bars"](spark, SF).count() and len(first) == 20
    assert __main__.main(["run", "session_bars", SF, "--id"]) == 0
    said = capsys.readouterr().out
    assert said.strip().splitlines()[-1] == first and "session_date" in said
    with pytest.raises(Exception, match="already exists"):
        __main__.main(["run", "session_bars", SF, "--out", out])


def test_explain_and_unknown_queries(spark, capsys):
    assert __main__.main(["explain", "asof_backward", SF]) == 0
    assert "Physical Plan" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        __main__.main(["run", "no_such_query", SF])


def test_quoted_cells_keep_their_separators(spark):
    text = 'note, one\nDATE,"NAME, LONG",CLOSE\n2024-01-02,"a ""b"", c",1.5\n2024-01-03,plain,"2,000.5"\n2024-01-04,,\n'
    rows = series.delimited(spark.createDataFrame([("x", text)], "id string, content string"), "^DATE,").orderBy("n").collect()
    assert [r.cells for r in rows] == [{"DATE": "2024-01-02", "NAME, LONG": 'a "b", c', "CLOSE": "1.5"}, {"DATE": "2024-01-03", "NAME, LONG": "plain", "CLOSE": "2,000.5"}, {"DATE": "2024-01-04", "NAME, LONG": "", "CLOSE": ""}]
    tabs = series.delimited(spark.createDataFrame([("x", "K\tV\na|b\t1\n")], "id string, content string"), "^K", "\t").collect()
    assert [r.cells for r in tabs] == [{"K": "a|b", "V": "1"}]


def test_missing_phrases_of_contracts(spark):
    rows = [("a", "Forecast and REVISED data"), ("a", None), ("b", "bid price"), ("c", "anything")]
    out = audits.missing_phrases(spark.createDataFrame(rows, "name string, text string"), "name", "text", {"a": ["forecast", "Revised"], "b": ["ask price", "bid price", "ms"]})
    assert sorted((r.name, r.missing) for r in out.collect()) == [("a", ["forecast", "revised"]), ("b", ["ask price", "ms"])]


def test_sessions_carry_volume_and_payloads(spark):
    start = dt.datetime(2024, 1, 2, 22)
    rows = [(start + dt.timedelta(hours=h), 1.0 + h, 2.0 + h, 0.5 + h, 1.5 + h, 3, 2.0, "p2" if h > 1 else "p1") for h in range(24) if h != 5]
    hourly = spark.createDataFrame(rows, "bar_start timestamp_ntz, open double, high double, low double, close double, ticks int, volume double, raw_payload_hash string")
    holidays = spark.createDataFrame([(start + dt.timedelta(hours=5), start + dt.timedelta(hours=6))], "from_ts timestamp_ntz, till_ts timestamp_ntz")
    (r,) = bars.payload_sessions(hourly, holidays).collect()
    assert (r.session_date, r.hours_present, r.hours_expected, r.complete, r.volume, r.raw_payload_hashes) == (dt.date(2024, 1, 3), 23, 23, True, 46.0, ["p1", "p2"])
    assert (r.open, r.close, r.bar_start, r.bar_end, r.available_at) == (1.0, 24.5, start, start + dt.timedelta(hours=24), start + dt.timedelta(hours=24, minutes=1))
