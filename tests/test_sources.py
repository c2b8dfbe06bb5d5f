"""Readers on small literals, with what they must refuse."""

import datetime as dt
import io
import json
import lzma
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import publish
from tidemark.sources import raw, releases, series

D = dt.date


def rows(df):
    return sorted((r.series, r.day, r.value) for r in df.collect())


def payload(spark, text):
    return spark.createDataFrame([("p", text)], "id string, content string")


def test_delimited_series(spark):
    curve = "A note\nmore, notes\nDate,BKEVEN05,TIPSY05\n2024-01-02,1.5,NA\n2024-01-03,,0.25\n,1,1\n"
    assert rows(series.dated_csv(payload(spark, curve), "(?i)^date,", "Date", {"BKEVEN05": "b5", "TIPSY05": "t5"})) == [("b5", D(2024, 1, 2), 1.5), ("t5", D(2024, 1, 3), 0.25)]
    index = "﻿Friday_of_Week,NFCI,ANFCI\r\n01/05/2024,-0.5,-0.4\r\n2024-01-12,-0.6,\r\n"
    assert rows(series.dated_csv(payload(spark, index), "Friday_of_Week", "Friday_of_Week", {"NFCI": "n", "ANFCI": "a"}, ("MM/dd/yyyy", "yyyy-MM-dd"))) == [("a", D(2024, 1, 5), -0.4), ("n", D(2024, 1, 5), -0.5), ("n", D(2024, 1, 12), -0.6)]
    sdmx = "KEY,TIME_PERIOD,OBS_VALUE\nX.Y,2024-01-02,2.5\nX.Z,2024-01-02,9\nX.Y,2024-01-03,\n"
    assert rows(series.keyed_csv(payload(spark, sdmx), "X.Y", "ea")) == [("ea", D(2024, 1, 2), 2.5)]
    tsv = "Country\tCountry Code\tDate\tTotal\tx\tLong\ty\nGrand\t99996\t2024-02\t10\t0\t7.5\t0\nOther\t11111\t2024-02\t1\t0\t1\t0\nGrand\t99996\tbad\t1\t0\t1\t0\n"
    assert rows(series.monthly_tsv(payload(spark, tsv), "99996", {3: "total", 5: "long"})) == [("long", D(2024, 2, 29), 7.5), ("total", D(2024, 2, 29), 10.0)]


def test_xml_series(spark):
    atom = "<feed><entry><content><m:properties><d:NEW_DATE>2024-01-02T00:00:00</d:NEW_DATE><d:BC_2YEAR>4.3</d:BC_2YEAR><d:BC_10YEAR></d:BC_10YEAR></m:properties></content></entry><entry><m:properties><d:NEW_DATE>2024-01-03</d:NEW_DATE><d:BC_2YEAR>4.4</d:BC_2YEAR><d:BC_10YEAR>4</d:BC_10YEAR></m:properties></entry></feed>"
    assert rows(series.atom_xml(payload(spark, atom), "NEW_DATE", {"BC_2YEAR": "y2", "BC_10YEAR": "y10"})) == [("y10", D(2024, 1, 3), 4.0), ("y2", D(2024, 1, 2), 4.3), ("y2", D(2024, 1, 3), 4.4)]
    cube = "<Cube><Cube time='2024-01-02'><Cube currency='USD' rate='1.0956'/><Cube currency='JPY' rate='155.7'/></Cube><Cube time='2024-01-03'><Cube currency='USD' rate='1.09'/></Cube></Cube>"
    assert rows(series.cube_xml(payload(spark, cube), "USD", "fx")) == [("fx", D(2024, 1, 2), 1.0956), ("fx", D(2024, 1, 3), 1.09)]
    body = '<DataSet><kf:Series SERIES_NAME="A.W"><frb:Obs OBS_VALUE="5" TIME_PERIOD="2024-01-03" /><frb:Obs OBS_VALUE="bad" TIME_PERIOD="2024-01-10"/></kf:Series><kf:Series SERIES_NAME="T.W"><frb:Obs TIME_PERIOD="2024-01-03" OBS_VALUE="20"/></kf:Series></DataSet>'
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("data.xml", body)
    files = spark.createDataFrame([("z", bytearray(archive.getvalue()))], "id string, content binary")
    text = series.unzip(files, (".xml",)).select("id", "content")
    assert rows(series.ratio(series.sdmx_xml(text, {"A.W": "a", "T.W": "total"}), "total")) == [("a", D(2024, 1, 3), 0.25)]


def test_json_series(spark):
    chart = '{"chart":{"result":[{"timestamp":[1704153600,1704240000,1704250000],"indicators":{"quote":[{"close":[1,2,3]}],"adjclose":[{"adjclose":[1.5,null,2.5]}]}}]}}'
    assert rows(series.chart_json(payload(spark, chart), "c")) == [("c", D(2024, 1, 2), 1.5), ("c", D(2024, 1, 3), 2.5)]
    flat = '[1, "a", {"x": 1}, 2, "b", null]'
    got = {(r.n, r.record["title"]) for r in series.flat_records(payload(spark, flat), ["id", "title", "more"]).collect()}
    assert got == {(0, "a"), (1, "b")}
    assert series.flat_records(payload(spark, "[1, 2]"), ["a", "b", "c"]).count() == 0


def test_tick_files(spark):
    def file(ticks):
        return bytearray(lzma.compress(b"".join(struct.pack(">3I2f", *t) for t in ticks)))

    good = file([(500, 121030, 121000, 3, 1), (42_250, 121045, 121015, 2, 2), (60_000, 121060, 121035, 1, 1)])
    frame = lambda body: spark.createDataFrame([("f", D(2024, 1, 11), body)], "id string, day date, content binary")
    from tidemark.operators import bars

    out = {r.bar_start: r for r in bars.quote_bars(series.tick_files(frame(good))).collect()}
    first = out[dt.datetime(2024, 1, 11)]
    assert len(out) == 2 and (first.bid_open, first.bid_high, first.bid_close, first.ticks) == (1.21, 1.21015, 1.21015, 2)
    for bad in ([(5, 2, 1, 0, 0), (4, 2, 1, 0, 0)], [(5, 1, 2, 0, 0)], [(86_400_000, 2, 1, 0, 0)]):
        with pytest.raises(Exception):
            series.tick_files(frame(file(bad))).collect()


def test_release_rules(spark):
    day = spark.createDataFrame([(D(2024, 1, 5),)], "d date")
    got = {rule: day.select(series.release_instant(F.col("d"), rule)).first()[0] for rule in ("daily_close", "weekly_wednesday", "weekly_thursday", "monthly")}
    assert got == {"daily_close": dt.datetime(2024, 1, 6), "weekly_wednesday": dt.datetime(2024, 1, 10, 13, 30), "weekly_thursday": dt.datetime(2024, 1, 11, 21, 30), "monthly": dt.datetime(2024, 3, 31, 21)}


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


def test_release_texts(spark):
    page = "Bureau news. Transmission of material in this release is embargoed until 8:30 a.m. (ET) Wednesday, May 12, 2027. Prices, in short."
    assert value(spark, releases.embargo, page) == dt.datetime(2027, 5, 12, 12, 30)
    assert value(spark, releases.embargo, page.replace("May", "December")) == dt.datetime(2027, 12, 12, 13, 30)
    assert value(spark, releases.embargo, page.replace("(ET)", "(CT)")) is None and value(spark, releases.embargo, "no time") is None
    one = "The Consumer Price Index for All Urban Consumers (CPI-U) fell 0.4 percent in March on a seasonally adjusted basis. Over the last 12 months, the all items index increased 2.6 percent. The index for all items less food and energy rose 0.3 percent in March."
    assert value(spark, releases.consumer_prices, one) == -0.4 and value(spark, releases.core_prices, one) == 0.3
    assert value(spark, lambda t: releases.consumer_prices(t, 2), one) is None
    two = "The Consumer Price Index for All Urban Consumers (CPI-U) increased 0.5 percent on a seasonally adjusted basis over the 2 months. The seasonally adjusted index for all items less food and energy advanced by 0.6 percent over the 2 months."
    assert value(spark, releases.consumer_prices, two) is None and value(spark, releases.core_prices, two) is None
    assert value(spark, lambda t: releases.consumer_prices(t, 2), two) == 0.5 and value(spark, lambda t: releases.core_prices(t, 2), two) == 0.6
    still = "The index for all items less food and energy was unchanged over the month. The food index rose 9 percent."
    assert value(spark, releases.core_prices, still) == 0.0
    jobs = "Total nonfarm payroll employment {} in May."
    for said, expected in (("increased by 31,500", 31.5), ("fell by 7,000", -7.0), ("edged up by 12,000", 12.0), ("changed little (+2,500)", 2.5), ("was essentially unchanged (-1,000)", -1.0), ("was a topic", None)):
        assert value(spark, releases.payrolls, jobs.format(said)) == expected


def test_release_figures_of_other_periods_and_signs(spark):
    core = "The index for all items less food and energy {}"
    for said, month, two in (
        ("rose 2.6 percent over the last 12 months.", None, None), ("rose 2.6 percent over the year.", None, None), ("rose 0.2 percent.", None, None), ("rose 0.2 percent in June.", 0.2, None), ("fell 0.1 percent over the month.", -0.1, None),
        ("was unchanged in June. The all items less food and energy index rose 2.6 percent over the year.", 0.0, None), ("rose 0.2 percent over the 2 months ending in November.", None, 0.2), ("was unchanged over the year.", None, None),
    ):
        assert value(spark, releases.core_prices, core.format(said)) == month and value(spark, lambda t: releases.core_prices(t, 2), core.format(said)) == two
    prices = "The Consumer Price Index for All Urban Consumers (CPI-U) {}"
    for said, month in (("declined 0.1 percent on a seasonally adjusted basis.", -0.1), ("was unchanged in May on a seasonally adjusted basis.", 0.0), ("rose 3.4 percent over the last 12 months.", None), ("rose 0.2 percent on a seasonally adjusted basis over the 2 months from September 2025 to November 2025.", None)):
        assert value(spark, releases.consumer_prices, prices.format(said)) == month
    jobs = "Total nonfarm payroll employment {}."
    for said, expected in (
        ("edged down in October (-12,000)", -12.0), ("increased in 2024 by 175,000", 175.0), ("was little changed in October (+12,000)", 12.0), ("edged down by 92,000 in February", -92.0), ("rose in May 2024 by 8,000", 8.0), ("was unchanged", 0.0), ("rose in 2024", None),
    ):
        assert value(spark, releases.payrolls, jobs.format(said)) == expected


def test_archive_links(spark):
    page = """<a href="/news.release/archives/cpi_07112024.htm">June 2024 <b>Consumer</b> Price Index</a> <a href="/news.release/archives/cpi_08142024.pdf">July 2024 Consumer Price Index</a>
        <A class='x' HREF='https://other.example/archives/cpi_01152027.html'>December 2026 CPI</A><a href="/news.release/archives/empsit_07052024.htm">June 2024 Jobs</a><a href="/news.release/archives/cpi_02132024.htm">no period</a>"""
    got = [(r.observation_period, r.url, r.label) for r in value(spark, lambda t: releases.archive_links(t, "cpi"), page)]
    assert got == [("2024-06", "https://www.bls.gov/news.release/archives/cpi_07112024.htm", "June 2024 Consumer Price Index"), ("2026-12", "https://other.example/archives/cpi_01152027.html", "December 2026 CPI")]


def test_decision_texts(spark):
    text = "March 17, 2027 For release at 2:00 p.m. EDT. In support of its goals, the Committee decided to maintain the target range for the federal funds rate at 2‑3/4 to 3 percent. Markets had looked for 4 to 5 percent."
    got = value(spark, releases.target_range, text)
    assert (got.lower, got.upper) == (2.75, 3.0)
    assert value(spark, releases.target_range, "the federal funds rate is at 1 to 2 percent") is None
    assert value(spark, releases.target_range, "the target range for the federal funds rate to 3 to 2 percent") is None
    assert value(spark, releases.statement_time, text) == dt.datetime(2027, 3, 17, 18)
    assert value(spark, releases.statement_time, text.replace("EDT", "EST")) is None
    first = "The committees of both houses will meet on Monday and Tuesday, respectively. "
    bank = first + "Accordingly, the interest rates on the deposit facility, the main refinancing operations and the marginal lending facility will be set at 1.50%, 1,65 % and 1.9% respectively, with effect from 9 June 2027."
    assert value(spark, releases.key_rates, bank) == {"deposit": 1.5, "refinancing": 1.65, "lending": 1.9}
    assert value(spark, releases.key_rates, first) is None
    assert value(spark, releases.effective_date, bank) == D(2027, 6, 9)
    html = "<title>Dates of 2027</title><table><tr><th>March</th><td>5</td><td>12*, 19</td></tr><TR><td>April</td><td>2, 31</td></tr><tr><td>Note</td><td>9</td></tr></table>"
    assert value(spark, releases.schedule_days, html) == [D(2027, 3, 5), D(2027, 3, 12), D(2027, 3, 19), D(2027, 4, 2)]


def test_positions(spark):
    reports = [(D(2027, 3, 2), 1000, 300, 100, 50, 70), (D(2027, 3, 9), 0, 1, 1, 1, 1), (D(2027, 3, 16), 500, 5, -1, 0, 0), (D(2027, 3, 23), 500, 10, 20, 0, 0), (D(2027, 6, 1), 400, 1, None, 1, 1), (D(2027, 6, 8), 400, 1, 1, 1, 1), (D(2027, 6, 8), 400, 1, 1, 1, 1)]
    df = spark.createDataFrame(reports, "report_date date, open_interest long, a_long long, a_short long, b_long long, b_short long")
    schedule = spark.createDataFrame([(D(2027, 3, 5),), (D(2027, 3, 12),), (D(2027, 3, 26),)], "release date")
    got = {r.report_date: r for r in releases.positions(df, schedule, {"funds": "a", "rest": "b"}).collect()}
    r = got[D(2027, 3, 2)]
    assert (r.funds_net, r.funds_net_share, r.rest_net, r.reject, r.time_quality) == (200, 0.2, -20, "", "inferred_conservative")
    assert (r.scheduled_at, r.available_at) == (dt.datetime(2027, 3, 5, 20, 30), dt.datetime(2027, 3, 6, 5))
    r = got[D(2027, 3, 23)]
    assert (r.funds_net, r.scheduled_at, r.available_at) == (-10, dt.datetime(2027, 3, 26, 19, 30), dt.datetime(2027, 3, 27, 4))
    assert [got[d].reject for d in (D(2027, 3, 9), D(2027, 3, 16), D(2027, 6, 1), D(2027, 6, 8))] == ["open_interest", "negative_position", "negative_position", "duplicate_date"]
    assert got[D(2027, 6, 1)].time_quality == "unknown" and got[D(2027, 6, 1)].available_at is None and got[D(2027, 3, 9)].funds_net is None


def test_raw_store_and_publication(spark, tmp_path):
    folder, at = str(tmp_path / "store"), dt.datetime(2027, 1, 1)
    body = lambda *x: spark.createDataFrame([("x", "u", 200, at, bytearray(b)) for b in x], "source string, url string, status int, fetched_at timestamp, content binary")
    raw.keep(body(b"one", b"two"), folder)
    raw.keep(body(b"one"), folder)
    files, notes = raw.payloads(spark, folder), raw.receipts(spark, folder)
    assert files.count() == 2 and notes.count() == 3 and raw.pinned(notes, files).where("usable").count() == 3
    changed = files.select("source", "sha256", F.lit(b"changed").alias("content")).withColumn("intact", F.sha2("content", 256) == F.col("sha256"))
    assert raw.pinned(notes, changed).where("usable").count() == 0
    assert raw.payloads(spark, str(tmp_path / "none")).count() == 0
    df = spark.range(100).select("id", (F.col("id") / 3).alias("v"))
    assert publish.content_id(df) == publish.content_id(df.repartition(7)) != publish.content_id(df.where("id > 0"))
    manifest = tmp_path / "m.json"
    one = publish.publish(df, str(tmp_path), "set", str(manifest))
    two = publish.publish(df.repartition(3), str(tmp_path), "set", str(manifest))
    assert one == two == json.loads(manifest.read_text()) and one["rows"] == 100
    with pytest.raises(ValueError):
        raw.write_json(spark, str(tmp_path / "bad.json"), {"x": float("nan")})
    assert not (tmp_path / "bad.json").exists()
