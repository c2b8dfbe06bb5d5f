"""Published series: payload tables (id, content) to long series, each format as column expressions.

Content is text. A row that cannot be read is left out, as is a value that is not finite; nothing is filled in.
"""

from __future__ import annotations

import lzma
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _finite(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("day").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def _number(text: Column) -> Column:
    clean = F.trim(text)
    return F.when(~F.upper(clean).isin("", "NA", "N/A", "NULL", "."), clean.try_cast("double"))


def lines(payloads: DataFrame) -> DataFrame:
    """id, line number and line, without a byte order mark or carriage returns."""
    text = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r", "")
    return payloads.select("id", F.posexplode(F.split(text, "\n")).alias("n", "line"))


def _cells(line: str, separator: str) -> Column:
    """The cells of a line. In a quoted cell separators are text and doubled quotes are one."""
    outside = re.escape(separator) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    bare = lambda c: F.replace(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(F.split(line, outside), lambda c: F.trim(bare(c)))


def delimited(payloads: DataFrame, header: str, separator: str = ",", skip: int = 0) -> DataFrame:
    """Cells of the lines after the first one that matches ``header``, as a map from the header's names: skips any preamble."""
    numbered = lines(payloads)
    names = numbered.where(F.col("line").rlike(header)).groupBy("id").agg(F.min_by("line", "n").alias("names"), F.min("n").alias("at"))
    body = numbered.join(names, "id").where((F.col("n") > F.col("at") + skip) & (F.trim("line") != ""))
    cells, heads = _cells("line", separator), _cells("names", separator)
    size = F.least(F.size(cells), F.size(heads))
    return body.select("id", "n", F.map_from_arrays(F.slice(heads, F.lit(1), size), F.slice(cells, F.lit(1), size)).alias("cells"))


def _wide(rows: DataFrame, day: Column, wanted: dict[str, str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(name).alias("series"), _number(F.col("cells").getItem(column)).alias("value")) for column, name in wanted.items()))
    return _finite(rows.select("id", day.alias("day"), F.explode(pairs).alias("p")).select("id", "p.series", "day", "p.value"))


def dated_csv(payloads: DataFrame, header: str, day_column: str, wanted: dict[str, str], formats: tuple[str, ...] = ("yyyy-MM-dd",)) -> DataFrame:
    """CSV with one row for each day and columns of series: curves with a preamble, condition indices with two date formats, volatility closes."""
    cell = F.substring(F.col("cells").getItem(day_column), 1, 10)
    day = F.coalesce(*(F.try_to_timestamp(cell, F.lit(f)).cast("date") for f in formats))
    return _wide(delimited(payloads, header), day, wanted)


def keyed_csv(payloads: DataFrame, key: str, series: str) -> DataFrame:
    """SDMX CSV: rows of one KEY with TIME_PERIOD and OBS_VALUE."""
    rows = delimited(payloads, "(^|,)KEY(,|$)").where(F.col("cells").getItem("KEY") == key)
    return _finite(rows.select("id", F.lit(series).alias("series"), F.col("cells").getItem("TIME_PERIOD").try_cast("date").alias("day"), _number(F.col("cells").getItem("OBS_VALUE")).alias("value")))


def monthly_tsv(payloads: DataFrame, code: str, columns: dict[int, str]) -> DataFrame:
    """Tab-separated country tables: lines of one code with YYYY-MM, dated to the month's end."""
    cells = F.split("line", "\t")
    rows = lines(payloads).where(F.trim(F.get(cells, F.lit(1))) == code)
    day = F.last_day(F.concat(F.trim(F.get(cells, F.lit(2))), F.lit("-01")).try_cast("date"))
    pairs = F.array(*(F.struct(F.lit(name).alias("series"), _number(F.get(cells, F.lit(i))).alias("value")) for i, name in columns.items()))
    return _finite(rows.select("id", day.alias("day"), F.explode(pairs).alias("p")).select("id", "p.series", "day", "p.value"))


def atom_xml(payloads: DataFrame, day_tag: str, wanted: dict[str, str]) -> DataFrame:
    """Entries of an Atom feed: one date and several named values in each."""
    entries = payloads.select("id", F.explode(F.regexp_extract_all("content", F.lit("(?s)<entry\\b.*?</entry>"), 0)).alias("e"))

    def tag(name: str) -> Column:
        return F.regexp_extract("e", rf"(?s)<(?:\w+:)?{name}\b[^>]*>([^<]*)</", 1)

    pairs = F.array(*(F.struct(F.lit(name).alias("series"), _number(tag(t)).alias("value")) for t, name in wanted.items()))
    return _finite(entries.select("id", F.substring(tag(day_tag), 1, 10).try_cast("date").alias("day"), F.explode(pairs).alias("p")).select("id", "p.series", "day", "p.value"))


def cube_xml(payloads: DataFrame, currency: str, series: str) -> DataFrame:
    """Nested <Cube time> / <Cube currency rate> elements of reference rates."""
    days = payloads.select("id", F.explode(F.regexp_extract_all("content", F.lit("(?s)<Cube\\s+time=.*?</Cube>"), 0)).alias("c"))
    rate = F.coalesce(*(F.nullif(F.regexp_extract("c", p, 1), F.lit("")) for p in (rf"currency=[\"']{currency}[\"']\s+rate=[\"']([^\"']*)", rf"rate=[\"']([^\"']*)[\"']\s+currency=[\"']{currency}[\"']")))
    return _finite(days.select("id", F.lit(series).alias("series"), F.regexp_extract("c", "time=[\"']([^\"']*)", 1).try_cast("date").alias("day"), _number(rate).alias("value")))


def sdmx_xml(payloads: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """<Series SERIES_NAME> elements with <Obs TIME_PERIOD OBS_VALUE>."""
    each = payloads.select("id", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<(?:\w+:)?Series\b.*?</(?:\w+:)?Series>"), 0)).alias("s"))
    named = each.withColumn("code", F.regexp_extract("s", 'SERIES_NAME="([^"]*)"', 1)).where(F.col("code").isin(*wanted))
    names = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair))
    obs = named.select("id", names[F.col("code")].alias("series"), F.explode(F.regexp_extract_all("s", F.lit(r"<(?:\w+:)?Obs\b[^>]*>"), 0)).alias("o"))
    return _finite(obs.select("id", "series", F.substring(F.regexp_extract("o", 'TIME_PERIOD="([^"]*)"', 1), 1, 10).try_cast("date").alias("day"), _number(F.regexp_extract("o", 'OBS_VALUE="([^"]*)"', 1)).alias("value")))


def ratio(rows: DataFrame, total: str) -> DataFrame:
    """Each series divided by the series ``total`` of the same payload and day, where that is positive."""
    base = rows.where(F.col("series") == total).select("id", "day", F.col("value").alias("total")).where("total > 0")
    return rows.where(F.col("series") != total).join(base, ["id", "day"]).select("id", "series", "day", (F.col("value") / F.col("total")).alias("value"))


def chart_json(payloads: DataFrame, series: str) -> DataFrame:
    """Parallel arrays of a chart: adjusted closes if there is one for each time, else plain closes; positive ones, the last of a day."""
    schema = "chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<close: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"
    r = payloads.select("id", F.from_json("content", schema).alias("j")).select("id", F.expr("get(j.chart.result, 0)").alias("r"))
    times, adjusted, plain = F.col("r.timestamp"), F.expr("get(r.indicators.adjclose, 0).adjclose"), F.expr("get(r.indicators.quote, 0).close")
    closes = F.when(F.size(adjusted) == F.size(times), adjusted).otherwise(plain)
    rows = r.select("id", F.posexplode(F.arrays_zip(times.alias("t"), closes.alias("c"))).alias("pos", "z"))
    kept = rows.select("id", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("z.t") / 86400).cast("int")).alias("day"), F.col("z.c").alias("value"), "pos").where("value > 0")
    return _finite(kept.groupBy("id", "day").agg(F.max_by("value", "pos").alias("value")).select("id", F.lit(series).alias("series"), "day", "value"))


def flat_records(payloads: DataFrame, header: list[str]) -> DataFrame:
    """A flat JSON array that repeats a header's fields, cut into records (id, n, map of field to JSON text)."""
    k = len(header)
    values = payloads.select("id", F.from_json("content", "array<string>").alias("v")).where((F.size("v") > 0) & (F.size("v") % k == 0))
    rows = values.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("v") / k).cast("int") - 1), lambda i: F.slice(F.col("v"), i * k + 1, F.lit(k)))).alias("n", "cells"))
    return rows.select("id", "n", F.map_from_arrays(F.array(*(F.lit(h) for h in header)), "cells").alias("record"))


def unzip(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Members of ZIP payloads (id, content binary) as text: id, member, content. A payload is one task's row, so archives should be of moderate size."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, body in zip(part["id"], part["content"], strict=True):
                with zipfile.ZipFile(BytesIO(body)) as archive:
                    out += [(key, name, archive.read(name).decode("utf-8-sig", "replace")) for name in sorted(archive.namelist()) if name.lower().endswith(suffixes)]
            yield pd.DataFrame(out, columns=["id", "member", "content"])

    return files.select("id", "content").mapInPandas(run, "id string, member string, content string")


#: 20-byte records: milliseconds, ask and bid in points, ask and bid volume, big-endian.
TICK = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])


def decode_ticks(body: bytes, name: str) -> np.ndarray:
    """The records of one LZMA tick file. Broken, unordered or impossible ticks are an error that names the file."""
    try:
        raw = lzma.decompress(body)
    except lzma.LZMAError as error:
        raise ValueError(f"{name}: not an LZMA file") from error
    if not raw or len(raw) % TICK.itemsize:
        raise ValueError(f"{name}: misaligned tick file")
    t = np.frombuffer(raw, TICK)
    ms = t["ms"].astype(np.int64)
    volumes = np.concatenate([t["ask_volume"], t["bid_volume"]]).astype(float)
    if (np.diff(ms) < 0).any() or ms[-1] >= 86_400_000 or (t["ask"] < t["bid"]).any() or (t["bid"] == 0).any() or not np.isfinite(volumes).all() or (volumes < 0).any():
        raise ValueError(f"{name}: ticks out of order or range")
    return t


def tick_files(files: DataFrame, points: int = 100_000) -> DataFrame:
    """LZMA tick files (id, day, content binary): id, ts (naive UTC), tick_id, bid, ask, volumes. A broken file is an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, day, body in zip(part["id"], part["day"], part["content"], strict=True):
                t = decode_ticks(body, key)
                ms = t["ms"].astype(np.int64)
                yield pd.DataFrame({"id": key, "ts": pd.Timestamp(day) + pd.to_timedelta(ms, unit="ms"), "tick_id": np.arange(len(t)), "bid": t["bid"].astype(float) / points, "ask": t["ask"].astype(float) / points, "bid_volume": t["bid_volume"].astype(float), "ask_volume": t["ask_volume"].astype(float)})

    return files.select("id", "day", "content").mapInPandas(run, "id string, ts timestamp_ntz, tick_id long, bid double, ask double, bid_volume double, ask_volume double")


def observations(rows: DataFrame, url: str, sha256: str, available: Column) -> DataFrame:
    """Series rows with provenance and the instant from which they may be used (null: unknown)."""
    return rows.select("series", F.col("day").alias("observation_date"), "value", available.alias("available_at"), F.lit(url).alias("source_url"), F.lit(sha256).alias("raw_payload_hash"), F.when(available.isNull(), "unknown").otherwise("inferred_conservative").alias("time_quality"))


def release_instant(day: Column, rule: str) -> Column:
    """Naive UTC instant at which a figure for ``day`` is out: a daily close the next midnight, weekly indices on a weekday in New York, monthly tables 60 days after the month."""
    from ..operators.temporal import local_instant

    if rule == "daily_close":
        return F.date_add(day, 1).cast("timestamp_ntz")
    if rule == "weekly_wednesday":
        return local_instant(F.next_day(day, "Wed"), "08:30", "America/New_York")
    if rule == "weekly_thursday":
        return local_instant(F.next_day(day, "Thu"), "16:30", "America/New_York")
    if rule == "weekly_energy":
        return local_instant(F.date_add(day, 7), "00:00", "America/New_York")
    if rule == "monthly":
        return F.date_add(F.last_day(day), 60).cast("timestamp_ntz") + F.expr("INTERVAL 21 HOURS")
    raise ValueError(f"no release rule {rule}")


def last_of_day(rows: DataFrame) -> DataFrame:
    """One value for each series and day: that of the last payload."""
    rank = F.row_number().over(Window.partitionBy("series", "day").orderBy(F.desc("id")))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")
