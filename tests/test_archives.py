"""Archives as data sources: what is opened, what is decoded, and what is refused."""

import datetime as dt
import lzma
import struct
import zipfile

import pytest

from tidemark.sources import archives


def ticks(path, day, rows):
    (path / f"{day}.bi5").write_bytes(lzma.compress(b"".join(struct.pack(">3I2f", *r) for r in rows), format=lzma.FORMAT_ALONE))


def test_ticks_of_some_days_and_columns(spark, tmp_path):
    ticks(tmp_path, "2024-01-02", [(0, 110001, 110000, 1.5, 2.0), (59999, 110003, 110002, 0.5, 0.25)])
    ticks(tmp_path, "2024-01-03", [(86399999, 120000, 119000, 1.0, 1.0)])
    (tmp_path / "2024-01-04.bi5").write_bytes(b"broken")
    (tmp_path / ".2024-01-05.bi5").write_bytes(b"unfinished")
    whole = archives.read_ticks(spark, str(tmp_path))
    rows = whole.where("day < date'2024-01-04'").orderBy("ts").collect()
    assert [(r.day, r.ms, r.tick_id, r.ts, r.bid, r.ask, r.bid_volume, r.ask_volume) for r in rows] == [
        (dt.date(2024, 1, 2), 0, 0, dt.datetime(2024, 1, 2), 1.1, 1.10001, 2.0, 1.5), (dt.date(2024, 1, 2), 59999, 1, dt.datetime(2024, 1, 2, 0, 0, 59, 999000), 1.10002, 1.10003, 0.25, 0.5),
        (dt.date(2024, 1, 3), 86399999, 0, dt.datetime(2024, 1, 3, 23, 59, 59, 999000), 1.19, 1.2, 1.0, 1.0)]
    some = archives.read_ticks(spark, str(tmp_path), ["bid", "day"])
    assert some.columns == ["bid", "day"]
    for condition, n in (("day = date'2024-01-03'", 1), ("day in (date'2024-01-02', date'2024-01-03')", 3), ("day >= date'2024-01-03' and day <= date'2024-01-03'", 1), ("day > date'2024-01-05'", 0), ("day <= date'2024-01-03' and bid > 1.15", 1), ("day < date'2024-01-04' and (day = date'2024-01-02' or bid > 1)", 3)):
        assert some.where(condition).count() == n
    for left in ("day = date'2024-01-04'", "bid > 0"):
        with pytest.raises(Exception, match="2024-01-04.bi5: not an LZMA file"):
            some.where(left).collect()
    assert archives.read_ticks(spark, str(tmp_path / "nothing")).count() == 0


def test_impossible_ticks_are_an_error(spark, tmp_path):
    for i, rows in enumerate([[(5, 2, 1, 1, 1), (4, 2, 1, 1, 1)], [(0, 1, 2, 1, 1)], [(86400000, 2, 1, 1, 1)], [(0, 2, 1, -1, 1)], [(0, 2, 0, 1, 1)]]):
        folder = tmp_path / str(i)
        folder.mkdir()
        ticks(folder, "2024-01-02", rows)
        with pytest.raises(Exception, match="out of order or range"):
            archives.read_ticks(spark, str(folder)).collect()


def test_members_of_zip_files(spark, tmp_path):
    for name, members in (("b.zip", {"two.csv": "x,y\n1,2", "skip.bin": "no", "dir/one.XML": "<é/>"}), ("a.zip", {"t.txt": "﻿text"}), ("c.zip", {})):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for member, content in members.items():
                z.writestr(member, content)
    out = archives.read_members(spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [("a.zip", "t.txt", "text"), ("b.zip", "dir/one.XML", "<é/>"), ("b.zip", "two.csv", "x,y\n1,2")]
    assert out.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in archives.read_members(spark, str(tmp_path), ["member"], (".csv",)).collect()) == [("two.csv",)]
    assert archives.read_members(spark, str(tmp_path / "nothing")).count() == 0


def test_files_are_written_whole_and_again(spark, tmp_path):
    rows = spark.createDataFrame([("a.bin", b"1"), ("b.bin", b"22")], "name string, content binary").repartition(2)
    for _ in range(2):
        assert archives.write_files(rows, str(tmp_path / "out")) == 2
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"a.bin": b"1", "b.bin": b"22"}
    assert archives.write_files(rows.limit(0), str(tmp_path / "out")) == 0
