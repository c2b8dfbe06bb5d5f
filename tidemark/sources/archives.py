"""Archives as Spark data sources: a task for each member, files left out by their day, and only the columns that are asked for are decoded.

``read_ticks`` reads a folder of LZMA tick files, one a day; ``read_members`` reads the text members of ZIP files. Files are found and opened through Arrow's file systems, so a folder is a path or a URI that
every executor can open.
"""

from __future__ import annotations

import datetime as dt
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .series import decode_ticks

TICKS = "day date, ms long, tick_id long, ts timestamp_ntz, bid double, ask double, bid_volume double, ask_volume double"
MEMBERS = "archive string, member string, content string"
#: Records that leave a task at once.
AT_ONCE = 1 << 16
#: Bytes up to which a ZIP file is read in whole.
READ_WHOLE = 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@contextmanager
def _archive(path: str, name: str) -> Iterator[zipfile.ZipFile]:
    """A ZIP file of a folder. Small ones are read at once; of larger ones only what is asked for."""
    system, inside = _opened(path)
    with system.open_input_file(f"{inside}/{name}") as file, zipfile.ZipFile(BytesIO(file.read()) if file.size() <= READ_WHOLE else file) as archive:
        yield archive


def _found(path: str, suffix: str) -> list[str]:
    """Names of a folder's files with the suffix, in order; those that begin with a dot or an underline are not looked at."""
    system, inside = _opened(path)
    entries = system.get_file_info(fs.FileSelector(inside, recursive=False, allow_not_found=True))
    return sorted(e.base_name for e in entries if e.type == fs.FileType.File and e.base_name.endswith(suffix) and e.base_name[0] not in "._")


@dataclass
class Member(InputPartition):
    """One file of a folder, or one member of an archive in it."""

    file: str
    member: str = ""


def _arrow_schema(schema: StructType) -> pa.Schema:
    kinds = {"date": pa.date32(), "bigint": pa.int64(), "timestamp_ntz": pa.timestamp("us"), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


class TickReader(DataSourceReader):
    """Files named <yyyy-mm-dd>.bi5. Conditions on ``day`` leave out files before any is opened."""

    def __init__(self, path: str, points: int, schema: StructType):
        self.path, self.points, self.schema = path, points, _arrow_schema(schema)
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if isinstance(one, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In) and one.attribute == ("day",):
                self.conditions.append(one)  # a file is one day, so the condition is met in whole
            else:
                yield one

    def _wanted(self, day: dt.date) -> bool:
        tests = {EqualTo: lambda v: day == v, GreaterThan: lambda v: day > v, GreaterThanOrEqual: lambda v: day >= v, LessThan: lambda v: day < v, LessThanOrEqual: lambda v: day <= v, In: lambda v: day in v}
        return all(tests[type(c)](c.value) for c in self.conditions)

    def partitions(self) -> list[Member]:
        return [Member(name) for name in _found(self.path, ".bi5") if self._wanted(dt.date.fromisoformat(name[:10]))] or [Member("")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, inside = _opened(self.path)
        with system.open_input_stream(f"{inside}/{partition.file}") as stream:
            t = decode_ticks(stream.read(), partition.file)
        day = dt.date.fromisoformat(partition.file[:10])
        ms = t["ms"].astype(np.int64)
        columns = {
            "day": lambda a: pa.array(np.full(len(a), day), pa.date32()), "ms": lambda a: pa.array(ms[a]), "tick_id": lambda a: pa.array(a),
            "ts": lambda a: pa.array(np.datetime64(day, "us") + ms[a].astype("timedelta64[ms]")), "bid": lambda a: pa.array(t["bid"][a].astype(float) / self.points), "ask": lambda a: pa.array(t["ask"][a].astype(float) / self.points),
            "bid_volume": lambda a: pa.array(t["bid_volume"][a].astype(float)), "ask_volume": lambda a: pa.array(t["ask_volume"][a].astype(float)),
        }
        for at in range(0, len(t), AT_ONCE):
            rows = np.arange(at, min(at + AT_ONCE, len(t)))
            yield pa.RecordBatch.from_arrays([columns[name](rows) for name in self.schema.names], schema=self.schema)


class TickArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tick_archive"

    def schema(self) -> str:
        return TICKS

    def reader(self, schema: StructType) -> TickReader:
        return TickReader(self.options["path"], int(self.options.get("points", "100000")), schema)


class MemberReader(DataSourceReader):
    """A task for each member of each ZIP file. The driver reads the archives' tables of contents, a task its own member."""

    def __init__(self, path: str, suffixes: tuple[str, ...], schema: StructType):
        self.path, self.suffixes, self.schema = path, suffixes, _arrow_schema(schema)

    def partitions(self) -> list[Member]:
        out = []
        for name in _found(self.path, ".zip"):
            with _archive(self.path, name) as archive:
                out += [Member(name, m) for m in sorted(archive.namelist()) if m.lower().endswith(self.suffixes)]
        return out or [Member("")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        values = {"archive": partition.file, "member": partition.member}
        if "content" in self.schema.names:
            with _archive(self.path, partition.file) as archive:
                values["content"] = archive.read(partition.member).decode("utf-8-sig", "replace")
        yield pa.RecordBatch.from_arrays([pa.array([values[c]]) for c in self.schema.names], schema=self.schema)


class MemberArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(self.options["path"], tuple(self.options.get("suffixes", ".csv,.xml,.txt").split(",")), schema)


def _some(schema: str, columns: list[str] | None) -> str:
    kinds = dict(x.split(" ") for x in schema.split(", "))
    return ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)


def read_ticks(spark: SparkSession, folder: str, columns: list[str] | None = None, points: int = 100_000) -> DataFrame:
    """Ticks of a folder of daily LZMA files, of the named columns. Conditions on ``day``, if it is among them, are met by leaving out files. A broken file ends the job."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TickArchive)
    return spark.read.format("tick_archive").schema(_some(TICKS, columns)).option("points", points).load(folder)


def read_members(spark: SparkSession, folder: str, columns: list[str] | None = None, suffixes: tuple[str, ...] = (".csv", ".xml", ".txt")) -> DataFrame:
    """Text members of a folder's ZIP files: ``archive member content``, one row each."""
    spark.dataSource.register(MemberArchive)
    return spark.read.format("member_archive").schema(_some(MEMBERS, columns)).option("suffixes", ",".join(suffixes)).load(folder)


def write_files(files: DataFrame, folder: str) -> int:
    """Write (name, content) rows as files of a folder, each by its task; how many. A file is written beside its place and then moved there, so a task that runs twice leaves one whole file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = _opened(folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                beside = f"{inside}/.{name}-{dt.datetime.now().timestamp()}"
                system.create_dir(inside)
                with system.open_output_stream(beside) as out:
                    out.write(content)
                system.move(beside, f"{inside}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
