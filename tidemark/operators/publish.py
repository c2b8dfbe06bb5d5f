"""Content-addressed publication: a dataset's name comes from its rows, and a run that finds it there changes nothing."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.raw import create_json, read_json, versions, write_json


def content_id(rows: DataFrame, salt: str = "", places: int = 12) -> str:
    """20 hex digits that depend on the rows but not on their order or partitions.

    Each row's canonical JSON (columns by name, doubles rounded) is hashed; the hashes are summed in two independent 60-bit halves, so the driver gets two numbers.
    """
    columns = [F.round(c, places).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in sorted(rows.dtypes)]
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(digest, at, 10), 16, 10).cast("decimal(38,0)") for at in (1, 20)]
    sums = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(h), F.lit(0)).cast("string").alias(f"h{i}") for i, h in enumerate(halves))).first()
    return hashlib.sha256(f"{salt}|{sums['n']}|{sums['h0']}|{sums['h1']}".encode()).hexdigest()[:20]


def publish(rows: DataFrame, folder: str, name: str, manifest: str, details: dict | None = None, by: list[str] | None = None) -> dict:
    """Write rows as Parquet under their content id and name it in the manifest; the manifest changes last."""
    dataset = content_id(rows, name)
    path = f"{folder}/{name}/{dataset}"
    jpath = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = jpath.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).exists(jpath)
    if not there:
        (rows.sortWithinPartitions(*by) if by else rows).write.mode("overwrite").parquet(path)
    report = {"name": name, "dataset": dataset, "path": path, "rows": rows.sparkSession.read.parquet(path).count(), **(details or {})}
    write_json(rows.sparkSession, manifest, report)
    return report


class Refused(ValueError):
    """A publication that did not take place; what was published before still stands."""


def current(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """Version and content of a manifest folder's latest manifest; 0 and None where there is none."""
    found = versions(spark, folder)
    return (found[-1], read_json(spark, f"{folder}/{found[-1]:010d}.json")) if found else (0, None)


def publish_version(rows: DataFrame, folder: str, name: str, version: int, details: dict | None = None, by: list[str] | None = None, pins: DataFrame | None = None, expected: str | None = None) -> dict:
    """Publish rows as the version after ``version`` of ``folder``/manifests, or refuse and leave all as it was.

    The gate comes first: every pin (a row of ``raw.pinned``) must be usable, and with ``expected`` the rows must have that content id, as a replay of recorded payloads must. Then the rows are written under their content id, and last the
    manifest is created under the next number, which fails if another writer has created it meanwhile. Manifests are never changed, so earlier versions stay readable.
    """
    spark = rows.sparkSession
    if pins is not None:
        bad = pins.where("not usable").select("source", "url").limit(3).collect()
        if bad:
            raise Refused(f"payloads missing or changed: {', '.join(f'{r.source} {r.url}' for r in bad)}")
    dataset = content_id(rows, name)
    if expected is not None and dataset != expected:
        raise Refused(f"replay gives {dataset} instead of {expected}")
    if current(spark, f"{folder}/manifests")[0] != version:
        raise Refused("another version was published meanwhile")
    path = f"{folder}/{name}/{dataset}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        (rows.sortWithinPartitions(*by) if by else rows).write.mode("overwrite").parquet(path)
    report = {"name": name, "version": version + 1, "dataset": dataset, "path": path, "rows": spark.read.parquet(path).count(), **(details or {})}
    if pins is not None:
        report["payloads"] = content_id(pins.select("source", "url", "sha256"), "payloads")
    if not create_json(spark, f"{folder}/manifests/{version + 1:010d}.json", report):
        raise Refused("another version was published meanwhile")
    return report


def published(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest if none is named."""
    latest, manifest = current(spark, f"{folder}/manifests")
    if version is not None and version != latest:
        manifest = read_json(spark, f"{folder}/manifests/{version:010d}.json")
    if manifest is None:
        raise ValueError("nothing was published yet")
    return spark.read.parquet(manifest["path"])


def replay(rows: DataFrame, folder: str, name: str, pins: DataFrame, details: dict | None = None) -> dict:
    """Publish what the recorded payloads give again: it must be what the latest manifest says, else the replay is refused. Returns the new manifest."""
    version, manifest = current(rows.sparkSession, f"{folder}/manifests")
    if manifest is None:
        raise Refused("there is no version to replay")
    return publish_version(rows, folder, name, version, {**(details or {}), "replay_of": version}, pins=pins, expected=manifest["dataset"])
