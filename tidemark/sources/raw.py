"""Raw payloads as tables: bodies once by their hash, a receipt for each fetch, and checked reading back. All files go through Spark or its Hadoop file system."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BODIES = "source string, sha256 string, content binary"
RECEIPTS = "source string, url string, sha256 string, bytes long, status int, fetched_at timestamp"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written beside its place and then renamed over it, so that a reader sees the old one or the new one."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(str(path))
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else jvm.java.io.File("/").toURI(), spark._jsc.hadoopConfiguration())
    system = beside.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(beside)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(system.makeQualified(beside), system.makeQualified(target), over)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """As ``write_text``; NaN and infinity are errors."""
    write_text(spark, path, json.dumps(value, sort_keys=True, allow_nan=False))


def create_json(spark: SparkSession, path: str, value: object) -> bool:
    """Create a small JSON file unless it is there already; whether this call created it. Of several writers one creates it: the file is written aside and renamed without overwriting, which the file systems do in one step."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(str(path))
    beside = jvm.org.apache.hadoop.fs.Path(f"{target.getParent()}/.{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else jvm.java.io.File("/").toURI(), spark._jsc.hadoopConfiguration())
    out = system.create(beside)
    out.write(bytearray(json.dumps(value, sort_keys=True, allow_nan=False).encode("utf-8")))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(system.makeQualified(beside), system.makeQualified(target), none)
    except Py4JJavaError as error:
        system.delete(beside, False)
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of a folder's <number>.json files, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def keep(fetched: DataFrame, folder: str) -> DataFrame:
    """Store fetched bodies (``source url status fetched_at content``) and return their receipts.

    A body that the store has already is not written again. Bodies are written before receipts, so a receipt never lacks its body; a run that ends
    between the two leaves a body that the next run finds.
    """
    spark = fetched.sparkSession
    seen = fetched.withColumns({"sha256": F.sha2("content", 256), "bytes": F.octet_length("content").cast("long")})
    new = seen.select("source", "sha256", "content").join(payloads(spark, folder).select("source", "sha256"), ["source", "sha256"], "left_anti")
    new.dropDuplicates(["source", "sha256"]).write.mode("append").parquet(f"{folder}/bodies")
    receipts_ = seen.select("source", "url", "sha256", "bytes", F.col("status").cast("int").alias("status"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    receipts_.write.mode("append").parquet(f"{folder}/receipts")
    return receipts_


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """source, sha256, content and whether the content still has that hash."""
    return _table(spark, folder, "bodies", BODIES).withColumn("intact", F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False)))


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "receipts", RECEIPTS)


def pinned(receipts_: DataFrame, payloads_: DataFrame) -> DataFrame:
    """Receipts with their payloads; one whose body is missing or changed is not usable and must stop a publication."""
    out = receipts_.join(payloads_, ["source", "sha256"], "left")
    return out.withColumn("usable", F.coalesce("intact", F.lit(False)))
