"""JSON lines: writing tables as lines, reading lines that may be broken, and how the fields of many files differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a row. With ``by`` the files together are in that order: ranges of it go to files, and a file is sorted."""
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows
    ordered.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The fields of ``schema``, and of each line that is not blank: ``line`` (the text), ``keys`` (its top-level names, null if it is no object) and ``broken``.

    A line that is no JSON object, or in which a field has another type, is broken; its readable fields stay. Fields beyond the schema only show in ``keys``.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    out = lines.select(F.col("value").alias("line"), parsed.alias("p"), F.json_object_keys("value").alias("keys"))
    return out.select("p.*", "line", "keys", (F.col("p._broken").isNotNull() | F.col("keys").isNull()).alias("broken")).drop("_broken")


def _field_kind(value: Column) -> Column:
    """The type of a variant field; whole numbers of any width are BIGINT, others DOUBLE."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^DECIMAL"), "DOUBLE").otherwise(F.regexp_extract(kind, "^[A-Z]+", 0))


def field_counts(spark: SparkSession, path: str, file: Column | None = None) -> DataFrame:
    """Of each file and top-level field: its type and in how many lines it has it: ``file field kind n`` with the file's number of ``lines``. Lines that are no object have the field ''.

    ``file`` names what counts as one file, the file's own name as a rule.
    """
    file = F.element_at(F.split(F.input_file_name(), "/"), -1) if file is None else file
    text = spark.read.text(path).where(F.trim("value") != "").select(file.alias("file"), F.try_parse_json("value").alias("v"))
    fields = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.map_entries(F.try_variant_get("v", "$", "map<string, variant>")))
    each = text.select("file", F.explode(F.coalesce(fields, F.array(F.struct(F.lit("").alias("key"), F.lit(None).cast("variant").alias("value"))))).alias("e"))
    kinds = each.select("file", F.col("e.key").alias("field"), F.when(F.col("e.key") == "", "BROKEN").otherwise(F.coalesce(_field_kind(F.col("e.value")), F.lit("VOID"))).alias("kind"))
    lines = text.groupBy("file").agg(F.count("*").alias("lines"))
    return kinds.groupBy("file", "field", "kind").agg(F.count("*").alias("n")).join(lines, "file")


def drift(counts: DataFrame) -> DataFrame:
    """How each field differs over the files: ``field kinds files lines missing verdict``.

    ``kinds`` are its types apart from null, in order; ``missing`` the lines of all files without it. The verdict is 'conflict' for several types that no number type holds, 'widened' for
    whole and other numbers, 'optional' for a field that lines lack or have as null, else 'stable'.
    """
    total = counts.select("file", "lines").distinct().agg(F.sum("lines").alias("_total")).withColumn("one", F.lit(1))
    whole = counts.where("field <> ''").groupBy("field").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "VOID", F.col("kind")))).alias("kinds"), F.count_distinct("file").alias("files"), F.sum("n").alias("lines"), F.sum(F.when(F.col("kind") == "VOID", F.col("n")).otherwise(0)).alias("nulls"))
    whole = whole.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").withColumn("missing", F.col("_total") - F.col("lines"))
    numbers = F.size(F.array_except("kinds", F.array(F.lit("BIGINT"), F.lit("DOUBLE")))) == 0
    verdict = F.when((F.size("kinds") > 1) & ~numbers, "conflict").when(F.size("kinds") > 1, "widened").when((F.col("missing") > 0) | (F.col("nulls") > 0), "optional").otherwise("stable")
    return whole.select("field", F.array_join("kinds", "|").alias("kinds"), "files", "lines", "missing", verdict.alias("verdict"))
