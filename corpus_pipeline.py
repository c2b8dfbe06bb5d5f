"""A training-corpus pipeline in five stages. Each stage reads what the one before has written.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``documents``, others are dropped; the last returns the encoded corpus. An empty ``documents`` gives no rows, an empty ``labels`` or ``benchmark`` is taken as no
knowledge. Null texts count as empty; null, repeated and equal ids stay apart by their texts, as each stage says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.folders import shared_folder
from tidemark.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality_rules
from tidemark.llm.common import table
from tidemark.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the model keep; the model learns from the labels of ``sf_dir``.

    Texts of fewer than fifty words (null and empty ones, too) go. Repeated rows are judged one by one, alike. Without labels of both kinds the model says the same of all, and the base rules alone decide.
    """
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_rules.score_quality(docs, model, carry=COLUMNS)
    return scored.where("kept").select(*(F.col(f"carried_{c}").alias(c) for c in COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated and near-repeated lines; one that has no words left goes.

    Of equal lines that of the smallest id stays (null ids last). Rows equal in id and text are one document: they keep the same lines. ``n_chars`` is counted anew.
    """
    cleaned = line_dedup.dedup_lines(docs, carry=["lang", "source"])
    return cleaned.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select("doc_id", "text", "lang", "source", F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id (nulls last); of rows equal in id and text the one whose other columns come first in order. Texts without words stay."""
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items. Items without an id or words match nothing; repeated rows stay or go together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their count and hashes; none of a null or empty text."""
    return byte_bpe.encode_documents(docs, *tokenizer(), with_ids=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", decontaminated), ("byte_bpe", encoded)]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is written as Parquet beside the checkpoints and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
