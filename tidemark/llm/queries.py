"""Queries over the test tables for the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, filter_audit, line_dedup, minhash_dedup, ngram_join, periodic_runs, pii, quality_crf, quality_rules, substring_dedup, token_counts, toxicity
from .audit_sql import OP12_SQL
from .common import documents, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """Path of the vocabulary file and the split pattern."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(documents(spark, sf_dir), *tokenizer())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "start", F.round("similarity", 9).alias("similarity"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH l AS (
    SELECT doc_id, i, trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS t, x
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), d AS (
    SELECT t, min((doc_id, i)) AS place, string_split(t, ' ') AS w FROM l WHERE t <> '' GROUP BY t
), v AS (
    SELECT place, len(w) - 1 AS size, k AS gap, array_to_string(list_concat(w[1:k - 1], w[k + 1:]), ' ') AS key
    FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM d WHERE len(w) >= 5)
    UNION ALL SELECT place, len(w), -1, t FROM d WHERE len(w) >= 5
), near AS (
    SELECT v.place FROM v JOIN (SELECT key, size, gap, min(place) AS e FROM v WHERE gap > 0 GROUP BY ALL) a USING (key, size, gap) WHERE a.e < v.place
    UNION
    SELECT v.place FROM v JOIN (SELECT key, size, min(place) FILTER (gap < 0) AS f, min(place) FILTER (gap > 0) AS c FROM v GROUP BY ALL) b USING (key, size)
    WHERE CASE WHEN gap < 0 THEN c ELSE f END < v.place
), kept AS (SELECT place FROM d WHERE place NOT IN (SELECT place FROM near))
SELECT l.doc_id, count(*) AS n_lines, count(*) - count(*) FILTER (t = '' OR kept.place IS NOT NULL) AS n_removed,
    sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (t = '' OR kept.place IS NOT NULL), '')) AS kept_sha256
FROM l LEFT JOIN kept ON kept.place = (l.doc_id, l.i) GROUP BY l.doc_id
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), *tokenizer())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.score_quality(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_crf.score_lines(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words that op13 reads: in a tenth of the documents the words from some place on repeat with a period. Ids and lengths decide; a null id changes nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(documents(spark, sf_dir), repeated_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.select("doc_id", "runs", "collapsed", longest.alias("m"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("m.back")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.short")).alias("period"),
        F.expr("1000 * m.length div -m.short").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_byte_bpe, op2_pii, op3_decontamination, op4_substring_dedup, op5_ngram_join, op6_line_dedup, op7_token_counts, op8_quality_rules, op9_toxicity, op10_quality_classifier, op11_minhash_dedup, op12_filter_audit, op13_periodic_runs]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op12_filter_audit": OP12_SQL}
