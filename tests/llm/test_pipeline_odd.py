"""The pipeline's stages on odd rows: nulls everywhere, repeats, ties, very long texts, clashing columns, empty tables."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def prose(rng, n):
    return " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))


def odd_rows():
    rng = random.Random(1)
    text = "\n".join(prose(rng, 12) for _ in range(12))
    long_text = prose(rng, 25000)
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text, None, "a", 2), (2, text, "en", None, None), (3, None, None, None, None), (None, None, None, None, None), (4, "", "en", "s", 0), (5, " \n\t", "en", "s", 3)]
    rows += [(6, long_text, "en", "s", 9), (7, "x" * 50000, "en", "s", 9), (None, "\n".join(prose(rng, 15) for _ in range(8)), None, "s", 9), (8, "few words", "en", "s", 9)]
    return rows + [(10 + i, "\n".join(prose(rng, 15) for _ in range(6)), "en", "s", 9) for i in range(12)]


@pytest.fixture(scope="module", params=["filled", "empty"])
def folder(request, spark, tmp_path_factory):
    """Tables beside the documents: with rows of their own, or without any."""
    path = tmp_path_factory.mktemp(request.param)
    rng = random.Random(2)
    filled = request.param == "filled"
    labels = [(i, int(i % 3 > 0), 0) for i in range(10, 22)] + [(None, 1, 1), (10, None, None)]
    bench = [(1, prose(rng, 40)), (2, odd_rows()[-1][1].replace("\n", " ")), (3, None), (4, ""), (None, "no id")]
    spark.createDataFrame(labels if filled else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench if filled else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def stage(spark, name, folder, rows, extra=()):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", *extra)
    return STAGES[name](spark, docs, folder)


CLASHES = ("1 AS row_key", "'x' AS kept", "2 AS score", "3 AS maybe", "4 AS words", "5 AS n", "6 AS carried_text")


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_takes_odd_rows(spark, folder, name):
    rows = odd_rows()
    out = stage(spark, name, folder, rows).collect()
    again = stage(spark, name, folder, rows[::-1]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    if name == "byte_bpe":
        assert len(out) == len(rows) and all(r.lossless for r in out) and sum(r.n_tokens == 0 for r in out) == 3
        return
    assert set(out[0].__fields__) == set(corpus_pipeline.COLUMNS) if out else True
    ids = [r.doc_id for r in out]
    if name == "quality_rules":  # texts of fewer than fifty words go, and nothing else changes
        assert not {3, 4, 5, 7, 8} & set(ids) and {str(r) for r in out} <= {str(r) for r in spark.createDataFrame(rows, SCHEMA).collect()}
    elif name == "line_dedup":  # one of the copies keeps its lines; rows equal in id and text are one document
        assert 2 not in ids and ids.count(1) == 3 and not {3, 4, 5} & set(ids) and 6 in ids and all(r.n_chars == len(r.text) for r in out)
    elif name == "ngram_join":  # one of the copies stays, and every text without words
        assert ids.count(1) == 1 and 2 not in ids and {3, 4, 5, 6, 7, 8} <= set(ids) and ids.count(None) == 2
    else:
        gone = {21} if folder.find("filled") >= 0 else set()
        assert set(ids) == {r[0] for r in rows} - gone and len(ids) == len(rows) - len(gone)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_with_clashing_columns_and_without_rows(spark, folder, name):
    rows = odd_rows()
    plain = stage(spark, name, folder, rows)
    out = stage(spark, name, folder, rows, CLASHES)
    columns = plain.columns if name == "byte_bpe" else corpus_pipeline.COLUMNS
    assert sorted(map(str, out.select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect()))
    assert stage(spark, name, folder, []).count() == 0
