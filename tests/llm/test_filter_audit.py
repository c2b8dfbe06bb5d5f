"""The filter audit against its definition applied order by order, and odd rows."""

import random
import re
from itertools import permutations

import pytest

from tidemark.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, labels):
    """Every order applied filter by filter to the list of documents."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    documents = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [i for i, other, _ in rows if (other or "") == text and i is not None]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": bool(same) if doc_id is None else any(i < doc_id for i in same),
        }
        documents.append((source or "", doc_id, fails))
    out, share = {}, {}
    for part in {d[0] for d in documents}:
        own = [d for d in documents if d[0] == part]
        for order in permutations("ABCDE"):
            here, gone = own, []
            for step, letter in enumerate(order, 1):
                lost = [d for d in here if d[2][letter]]
                here = [d for d in here if not d[2][letter]]
                share[part, letter] = share.get((part, letter), 0) + len(lost)
                out[part, "".join(order), step] = (
                    len(here), len(lost), sum(d[2][letter] for d in gone), sum(d[2][letter] and sum(d[2].values()) == 1 for d in own),
                    sum(d[1] in good for d in lost), sum(d[1] in toxic for d in lost),
                )
                gone = gone + lost
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit_filters(docs, marks).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}


def test_against_every_order(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "BETA", "gamma", "d#", "é", f"w{rng.randint(0, 999)}"]) for _ in range(n)) for n in (5, 199, 200, 201, 260, 400)]
    texts += [" ".join(f"w{i}" for i in range(230)), None, "", " \n\t ", "a" * 98 + "BC", "a" * 97 + "BCD", "x\x0by\x0cz\x85q\xa0r", "one " * 250, "AAA|" * 60]
    rows = [(rng.randint(0, 60), rng.choice(texts), rng.choice(["s", "t", None])) for _ in range(150)] + [(None, texts[0], "s"), (None, "alone of no id", "s"), (None, "alone of no id", "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1)]
    assert audited(spark, rows, labels) == plain(rows, labels)


def test_empty_tables_and_clashing_columns(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    rows = [(1, "a b", "s"), (2, "a b", "s")]
    assert audited(spark, rows, []) == plain(rows, [])
    names = ["part", "mask", "digest", "first", "good", "bad", "n", "step", "own", "words"]
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)], SCHEMA).selectExpr("*", *(f"'x' AS {c}" for c in names))
    marks = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "7 AS good", "8 AS part")
    out = filter_audit.audit_filters(docs, marks)
    assert out.count() == 600
    assert out.where("filter_order = 'EABCD' AND step = 1").first().good_lost == 1


@pytest.mark.parametrize("words, fails", [(199, True), (200, False)])
def test_long_and_limit(spark, words, fails):
    text = " ".join(f"w{i}" for i in range(words))
    rows = [(1, text, "s"), (2, " ".join(f"v{i}" for i in range(60000)), "s")]
    assert audited(spark, rows, [])["s", "ABCDE", 1][1] == fails
