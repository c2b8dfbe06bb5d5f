"""Periodic runs against the definition, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic_runs, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def smallest_period(x):
    return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))


def plain_runs(x):
    found, n = [], len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and smallest_period(x[i : j + q]) == q:
                found.append((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted(found)


def collapsed(x, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(x) if i not in gone)


def row_of(doc_id, text):
    x = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(x)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = [w if i < a else x[a + (i - a) % p] for i, w in enumerate(x)]
    runs = plain_runs(x)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    long = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *long, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(collapsed(x, runs)))


def masked(x):
    codes = np.unique(np.array(x), return_inverse=True)[1].astype(np.int32) if len(x) else np.empty(0, np.int32)
    return periodic_runs.runs_of(codes, periodic_runs.surviving(codes, np.array([0, len(x)])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 9)), max_size=12), st.sampled_from([2, 3, 8, 128]))
def test_runs_equal_the_definition(parts, leaf):
    x = list("".join(a * n for a, n in parts))
    kept = periodic_runs.LEAF
    periodic_runs.LEAF = max(leaf, 8)
    try:
        assert masked(x) == plain_runs(x)
    finally:
        periodic_runs.LEAF = kept


def test_long_periods_and_many_leaves():
    rng = random.Random(1)
    x = []
    for p, times in ((1, 7), (3, 5), (97, 6), (2, 4), (411, 4), (5, 200)):
        x += [rng.choice("uvwxyz") for _ in range(50)]
        x += [rng.choice("abcde") for _ in range(p)] * times + [rng.choice("abcde") for _ in range(p // 2)]
    assert masked(x) == plain_runs(x)


def test_query_equals_the_definition(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "é", f"w{rng.randint(0, 300)}"]) for _ in range(rng.randint(0, 160)))) for i in range(400)]
    rows += [(None, None), (None, "x " * 40), (7, "x x x x x x"), (7, "x x x x x x"), (8, ""), (9, " \n\t\x0b "), (10, "a\x0bb\x0ca\rb\na\tb a b"), (11, "q\x85q " * 9), (1012, "one " * 30000), (1013, "w" * 200000)]
    schema = f"{SCHEMA}, n_words long, runs string, collapsed string, start long"
    spark.createDataFrame([(i, t, "en", None, 0, 1, "z", "z", 5) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_periodic_runs(spark, str(tmp_path))
    key = lambda r: tuple(str(x) for x in r)
    found = [tuple(r) for r in out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    small = [r for r in rows if r[0] != 1012]
    want = [row_of(*r) for r in small]
    assert sorted((r for r in found if r[0] != 1012), key=key) == sorted(want, key=key)
    (line,) = [r for r in found if r[0] == 1012]
    assert line[1:6] == (1, 0, 30000, 1, 30000000)
    assert sum(r[1] > 0 for r in want) > 20


def test_empty_table_and_real_outputs(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert periodic_runs.find_runs(docs).collect() == []
    docs = spark.createDataFrame([(1, "so a b a b a b a b a end", "en", "s", 0)], SCHEMA)
    (r,) = periodic_runs.find_runs(docs).collect()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (11, [(1, 9, 2)], "so a b end")
