"""HyperMinHash registers and the classes that they lead to, against exact similarities."""

import random

import numpy as np
import pytest

from tidemark.llm import minhash_dedup, ngram_join
from tidemark.llm.common import mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def plain(rows, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                top[q] = p
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0], rows[find(i)][0] == rows[i][0]) for i in range(len(rows))}


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}


def test_register_is_the_leading_zeros_and_the_next_bits():
    for value, zeros, rest in ((1 << 63, 0, 0), ((1 << 63) | (1 << 62), 0, 512), ((1 << 40) | (3 << 30), 23, 3), ((1 << 12) - 1, 52, 0), (1 << 5, 63, 0), ((1 << 64) - 1, 0, 1023)):
        (r,) = minhash_dedup.registers(np.array([value], np.uint64), np.array([1], np.uint64))
        assert (r >> 10, r & 1023) == (zeros, rest)
    a = mix(np.arange(1, 2000, dtype=np.uint64))
    assert (minhash_dedup.registers(a, minhash_dedup.permutations(128)) == minhash_dedup.registers(a[::-1], minhash_dedup.permutations(128))).all()


def test_estimate_is_near_the_similarity_and_collisions_are_taken_off():
    rng = np.random.default_rng(4)
    model = minhash_dedup.Registers(80)
    for n, share in ((5, 0.8), (40, 0.5), (300, 0.8), (3000, 0.9), (3000, 0.0)):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, round(n * share), dtype=np.uint64)
            own = [rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64) for _ in range(2)]
            a, b = (mix(np.append(both, x)) for x in own)
            true = len(both) / (2 * n - len(both))
            errors.append(float(model.estimate(n, n, model.differ(model.sketch(a), model.sketch(b)))) - true)
        assert abs(np.mean(errors)) < 0.02
    equal = np.mean([minhash_dedup.registers(mix(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)), model.multipliers[:1]) == minhash_dedup.registers(mix(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)), model.multipliers[:1]) for _ in range(20000)])
    assert equal < 5 * model.chance[9, 9] + 1e-3


@pytest.mark.parametrize("n", [4, 5, 9, 60, 700])
def test_pairs_at_the_threshold_share_a_band_and_pass_the_estimate(n):
    rng = np.random.default_rng(n)
    model = minhash_dedup.Registers(80)
    common = -(-8 * n // 9) if n > 5 else n - 1 if n == 5 else n
    for _ in range(3000 if n < 100 else 500):
        both = mix(rng.integers(0, 1 << 63, common, dtype=np.uint64))
        a = np.append(both, mix(rng.integers(0, 1 << 63, n - common, dtype=np.uint64)))
        b = both if n == 5 else np.append(both, mix(rng.integers(0, 1 << 63, n - common, dtype=np.uint64)))
        assert np.intersect1d(model.signatures(a), model.signatures(b)).size
        assert model.differ(model.sketch(a), model.sketch(b)) <= model.limit(len(a), len(b))


@pytest.mark.parametrize("chunk", [1024, 8])
def test_classes_against_every_pair(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(i, " ".join(words(rng, rng.randint(0, 60)))) for i in range(40)]
    for base, edits in ((150, 6), (12, 1), (7, 1), (400, 20), (90, 4)):
        text = words(rng, base)
        for _ in range(40):
            w = list(text)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 30)}"
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    chain = words(rng, 200)
    for _ in range(25):
        chain = chain[rng.randint(1, 14) :] + words(rng, rng.randint(1, 14))
        rows.append((len(rows), " ".join(chain)))
    shared = words(rng, 60)
    rows += [(len(rows) + i, " ".join(shared + words(rng, 40))) for i in range(120)]  # a passage of many, none of them alike enough
    rows += [(9000 + i, t) for i, t in enumerate(["just two", "Just TWO", " just  two\n", "", None, "solo", "a b c d e", "a b c d e f", "b c d e"])]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    text = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (4, "one two three"), (4, "another text"), (None, "one two three"), (None, "no id here at all"), (5, text), (6, text + " end"), (7, "w" * 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS key", "3 AS n", "4 AS kept", "5 AS row_key", "6 AS component_id", "7 AS sketch")
    out = sorted(minhash_dedup.near_duplicates(docs).collect(), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out), key=str) == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (4, 1, 4, True), (None, 1, 4, False), (None, 2, None, True),
        (5, 977, 5, True), (6, 978, 5, False), (7, 1, 7, True),
    ], key=str)
    assert minhash_dedup.near_duplicates(docs.limit(0)).collect() == []
