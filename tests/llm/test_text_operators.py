"""The text operators against plain versions, and the odd cases that each defines."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, common, decontaminate, line_dedup, ngram_join, pii, quality_crf, quality_rules, substring_dedup, token_counts, toxicity, training

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in a is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, a long text."""
    long_text = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 5), (4, "one two three", "en", None, 13), (4, "one two three", "en", None, 13), (None, "no id here at all", None, "s", 17), (None, None, None, None, None), (5, long_text, "en", "s", len(long_text)), (4, "another text of the same id", "en", "s", 27)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark):
    """Extra columns with names that the operators use inside."""
    return odd(spark).selectExpr("*", "1 AS row_key", "2 AS k1", "3 AS n", "4 AS maybe", "5 AS node", "6 AS kept", "7 AS place", "8 AS label", "9 AS score", "10 AS _word", "11 AS words")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")


def pages(rng, spark, n=60):
    rows = []
    for i in range(1, n):
        good = i % 2
        text = prose(rng, 80) if good else " | ".join(["junk### stupid"] * 60)
        rows.append((i, text, "en", "s", len(text)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(reference):
    vocab = byte_bpe.vocabulary(PATH, P.PATTERN)

    @settings(max_examples=60, deadline=None)
    @given(st.text(max_size=300))
    def same(text):
        ids = np.frombuffer(next(vocab.encode_all([text])), "<u4")
        assert ids.tolist() == reference.encode_ordinary(text)
        assert vocab.decode(ids) == text.encode()

    same()


def test_bpe_one_tree_and_many_trees_agree(reference):
    vocab = byte_bpe.vocabulary(PATH, P.PATTERN)
    rng = random.Random(3)
    for size in (2, 3, 17, 63, 64, 65, 4000):
        piece = "".join(rng.choice("abcdeé日") for _ in range(size))
        assert vocab.merge(piece.encode()) == reference._encode_single_piece(piece.encode())
        if len(piece.encode()) <= 64:
            assert np.frombuffer(vocab.merge_many([piece.encode()], 64)[0], "<u4").tolist() == vocab.merge(piece.encode())


def test_bpe_odd_rows_and_round_trip(spark):
    for docs in (odd(spark), clashing(spark), odd(spark).limit(0)):
        out = byte_bpe.encode_documents(docs, PATH, P.PATTERN, with_ids=True)
        rows = out.collect()
        assert len(rows) == docs.count()
        assert all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
        assert {r.n_tokens for r in rows if r.n_bytes == 0} <= {0}
    back = byte_bpe.decode_ids(byte_bpe.encode_documents(odd(spark), PATH, P.PATTERN, with_ids=True), PATH, P.PATTERN)
    assert Counter(r.text for r in back.collect()) == Counter(r.text or "" for r in odd(spark).collect())


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = pii.digits_of(m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(pii.digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.ORDER[s[2]]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-%_ 0123456789()\nZé🙂:/", max_size=80))
def test_pii_base_equals_the_patterns(text):
    assert [s for s in pii.find(text) if s[2] in pii.BASE_KINDS] == base_spans(text)


def test_pii_kinds_and_masks(spark):
    text = "🙂 write to a.b@c-d.org, call +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.255 not 10.0.0.256, see https://x.org/a?b=1 iban DE89 3704 0044 0532 0130 00 account number: 12345678"
    kinds = Counter(s[2] for s in pii.find(text))
    assert kinds == Counter(email=1, phone=1, card=1, ip=1, url=1, iban=1, account=1)
    assert "<email>" in pii.mask(text, pii.find(text)) and "a.b@c" not in pii.mask(text, pii.find(text))
    for docs in (odd(spark), clashing(spark), odd(spark).limit(0)):
        rows = pii.find_pii(docs, masked=True).collect()
        assert len(rows) == docs.count()
        assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)


def test_iban_ends_before_the_next_word():
    de, no = "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"
    for iban in (de, de.replace(" ", ""), no):
        for before, after in (("", " Please pay"), ("to ", " 25 EUR"), ("", " A B C"), ("AB12 ", " X"), ("", ""), ("", "."), ("", "please"), ("", f" {de}")):
            text = before + iban + after
            spans = [s for s in pii.find(text) if s[2] == "iban"]
            assert spans[0] == (len(before), len(before + iban), "iban") and len(spans) == 1 + (de in after)
    assert pii.mask(de + " Please", [s for s in pii.find(de + " Please") if s[2] == "iban"]) == "<iban> Please"
    assert not [s for s in pii.find(de[:-1] + "1 Please") + pii.find(de + "7") if s[2] == "iban"]


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(5, 40))) for i in range(12)] + [(20, "tiny item"), (21, ""), (22, None), (None, "no id")]
    items += [(30, prose(rng, 60)), (31, prose(rng, 100)), (32, "again and " * 50), (33, prose(rng, 150))]
    rows = []
    for i in range(60):
        body = prose(rng, 120)
        if i % 3 == 0:
            item = items[i % 12][1].split()
            if i % 2:
                item = item[1:] + ["extra"]
            body = f"{prose(rng, 10)} {' '.join(item).upper()} {prose(rng, 30)}"
        if i == 7:
            body += " Tiny ITEM end"
        rows.append((i, body, "en", "s", 0))
    for i in range(12):  # shorter than the item, by one word left out or an end cut off
        own = items[i][1].split()
        rows.append((100 + i, " ".join(own[:-1]), "en", "s", 0))
        rows.append((120 + i, " ".join(own[: len(own) // 2] + own[len(own) // 2 + 1 :]), "en", "s", 0))
    for i in range(60):  # about the threshold, in long items
        own = items[16 + i % 4][1].split()
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(len(own))] = "changed"
        rows.append((200 + i, f"{prose(rng, 7)} {' '.join(own)} {prose(rng, 9)}", "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_contamination(docs, bench).collect()}
    expected = {}
    for d, body, *_ in rows:
        words = body.lower().split()
        for i, item in items:
            own = (item or "").lower().split()
            if not own or i is None:
                continue
            k = min(5, len(own))
            a = Counter(tuple(own[j : j + k]) for j in range(len(own) - k + 1))
            n = sum(a.values())
            all_ = [tuple(words[j : j + k]) for j in range(len(words) - k + 1)]
            m = min(n, len(all_))
            best = max((sum((Counter(all_[s : s + m]) & a).values()) for s in range(len(all_) - m + 1)), default=0)
            if best / (m + n - best) >= 0.8:
                expected[(d, i)] = best / (m + n - best)
    assert got.keys() == expected.keys() and (7, 20) in got
    assert all(abs(got[k] - v) < 1e-9 for k, v in expected.items())
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {r[0] for r in rows} - {k[0] for k in expected}


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, None)], "item_id long, text string")
    for docs in (odd(spark), clashing(spark)):
        rows = decontaminate.find_contamination(docs, bench).collect()
        assert [(r.doc_id, r.item_id) for r in rows] == [(4, 1)]
        left = decontaminate.drop_contaminated(docs, bench)
        assert left.columns == docs.columns and left.count() == docs.count() - 2
    assert decontaminate.find_contamination(odd(spark).limit(0), bench).count() == 0
    assert decontaminate.find_contamination(odd(spark), bench.limit(0)).count() == 0


def brute_substrings(texts, k):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        cover = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                cover[i : i + k] = [True] * k
        out.append((len(w), sum(cover), b" ".join(x for x, c in zip(w, cover) if not c).decode()))
    return out


@pytest.mark.parametrize("hot", [256, 2])
def test_substring_dedup_against_brute_force(spark, hot):
    rng = random.Random(9)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(0, 150)) for _ in range(40)]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 25)}" for _ in range(30)] + [texts[3]] * 3
    texts += [f"{passage} {prose(rng, 5)} {passage}", "a " * 90, "b\tc\n" * 40, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(docs, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substrings(texts, 35)


def test_substring_dedup_odd_rows(spark):
    for docs in (odd(spark), clashing(spark), odd(spark).limit(0)):
        rows = substring_dedup.dedup_substrings(docs).collect()
        assert len(rows) == docs.count()
        assert sorted(r.n_words for r in rows) == sorted(len((d.text or "").split()) for d in docs.collect())


def test_operators_without_bitmaps(spark, monkeypatch):
    """Where the keys are too many for a bitmap, everything goes through the shuffles and the results are the same."""
    rng = random.Random(31)
    passage = prose(rng, 50)
    texts = [prose(rng, rng.randint(0, 90)) + "\n" + prose(rng, 9) for _ in range(25)] + [f"{prose(rng, 9)} {passage} {prose(rng, 9)}\n{prose(rng, 12)}" for _ in range(12)]
    texts += [t.replace(t.split()[2], "other", 1) for t in texts[-12:]] + [texts[3], None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    runs = (lambda: substring_dedup.dedup_substrings(docs, hot=4), lambda: line_dedup.dedup_lines(docs), lambda: ngram_join.similar_classes(docs).select("doc_id", "n_shingles", "component_id"))
    before = [sorted(map(str, run().collect())) for run in runs]
    for module in (substring_dedup, line_dedup, ngram_join, common):
        monkeypatch.setattr(module, "key_bitmap", lambda keys, key: None)
    assert [sorted(map(str, run().collect())) for run in runs] == before


def test_key_bitmap_knows_its_keys(spark):
    keys = spark.range(0, 40000).selectExpr("xxhash64(id) AS k")
    asked = common.with_bitmap(spark.range(0, 80000).selectExpr("id", "xxhash64(id) AS k"), "k", common.key_bitmap(keys, "k"))
    counts = {r.known: (r.n, r.yes) for r in asked.selectExpr("id < 40000 AS known", "maybe").groupBy("known").agg(F.count("*").alias("n"), F.count_if("maybe").alias("yes")).collect()}
    assert counts[True] == (40000, 40000) and counts[False][1] < 40000 / 10
    assert common.key_bitmap(keys, "k", 1 << 16) is None
    assert not common.with_bitmap(keys.limit(5), "k", common.key_bitmap(keys.limit(0), "k")).where("maybe").collect()


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                top[q] = p
    return [(len(sets[i]), rows[find(i)][0]) for i in range(len(rows))]


def test_similar_classes_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(1, 200))) for i in range(60)]
    base = prose(rng, 150).split()
    for i in range(60, 200):  # a large group around the threshold, with chains
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    chain = prose(rng, 300).split()
    for i in range(200, 230):
        chain = chain[2:] + [f"c{i}", f"d{i}"]
        rows.append((i, " ".join(chain)))
    rows += [(230, "just two"), (231, "Just TWO"), (232, "just  two\n"), (233, ""), (234, "solo")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_classes(docs).collect()}
    assert [got[i] for i, _ in rows] == brute_classes(rows)


@pytest.mark.parametrize("worth", [0, 1 << 40])
def test_similar_classes_of_large_blocks(spark, monkeypatch, worth):
    """Chunks against chunks, with or without further rounds of stars."""
    monkeypatch.setattr(ngram_join, "WORTH", worth)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "STAR", 3)
    rng = random.Random(12)
    base = prose(rng, 120).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(len(w))] = f"y{rng.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_classes(docs).collect()}
    assert [got[i] for i, _ in rows] == brute_classes(rows)


def test_similar_classes_away_from_the_first_pivot(spark, monkeypatch):
    """A large group about one text that is not there: most pairs are below the threshold, so no pivot links many."""
    monkeypatch.setattr(ngram_join, "CHUNK", 32)
    rng = random.Random(21)
    base = prose(rng, 200).split()
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(3, 5)):
            w[rng.randrange(len(w))] = f"u{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_classes(docs).collect()}
    expected = brute_classes(rows)
    assert [got[i] for i, _ in rows] == expected
    assert 1 < len({c for _, c in expected}) < 260


def test_one_of_each_does_not_depend_on_the_order(spark):
    text = "the same words in every one of these rows"
    rows = [(7, text, "en", s, 1) for s in ("c", "a", "b")] + [(7, text, None, "z", 1), (8, text, "en", "a", 1)]
    for order in (rows, rows[::-1]):
        one = ngram_join.one_of_each(spark.createDataFrame(order, SCHEMA).repartition(3)).collect()
        assert [(r.doc_id, r.lang, r.source) for r in one] == [(7, None, "z")]


def test_every_candidate_is_in_a_star(spark):
    """Node 1 is its own pivot, and nodes 2 and 3 prefer better connected ones."""
    blocks = [(1, 2)] * 2 + [(1, 3)] * 2 + [(2, 4), (3, 5)] + [(4, 6)] * 4 + [(5, 7)] * 4
    live = [(k, x, False) for k, b in enumerate(blocks) for x in b] + [(a, b, True) for a, b in blocks]
    keyed = spark.createDataFrame([(i, f"some words of text number {i}") for i in range(1, 8)], "row_key long, text string")
    stars = ngram_join._star_links(keyed, keyed.selectExpr("row_key AS node", "row_key"), spark.createDataFrame(live, "a long, b long, edge boolean"), 4, ngram_join.Bands(85))
    assert {r.node for r in stars.collect()} == set(range(1, 8))


def test_similar_classes_of_chains(spark):
    """Sparse chains, in which each text is linked with the next ones only."""
    rng = random.Random(13)
    rows = []
    for c in range(120):
        w = [f"{x}{c}" for x in prose(rng, rng.randint(40, 120)).split()]
        for _ in range(rng.randint(3, 9)):
            rows.append((len(rows), " ".join(w)))
            n = len(w) // 25 + rng.randint(0, 2)
            w = w[n:] + [f"n{rng.randint(0, 10**9)}" for _ in range(n)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_classes(docs).collect()}
    assert [got[i] for i, _ in rows] == brute_classes(rows)


def test_similar_classes_odd_rows(spark):
    for docs in (odd(spark), clashing(spark)):
        rows = ngram_join.similar_classes(docs).collect()
        assert len(rows) == docs.count()
        assert {(r.doc_id, r.component_id) for r in rows if r.n_shingles == 0} == {(1, 1), (2, 2), (3, 3), (None, None)}
        one = ngram_join.one_of_each(docs)
        assert one.columns == docs.columns
        assert sorted(str(r.text) for r in one.where("text like 'one%'").collect()) == ["one two three"]
    assert ngram_join.similar_classes(odd(spark).limit(0)).count() == 0


def one_word_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(13)
    pool = [prose(rng, rng.randint(1, 14)) for _ in range(30)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 7)):
            w = rng.choice(pool).split(" ")
            if rng.random() < 0.4:
                j = rng.randrange(len(w))
                w[j : j + 1] = rng.choice([[], [w[j], "new"], ["other"], [f"z{rng.randint(0, 3)}"]])
            lines.append(" ".join(w))
        rows.append((i, "\n".join([*lines, "", "  \t"] if i % 5 == 0 else lines)))
    seen, expected = [], {}
    for i, text in rows:
        keep = []
        for line in text.split("\n"):
            w = line.strip(" \t")
            if not w:
                keep.append(line)
                continue
            w = w.split(" ")
            if not any(w == o or (min(len(w), len(o)) >= 5 and one_word_apart(w, o)) for o in seen):
                keep.append(line)
            seen.append(w)
        expected[i] = "\n".join(keep)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == expected


def test_line_dedup_odd_rows(spark):
    for docs in (odd(spark), clashing(spark), odd(spark).limit(0)):
        rows = line_dedup.dedup_lines(docs, carry=["source"]).collect()
        assert len(rows) == docs.count()
        assert all(r.n_removed == 0 for r in rows)


def test_token_counts(spark):
    vocab = byte_bpe.vocabulary(PATH, P.PATTERN)
    for rule in token_counts.RULES:
        rows = token_counts.count_tokens(odd(spark), PATH, P.PATTERN, rule).collect()
        per = Counter()
        for r in rows:
            per[(r.doc_id, r.doc_tokens)] += r.n_tokens
        assert all(n % max(total, 1) == 0 for (_, total), n in per.items())
    text = "héllo wörld\n\n\nnext 🙂 line\nend"
    ids = np.frombuffer(next(vocab.encode_all([text])), "<u4").tolist()
    at, spans = 0, []
    for i in ids:
        piece = vocab.tokens[i]
        spans.append((len(text.encode()[:at].decode("utf-8", "ignore")), at))
        at += len(piece)
    docs = spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)
    rows = sorted(token_counts.count_tokens(docs, PATH, P.PATTERN).collect(), key=lambda r: r.section)
    assert [r.start for r in rows] == [0, 12, 13, 14, 26] and rows[-1].end == len(text)
    expected = Counter(max(r.section for r in rows if r.start <= s) for s, _ in spans)
    assert {r.section: r.n_tokens for r in rows if r.n_tokens} == dict(expected)
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, PATH, P.PATTERN, "middle")
    assert token_counts.count_tokens(clashing(spark), PATH, P.PATTERN).count() >= clashing(spark).count()
    first, last = np.array([0, 4, 6]), np.array([3, 9, 6])
    owner, crosses = token_counts.allocate(first, last, np.array([0, 5, 7]), "majority")
    assert owner.tolist() == [0, 2, 1] and crosses.tolist() == [False, True, False]


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c, cover, seen, dup = Counter(tri), set(), set(), 0
    for i, t in enumerate(tri):
        if c[t] > 1:
            cover |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_rules(spark):
    rng = random.Random(17)
    docs = pages(rng, spark).union(odd(spark)).union(spark.createDataFrame([(90, "a b c a b c d\nx\nx\n \n \ny# <z>", "en", "s", 0)], SCHEMA))
    model = quality_rules.train(docs, labels(spark))
    rows = quality_rules.score_quality(docs, model, carry=["text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(r.carried_text or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    good = [r.kept for r in rows if r.doc_id and r.doc_id < 60 and r.doc_id % 2 and r.n_words == 80]
    assert len(good) >= 28 and all(good)
    assert quality_rules.score_quality(clashing(spark), model).count() == 9
    unlabelled = quality_rules.train(docs, labels(spark).limit(0))
    assert quality_rules.score_quality(docs.limit(0), unlabelled).count() == 0


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality_crf, "quality")])
def test_classifiers(spark, module, label, monkeypatch):
    rng = random.Random(19)
    monkeypatch.setattr(toxicity, "L1", 0.1)
    docs = pages(rng, spark)
    score = module.score_toxicity if module is toxicity else module.score_lines
    model = module.train(docs, labels(spark))
    truth = {r.doc_id: r[label] for r in labels(spark).collect()}
    rows = score(docs, model).collect()
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 3 and min(s for s, y in held if y) > max(s for s, y in held if not y)
    for frame in (odd(spark), clashing(spark), odd(spark).limit(0)):
        out = score(frame, model).collect()
        assert len(out) == frame.count() and all(0 <= r.score <= 1 for r in out)
        assert all(not r.held_out for r in out if r.doc_id is None)
    empty = module.train(docs, labels(spark).limit(0))
    assert all(0 <= r.score <= 1 for r in score(odd(spark), empty).collect())


def test_toxicity_weights_against_plain_ftrl(monkeypatch):
    """Coordinate by coordinate, with dictionaries and no arrays."""
    monkeypatch.setattr(toxicity, "L1", 0.3)
    rng = random.Random(23)
    texts = [prose(rng, rng.randint(0, 12)) + (" vile" * rng.randint(1, 2) if i % 2 else "") for i in range(30)]
    y = np.array([i % 2 for i in range(30)], dtype=float)
    got = toxicity.fit(texts, y, epochs=2)
    rows = [[*x.tolist(), toxicity.BIAS] for x in toxicity.featurise(pa.array(texts))]
    z, n = Counter(), Counter()

    def weight(c):
        limit = 0 if c == toxicity.BIAS else 0.3
        return 0.0 if abs(z[c]) <= limit else -(z[c] - math.copysign(limit, z[c])) / ((toxicity.BETA + math.sqrt(n[c])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(11)
    for _ in range(2):
        for i in order.permutation(30).tolist():
            w = {c: weight(c) for c in rows[i]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[i]
            for c in rows[i]:
                step = (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / toxicity.ALPHA
                z[c] += g - step * w[c]
                n[c] += g * g
    expected = {c: weight(c) for c in z if weight(c)}
    assert got["ids"].tolist() == sorted(expected)
    assert np.allclose(got["weights"], [expected[c] for c in got["ids"].tolist()], atol=1e-6)


def test_toxicity_features_are_the_ngrams_and_skipgrams():
    (x,) = toxicity.featurise(pa.array(['One, "two" THREE four']))
    (same,) = toxicity.featurise(pa.array(["one two three four"]))
    assert x.tolist() == same.tolist() and len(x) == 4 + 3 + 2


def test_quality_ngrams_are_of_code_points():
    text = "añb añb 日本語"
    *_, families = next(quality_rules.featurise(pa.array([text])))
    for x, width in zip(families[3:], (3, 4)):
        own = [text[i : i + width] for i in range(len(text) - width + 1)]
        assert len(x) == len(own) and len(set(x.tolist())) == len(set(own))
        assert all((x[i] == x[j]) == (own[i] == own[j]) for i in range(len(own)) for j in range(i))


def test_quality_counts_with_many_distinct_words(monkeypatch):
    codes = np.array([5, 6, 7, 5, 6, 7, 8, 9, 1, 2, 9, 1, 2])
    expected = quality_rules.base_counts("", codes)
    monkeypatch.setattr(quality_rules, "MOST_CODES", 0)
    assert quality_rules.base_counts("", codes) == expected and expected[1] == 12


def test_quality_model_learns_and_calibrates():
    rng = random.Random(29)
    texts = [prose(rng, 60) if i % 2 else "### buy | now ### " * 20 for i in range(100)]
    y = np.array([float(i % 2) for i in range(100)])
    model = quality_rules.fit(texts, y)
    slope, shift = model["curve"]
    score = [1 / (1 + math.exp(-(slope * quality_rules.margin(model["weights"], f) + shift))) for *_, f in quality_rules.featurise(pa.array(texts))]
    assert min(s for s, t in zip(score, y) if t) > 0.8 and max(s for s, t in zip(score, y) if not t) < 0.2


def test_document_scores_weigh_lines_by_length():
    got = quality_crf.document_scores(np.array([0.2, 0.8, 0.5]), np.array([10.0, 30.0, 7.0]), np.array([0, 0, 2]), 3, 0.4)
    assert np.allclose(got, [(2 + 24) / 40, 0.4, 0.5])


def test_training_sample_has_one_text_an_id(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}", "en", "s", 0) for i in range(70)] + [(8, "x" * 5000, "en", "s", 0)], SCHEMA)
    given = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    rows = training.training_rows(docs, given, "quality", 100).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert all(r.text == min(f"text {i}" for i in range(70) if i % 7 == r.doc_id) for r in rows if r.doc_id < 7)
    seen = training.fit_in_task(training.training_rows(docs, given, "quality", 100), lambda t, y: {"bytes": np.array(sum(map(len, t)))}, max_bytes=1000)
    assert 0 < int(seen["bytes"]) <= 1000


def test_field_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    score, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    rows = np.array([0, 0, 0, 1, 1])
    marginal, pair = quality_crf.forward_backward(score, trans, rows)
    for own in (range(0, 3), range(3, 5)):
        own = list(own)
        total, up, joint = 0.0, np.zeros(len(own)), np.zeros((len(own), 2, 2))
        for code in range(2 ** len(own)):
            y = [(code >> k) & 1 for k in range(len(own))]
            w = np.exp(sum(score[i] * y[k] for k, i in enumerate(own)) + sum(trans[y[k], y[k + 1]] for k in range(len(own) - 1)))
            total += w
            up += w * np.array(y)
            for k in range(len(own) - 1):
                joint[k, y[k], y[k + 1]] += w
        assert np.allclose(marginal[own], up / total)
        assert np.allclose(pair[own], joint / total)
