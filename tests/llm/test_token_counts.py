"""The three allocation rules on random texts, with the tokens of the tiktoken library and characters counted one by one."""

import base64
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

from tidemark.llm import token_counts

PATH = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["word", " the", "é", "ß", "日本", "🙂", "👩‍👩‍👧", " ", "  ", "\n", "\n\n", "\n\n\n\n", "\t", "\r\n", "12345", "...", "'s", " ", "à́", "x" * 40, "}\n{", " \n "]


#: Tokens across line breaks, which the public vocabulary does not have.
MERGES = [b"\n\n", b"\n\n\n\n", b"e\n", b"\nw", b"e\n\n", b"rd", b"rd\n", b"}\n", b"}\n{", b" \n", b"\n ", "\n🙂".encode()[:3], b"\nx"]


@pytest.fixture(scope="module", params=["public", "crossing"])
def encoding(request, tmp_path_factory):
    """(vocabulary file, pattern, the library's encoding)."""
    path, pattern = PATH, P.PATTERN
    if request.param == "crossing":
        path, pattern = str(tmp_path_factory.mktemp("v") / "own.tiktoken"), r"[\s\S]{1,9}"
        with open(path, "wb") as out:
            for rank, token in enumerate([*(bytes([b]) for b in range(256)), *MERGES]):
                out.write(base64.b64encode(token) + b" " + str(rank).encode() + b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def plain(encoding, text, rule):
    """(n_tokens, n_crossing) of each line, character by character."""
    lines = text.split("\n")
    section = [i for i, line in enumerate(lines) for _ in range(len(line) + (i < len(lines) - 1))]
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    tokens, crossing, at = Counter(), Counter(), 0
    ids = encoding.encode_ordinary(text)
    for n in map(len, encoding.decode_tokens_bytes(ids)):
        chars = sorted(set(char_of[at : at + n]))
        at += n
        touched = [section[c] for c in chars]
        counts = Counter(touched)
        owner = touched[0] if rule == "start" else touched[-1] if rule == "end" else min(counts, key=lambda s: (-counts[s], s))
        tokens[owner] += 1
        crossing[owner] += len(counts) > 1
    return [(tokens[i], crossing[i]) for i in range(len(lines))], len(ids)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_rules_on_random_texts(spark, encoding, rule):
    rng = random.Random(rule)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["\n", "\n" * 30, "a\n\n\n\n\nb", "🙂\n🙂\n", "end\n"]
    path, pattern, encoding = encoding
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, totals, crossings = {}, {}, 0
    for r in token_counts.count_tokens(docs, path, pattern, rule).collect():
        got[r.doc_id, r.section] = (r.n_tokens, r.n_crossing)
        totals[r.doc_id] = r.doc_tokens
        lines = texts[r.doc_id].split("\n")
        assert r.start == sum(len(x) + 1 for x in lines[: r.section]) and r.end == r.start + len(lines[r.section]) + (r.section < len(lines) - 1)
    for i, text in enumerate(texts):
        want, total = plain(encoding, text, rule)
        assert [got[i, s] for s in range(len(want))] == want and totals[i] == total == sum(n for n, _ in want)
        crossings += sum(c for _, c in want)
    assert crossings > 50 or path == PATH
