"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, address schemes, digits, plus signs and words
that announce an account. A deterministic local parser expands each anchor to the left and right and
validates what it has found. Only the neighbourhood of an anchor is looked at again, so clean prose
costs one pass.

Kinds ``email ip card phone`` are the base; the method adds ``url`` (scheme anchors), ``iban`` (two capital
letters, check digits modulo 97) and ``account`` (a number that follows an identifier cue).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

# Kinds in the order of the contract, then the method's own.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
ORDER = {kind: i for i, kind in enumerate(KINDS)}
# Address schemes and identifier cues.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account number", "account no", "account:", "acct", "iban", "passport", "ssn", "customer id", "card number", "kontonummer", "cuenta", "compte")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"']*)?")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
# Characters of an account number by country.
IBAN_SIZES = {
    x[:2]: int(x[2:])
    for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()
}
NUMBER = re.compile(r"[\s:#.=-]{0,4}(?:no\.?|number|nr\.?)?[\s:#=]{0,3}([0-9][0-9-]{4,20}[0-9])")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """The automaton. A value is (what the anchor announces, its length)."""
    found = ahocorasick.Automaton()
    for word in ("@", "+", *"0123456789"):
        found.add_word(word, (word if word in "@+" else "digit", 1))
    for word in SCHEMES:
        found.add_word(word, ("scheme", len(word)))
    for word in CUES:
        for form in {word, word.upper(), word.capitalize(), word.title()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int:
    """The end of a valid account that begins at ``start``, where the pattern's match ends at ``end``; 0 if there is none.

    The pattern also takes capitals and digits that follow the account. The country's length comes first, then the whole match;
    in a country without a known length, then what ends at a word's end, the longest first.
    """
    places = [i for i in range(start, end) if text[i] != " "]
    chars = "".join(text[i] for i in places)
    known = IBAN_SIZES.get(chars[:2])
    shorter = [known] if known else range(len(chars) - 1, 14, -1)
    words = [n for n in shorter if n <= len(chars) and not text[places[n - 1] + 1 : places[n - 1] + 2].isalnum()]
    for n in [*words, len(chars)] if known else [len(chars), *words]:
        if mod97(chars[:n]):
            return places[n - 1] + 1
    return 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start, then kind. Matches of one kind do not overlap."""
    spans: list[tuple[int, int, str]] = []
    # end of the last match of the base pattern, valid or not: the next one starts there at the earliest
    email_from = ip_from = card_from = phone_from = url_from = iban_from = account_from = 0
    for last, (what, size) in anchors().iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= ip_from:
                m = IP.match(text, at)
                if m:
                    ip_from = m.end()
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                        spans.append((at, m.end(), "ip"))
                else:
                    # the pattern cannot start later inside this run of digits either, unless the run ends in it
                    ip_from = digit_run_end(text, at)
            if at >= card_from:
                m = CARD.match(text, at)
                if m:
                    card_from = m.end()
                    digits = digits_of(m[0])
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append((at, m.end(), "card"))
            if at >= 2 and at >= iban_from and at + 1 < len(text) and text[at + 1].isdigit():
                m = IBAN.match(text, at - 2)
                if m and not (at > 2 and text[at - 3].isalnum()):
                    end = iban_end(text, at - 2, m.end())
                    iban_from = end or at + 2
                    if end:
                        spans.append((at - 2, end, "iban"))
        elif what == "@":
            start = at
            while start > email_from and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                m = DOMAIN.match(text, at + 1)
                if m:
                    email_from = m.end()
                    spans.append((start, m.end(), "email"))
        elif what == "+":
            if at >= phone_from:
                m = PHONE.match(text, at)
                if m:
                    phone_from = m.end()
                    if 10 <= len(digits_of(m[0])) <= 15:
                        spans.append((at, m.end(), "phone"))
        elif what == "scheme":
            if at >= url_from:
                m = URL.match(text, last + 1)
                if m:
                    url_from = m.end()
                    spans.append((at, m.end(), "url"))
        elif at >= account_from:
            m = NUMBER.match(text, last + 1)
            if m:
                account_from = m.end(1)
                spans.append((m.start(1), m.end(1), "account"))
    spans.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return spans


def digit_run_end(text: str, at: int) -> int:
    n = len(text)
    while at < n and "0" <= text[at] <= "9":
        at += 1
    return at


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_pii(docs: DataFrame, masked: bool = False) -> DataFrame:
    """Spans of personal data in every whole text (code points, end exclusive).

    One row out for each row in: ``doc_id``, counts of the base kinds, ``base_sha256``, ``spans``, counts of
    the added kinds; with ``masked`` also the text with each span replaced by ``<kind>``. A null text counts as
    empty. Null and repeated ids stay; other columns are not read. No shuffle.
    """
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[4:])] + ["masked"] * masked
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS[4:]) + ", masked string" * masked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            hashes, every, clean = [], [], []
            for text in texts(batch).to_pylist():
                spans = find(text)
                kinds = [s[2] for s in spans]
                for k in KINDS:
                    counts[k].append(kinds.count(k))
                hashes.append(hashlib.sha256(written([s for s in spans if s[2] in BASE_KINDS]).encode()).hexdigest())
                every.append(written(spans))
                if masked:
                    clean.append(mask(text, spans))
            columns = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(hashes, pa.string()), pa.array(every, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS[4:])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(clean, pa.string())] * masked, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans replaced from left to right; a span that starts inside an earlier one is part of it."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
        else:
            at = max(at, end)
    return "".join([*out, text[at:]])
