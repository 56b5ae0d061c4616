"""Anchor expansion against the base definitions as regular expressions."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from radloom.llm import pii
from radloom.llm.pii import automaton, luhn, spans

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
A = automaton()


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


def base(text):
    return [s for s in spans(text, A) if s[1] < 4]


PIECES = ["a", "b.c", "@", "x@y.z", ".", "-", " ", "+", "1", "12", "255", "256", "0001", "1.2.3.4", "10.0.0.1", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "\U0001f600", "%", "_", "://", "iban", "\n"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_base_spans_equal_the_expressions(pieces):
    text = "".join(pieces)
    assert base(text) == brute(text)


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet="0123456789.+- ()@a", max_size=60))
def test_base_spans_on_digit_soup(text):
    assert base(text) == brute(text)


def test_long_digit_runs_are_linear():
    assert base("1" * 200_000) == [] and base("1." * 100_000)[:1] == [(0, 1, 7)]


def test_extra_spans():
    assert (6, 4, 28) in spans("IBAN: DE89 3704 0044 0532 0130 00", A) or any(s[1] == 4 for s in spans("IBAN: DE89 3704 0044 0532 0130 00", A))
    assert any(s[1] == 5 for s in spans("write joe.x [at] mail [dot] org now", A))
    assert [s for s in spans("see https://a.b/c?d=1, ok", A) if s[1] == 6] == [(4, 6, 21)]


def test_secrets():
    hexes = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"
    for text in (f'a token = "{hexes}" b', f"TOKEN: {hexes}.", f"access_token={hexes}", f"Authorization: Bearer {hexes}", f"the password is {hexes}"):
        assert [text[s[0] : s[2]] for s in spans(text, A) if s[1] == 7] == [hexes]
    for text in ("the token of appreciation", "token = 123456789012345678", "tokens = " + hexes, "secret: aaaa1111aaaa1111", "token" * 50_000):
        assert not [s for s in spans(text, A) if s[1] == 7]


def test_rows_and_counts(spark):
    import hashlib

    from pyspark.sql import functions as F

    from radloom.llm.pii import KINDS, find_pii

    planted = 'Write a.b@c.org or +1 (555) 123-4567, from 10.0.0.1 \U0001f600 card 4111 1111 1111 1111, token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"'
    texts = [(1, planted), (1, planted), (2, None), (3, ""), (None, "x@y.z"), (4, ("word " * 60_000) + planted)]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(9) for c in ("spans", "n_email", "source")})
    got = find_pii(d).collect()
    assert len(got) == len(texts) and find_pii(d.limit(0)).count() == 0
    key = lambda x: (str(x[0]), str(x[1]))
    for r, (i, text) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["n_email"])), sorted(texts, key=key), strict=True):
        found = spans(text, A) if text else []
        joined = lambda x: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x)
        assert r["doc_id"] == i and r["spans"] == joined(found) and r["base_sha256"] == hashlib.sha256(joined(brute(text or "")).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == n for s in found) for n in range(len(KINDS))]
    assert [r["n_secret"] for r in got if r["doc_id"] in (1, 4)] == [1, 1, 1]


def test_accounts_keep_the_rules_of_their_kind_and_keys_are_found_by_prefix():
    a = pii.automaton()

    def of(text):
        return [(pii.KINDS[k], text[i:j]) for i, k, j in pii.spans(text, a) if k >= 4]

    assert of("iBAN: DE89 3704 0044 0532 0130 00.") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert of("IBAN DE00 0000 0000 0000 0000 00") == of("SSN 000-00-0000") == of("ssn 666-12-1234") == of("routing number 123456789") == []
    assert of("SSN 123-45-6789, Routing Number: 021000021, Kontonummer 12345678") == [("account", "123-45-6789"), ("account", "021000021"), ("account", "12345678")]
    keys = ["AKIA" + "ABCD1234" * 2, "ghp_" + "aB3" * 12, "sk_" + "live_" + "a1B2" * 6, "-----BEGIN RSA PRIVATE KEY-----"]
    assert of("x " + " y ".join(keys)) == [("secret", k) for k in keys]
    assert of("password=correcthorse") == [("secret", "correcthorse")] and of("the password is required") == []
    long = "A1" * 50_000
    assert of("account " + long) == [("account", long)]
    ip = "0" * 20_000 + "1.2.3.4"
    assert [(k, i, j) for i, k, j in pii.spans(ip, a)] == [(1, 0, len(ip))]
