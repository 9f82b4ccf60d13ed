"""Spans against the plain patterns; links of weak parts against all pairs."""

import re

import pytest

from tests.llm.cases import awkward, documents
from vaultferry.llm import secrets_scan as sc

KEY = "aB3" + "xY7zQ9" * 7
ACCESS = "AKIA" + "ABCDEFGH12345678"
FAR = " lorem ipsum" * 60


def base(text):
    out = []
    pattern = (
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9+/_.=-]+)"
    )
    for m in re.finditer(pattern, text, re.ASCII):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


TEXTS = [
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok',
    "password: token:abcdefghij",  # the failing match uses up the name of the next
    "PassWord='s3cr3t-value' api_key=12345678 apikey:1234567",
    "pasſword=abcdefgh Key toKen=abcdefgh1",  # letters that only fold to ASCII
    f"\U0001f511 é {ACCESS} {ACCESS[:15]} AKIAAKIA{ACCESS}",
    f"user=alice {KEY} https://db.example.com/x",  # three parts together
    f"user=alice {FAR} {KEY}",  # too far apart
    KEY,  # a key alone
    f"https://example.com {FAR} user=bob",  # no secret
    f"user=bob https://example.com/{'p' * 500}?x={FAR[:150]} {KEY}",  # a long endpoint
    "a" * 40 + " " + "f" * 31 + " " + "0" * 32,
    f"{ACCESS} {KEY}",
]


def brute_links(text):
    spans = sc.spans_of(text)
    out = []
    for a, b, r in spans:
        role = sc.ROLES[sc.KINDS[r]]
        for c, d, q in spans:
            other = sc.ROLES[sc.KINDS[q]]
            gap = max(c - b, a - d)
            fits = role != other and (role != "identity" or other == "secret")
            if r >= 3 and (a, b) != (c, d) and fits and gap <= sc.REACH:
                out.append((a, r, b))
                break
    return out


@pytest.fixture(scope="module")
def rows():
    return [(n, t) for n, t in enumerate(TEXTS)] + [(100, t) for t in TEXTS[:2] * 2] + [
        r[:2] for r in awkward()
    ]


def test_spans_equal_brute_force(spark, rows):
    docs = documents(spark, [r for r in rows if r[0] != 9 or True])
    got = sc.secret_spans(docs).collect()
    found = sorted((repr(r.doc_id), [(s.start, s["rank"], s.end) for s in r.spans]) for r in got)
    want = sorted((repr(i), sorted(base(t or "") + brute_links(t or ""))) for i, t in rows)
    assert found == want
    assert all(s.kind == sc.KINDS[s["rank"]] for r in got for s in r.spans)


def test_weak_parts_need_a_complement():
    assert [len(brute_links(t)) for t in TEXTS[5:9]] == [3, 0, 0, 0]
    assert len(brute_links(TEXTS[9])) >= 2 and len(brute_links(TEXTS[11])) == 1


NAMED = [
    (f"AWS_ACCESS_KEY_ID={ACCESS}\nAWS_SECRET_ACCESS_KEY={KEY}\n", KEY),
    (f"export ID={ACCESS}; export SIGNING={KEY}==", f"{KEY}=="),
    (f"{ACCESS} https://h.example/x?sig={KEY}&z=1", KEY),
    (f"{ACCESS} {KEY * 5}", KEY * 5),  # 225 characters
    (f"{ACCESS} BLOB={KEY * 50}", KEY * 50),
    (f"{ACCESS} +={KEY}", None),  # no name
    (f"{ACCESS} NAME=={KEY}", None),
    (f"{FAR} SECRET_ACCESS_KEY={KEY}", None),  # a key alone
]


def test_named_and_long_keys(spark):
    docs = documents(spark, list(enumerate(t for t, _ in NAMED)))
    got = {r.doc_id: r.spans for r in sc.secret_spans(docs).collect()}
    for n, (text, key) in enumerate(NAMED):
        found = [text[s.start : s.end] for s in got[n] if s.kind == "key"]
        assert found == ([key] if key else []), text
        assert [(s.start, s["rank"], s.end) for s in got[n]] == sorted(base(text) + brute_links(text))


def test_redaction(spark):
    docs = documents(spark, [(1, TEXTS[0]), (2, "clean é text"), (3, None)])
    got = {r.doc_id: r.text for r in sc.redacted(docs, sc.secret_spans(docs)).collect()}
    assert got == {1: '[secret]" ok', 2: "clean é text", 3: None}


def test_empty_table(spark):
    assert sc.secret_spans(documents(spark, [])).collect() == []
