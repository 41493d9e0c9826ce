"""Secret scans against a brute-force version that tries every expression everywhere."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time

from catalumen.llm import secret_scan as S
from catalumen.llm.base import table

BASE = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
        ("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16))


def base_spans(text):
    found = []
    for order, (kind, pattern, least) in enumerate(BASE):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def planted(rng):
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "APIKEY", "AKIA", "akia", ": ", " = ", '"', "'",
             "=", " ", "é", "İ", "ſecret=", "abcdef0123456789", "0" * 15, "ABCDEFGH12345678", "x" * 11, "y" * 12, "-", "K", "\n",
             "ghp_" + "a" * 30 + S.crc62("a" * 30), "ghp_" + "a" * 36, "card 4111 1111 1111 1111", "card 4111 1111 1111 1112",
             "IBAN GB82 WEST 1234 5698 7654 32", "IBAN GB83 WEST 1234 5698 7654 32", "eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.abcdefgh12"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def test_scan_equals_brute_force_on_planted_texts():
    rng, keywords = random.Random(5), S.automaton()
    for _ in range(3000):
        text = planted(rng)
        assert [s for s in S.scan(text, keywords) if s[0] in S.BASE_KINDS] == base_spans(text), text


def test_checksums_decide():
    def kinds(t):
        return [k for k, _, _ in S.scan(t, S.automaton())]

    body = "Zx81" * 7 + "qq"
    assert kinds("ghp_" + body + S.crc62(body)) == ["github"] and kinds("ghp_" + body + "000000") == []
    assert kinds("npm_" + body + S.crc62(body)) == ["npm"]
    assert kinds("card: 4111-1111-1111-1111") == ["card"] and kinds("card: 4111-1111-1111-1112") == []
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32") == ["iban"] and kinds("IBAN GB83 WEST 1234 5698 7654 32") == []
    assert kinds("eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.abcdefgh12") == ["jwt"]


def test_numbers_behind_and_before_other_groups():
    def texts(t):
        return [t[a:b] for _, a, b in S.scan(t, S.automaton())]

    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    assert texts(f"card 12/27 {card}") == texts(f"visa card {card}") == texts(f"card {card} 12") == [card]
    assert texts(f"IBAN {iban} EUR") == texts(f"IBAN XX00 1234 5678 {iban}") == [iban]
    assert texts("card 12/27 4111 1111 1111 1112") == texts("IBAN BE69 5390 0754 7034 EUR") == []
    assert S.redacted(f"IBAN {iban} EUR", S.scan(f"IBAN {iban} EUR", S.automaton())) == "IBAN [iban] EUR"


def test_nested_headers_and_long_runs():
    keywords = S.automaton()
    nested = "eyJ" + base64.urlsafe_b64encode(b"xxx" + b"[" * 200_000).decode().rstrip("=")[3:]
    deep = base64.urlsafe_b64encode(b'{"a":' * 100_000).decode().rstrip("=")
    assert deep.startswith("eyJ")
    for header in (nested, deep):
        assert S.scan(f"{header}.eyJhIjoxfQ.abcdefgh12", keywords) == []
    good = "eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.abcdefgh12"
    start = time.perf_counter()
    assert S.scan("eyJ" * 350_000 + " " + good, keywords) == [("jwt", 1_050_001, 1_050_001 + len(good))]
    assert time.perf_counter() - start < 2
    # A hit in other letters does not use up the run.
    assert [s[0] for s in S.scan("EYJx" + good, keywords)] == ["jwt"]


def test_query_over_the_table(spark, smoke_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, smoke_dir, "documents").collect()}
    got = S.op2_secret_scan(spark, smoke_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        want = base_spans(docs[r["doc_id"]] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == w for k, _, _ in want) for w in S.BASE_KINDS)


def test_odd_rows(spark):
    long = "a " * 400_000 + "password=" + "q" * 20
    rows = [(1, None, "x"), (None, "", "y"), (2, long, None), (2, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r["doc_id"] or 0, len(r["spans"])) for r in S.find_secrets(docs).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (2, 1)]
    assert S.find_secrets(docs.limit(0)).count() == 0
    clean = {(r["doc_id"], r["text"] and r["text"][-12:], r["spans"]) for r in S.redact(docs).collect()}
    assert clean == {(1, None, "x"), (None, "", "y"), (2, "a a [assign]", None)}
