"""Difference-cover anchors against all windows by brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from catalumen.llm import packs as K
from catalumen.llm import substring_dedup as S
from catalumen.llm.base import table


def brute(rows, window=13):
    """``{key: (words, removed, kept text)}`` of (key, text) rows with distinct keys."""
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}
    least = {}
    for k, w in words.items():
        for i in range(len(w) - window + 1):
            x = tuple(w[i:i + window])
            least[x] = min(k, least.get(x, k))
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < k:
                gone.update(range(i, i + window))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_cover_reaches_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


@pytest.fixture
def tiny_packs(monkeypatch):
    monkeypatch.setattr(K, "PACK_BYTES", 20_000)
    monkeypatch.setattr(K, "BUCKET_KEYS", 1 << 10)


def test_query_equals_brute_force_on_the_table(spark, smoke_dir, tiny_packs):
    want = brute([(r["doc_id"], r["text"]) for r in table(spark, smoke_dir, "documents").collect()])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.op8_substring_dedup(spark, smoke_dir).collect()}
    assert got == {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in want.items()}
    assert sum(m for _, m, _ in want.values()) > 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_passages_at_all_offsets(spark, seed, tiny_packs):
    rng = random.Random(seed)
    pool = [[f"p{j}x{i}" for i in range(rng.choice([12, 13, 14, 30]))] for j in range(12)]
    rows = []
    for k in range(300):
        out = []
        for _ in range(rng.randint(0, 6)):
            out += [f"u{rng.randrange(50)}" for _ in range(rng.randint(0, 15))] + rng.choice(pool)
        rows.append((k * 7 % 300, rng.choice([" ", "\n", " \t"]).join(out)))
    found = S.dedup_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in found.collect()} == brute(rows)


def test_odd_rows(spark):
    shared = " ".join(f"w{i}" for i in range(13))
    long = " ".join(f"v{i}" for i in range(300_000)) + " " + shared
    rows = [(1, shared, 0), (2, None, 0), (3, "", 0), (4, long, 0), (None, shared, 0), (6, shared + "\xa0", 0), (7, "a b", 0),
            (8, "é " + shared, 0), (8, "é " + shared, 0), (9, " ".join(["x"] * 40), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in S.dedup_windows(docs).collect()))
    assert got == [(0, 13, 13), (1, 13, 0), (2, 0, 0), (3, 0, 0), (4, 300_013, 13), (6, 13, 0), (7, 2, 0), (8, 14, 13), (8, 14, 13), (9, 40, 0)]
    assert S.dedup_windows(docs.limit(0)).count() == 0
