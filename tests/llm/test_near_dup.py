"""Near duplicates against all pairs by brute force."""

from __future__ import annotations

import random
import re

import pytest

from catalumen.llm import near_dup as N
from catalumen.llm.base import table
from catalumen.llm.stars import components


def brute(rows, words, percent):
    """``{row number: (set size, component)}`` of (key, text) rows with distinct keys."""
    sets = {}
    for key, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[key] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by_shingle = {}
    for k, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    done = set()
    for group in by_shingle.values():
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                if (a, b) not in done:
                    done.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= percent * len(sets[a] | sets[b]):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {k: (len(s), root(k)) for k, s in sets.items()}


def test_components_of_a_path(spark):
    links = spark.range(1, 300).selectExpr("id as a", "id - 1 as b")
    more = spark.createDataFrame([(1000, 2000), (2000, 1000), (3000, 3000), (1500, 2000)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links.union(more), "a", "b").collect()}
    assert got == {i: 0 for i in range(300)} | {1000: 1000, 1500: 1000, 2000: 1000}


def test_query_equals_brute_force_on_the_table(spark, smoke_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, smoke_dir, "documents").collect()]
    want = brute(docs, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.op5_near_dup(spark, smoke_dir).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in want.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_dense_buckets(spark, seed):
    """Chains of edits, many near copies of one text, and many texts that share half of it."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows, chain = [], list(base)
    for i in range(60):
        rows.append((i, " ".join(chain)))
        chain[rng.randrange(80)] = f"x{i}"
    for i in range(60, 120):
        near = list(base)
        near[rng.randrange(80)] = f"y{i}"
        rows.append((i, " ".join(near)))
    for i in range(120, 180):
        rows.append((i, " ".join(base[:55] + [f"z{rng.randrange(10**6)}" for _ in range(25)])))
    rng.shuffle(rows)
    want = brute(rows, 3, 85)
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, similarity=0.85)
    assert {r["doc_id"]: (r["n_shingles"], r["component"]) for r in found.collect()} == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None, 0), (2, "", 0), (3, " \t", 0), (4, "One two", 0), (5, "one\x0btwo", 0), (6, "one\xa0two", 0), (7, long, 0),
            (8, long + " end", 0), (8, long + " end", 0), (None, long, 0), (None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component"]) for r in N.near_duplicates(docs).collect()), key=str)
    n = 200_000 - 4
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, n, 7), (8, n + 1, 7),
                          (8, n + 1, 7), (-1, n, None), (-1, 0, None)], key=str)
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "a"), (2, text + " x", "b"), (4, None, "c"), (None, text, "d"), (9, "other", "e")]
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component string"))
    assert sorted(r["component"] for r in kept.collect()) == ["b", "c", "d", "e"] and kept.columns == ["doc_id", "text", "component"]
