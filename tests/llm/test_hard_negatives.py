"""Hard negatives against brute force over Python integers and against SQL."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalumen.llm import hard_negatives as H
from tests.oracle import compare, connect

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, step=10, scale=256):
    whole = {i: ([math.floor(scale * c) for c in v], label) for i, v, label in rows}
    out = []
    for a in sorted(whole):
        if a % step:
            continue
        scores = {i: sum(x * y for x, y in zip(whole[a][0], whole[i][0])) for i in whole if i != a}
        ranked = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in ranked if whole[i][1] == whole[a][1]][:5]:
            fits = [i for i in ranked if whole[i][1] != whole[a][1] and 80 * scores[p] <= 100 * scores[i] <= 100 * scores[p]]
            out += [(a, p, n + 1, i, scores[p], scores[i]) for n, i in enumerate(fits[:5])]
    return out


def found(spark, rows, step=10, schema=SCHEMA, **more):
    return sorted(map(tuple, H.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % step == 0, **more).collect()))


@pytest.mark.parametrize("size, spread", [(3, 1.0), (40, 1.0), (8, 1e6), (2_100, 50.0)])
def test_products_are_exact(size, spread):
    rng = np.random.default_rng(size)
    a, b = (np.floor(rng.normal(size=(n, size)) * 256 * spread) for n in (7, 9))
    a[0], b[0] = np.abs(a).max(), -np.abs(a).max()
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    bound = max(abs(x) for row in want for x in row)
    primes = H.basis(size, bound)
    assert bound < 2 ** 62 and math.prod(primes) > 2 * bound and (max(primes) // 2) ** 2 * min(size, H.STRIP) <= 1 << 24
    got = H.Residues(a, primes).products(H.Residues(b, primes), slice(0, 7))
    assert got.tolist() == want


def test_products_reach_the_ends_of_a_long():
    a, b = np.array([[2.0 ** 30, 2.0 ** 30 - 1]]), np.array([[2.0 ** 31, 2.0 ** 31], [-(2.0 ** 31), -(2.0 ** 31)], [3.0, -5.0]])
    want = [[int(x) for x in (2 ** 61 + (2 ** 30 - 1) * 2 ** 31, -(2 ** 61) - (2 ** 30 - 1) * 2 ** 31, 3 * 2 ** 30 - 5 * (2 ** 30 - 1))]]
    primes = H.basis(2, 2 ** 62)
    assert H.Residues(a, primes).products(H.Residues(b, primes), slice(0, 1)).tolist() == want


@pytest.mark.parametrize("block", [65_536, 37])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "SCORES", block * 5)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 12))
    x = centres[rng.integers(6, size=300)] + rng.normal(size=(300, 12)) * 0.4
    # Copies and coarse vectors tie; a hot label holds half of the rows.
    x[40:90] = x[3]
    x[90:150] = np.round(x[90:150])
    rows = [(i, [float(c) for c in v], int(rng.choice([1, 1, 1, 2, 3, 4]))) for i, v in enumerate(x)]
    want = brute(rows)
    assert found(spark, rows) == sorted(want) and len(want) > 100


def test_query_equals_sql(spark, smoke_dir):
    for d in (smoke_dir, "/root/testdata/sf0.01"):
        assert compare(spark, connect(d), "op13", H.op13_hard_negatives, H.SQL, d) is None
    assert H.op13_hard_negatives(spark, "/root/testdata/sf0.1").count() > 0


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (3, [1.0, nan], 2), (4, None, 2), (5, [1.0, None], 2),
            (6, [1.0, 2.0], None), (None, [1.0, 2.0], 2), (7, [1.0], 2), (10, [], 1), (11, [], 1), (12, [], 2), (20, [-1.0, -2.0], 3), (21, [1.0, 2.0], 3)]
    first = 256 * 256 * 5
    assert found(spark, [(*r, 7) for r in rows], schema=SCHEMA + ", tag int") == [
        (0, 1, 1, 21, first, first), (0, 1, 2, 2, first, sum(math.floor(256 * x) * y for x, y in zip((1.0, 1.9), (256, 512)))), (10, 11, 1, 12, 0, 0)]
    assert found(spark, rows[:1]) == [] and H.hard_negatives(spark.createDataFrame(rows, SCHEMA).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError, match="long"):
        found(spark, [(0, [3e38, 1.0], 1), (1, [1.0, 1.0], 1)])
