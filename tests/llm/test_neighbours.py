"""Cross-polytope search against all distances by brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalumen.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, best=10, step=100):
    """``{query: [(id, distance)]}`` of ``(id, vector)`` rows with distinct ids."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:best]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(spark, rows, best=10, step=100, schema=SCHEMA):
    got = {}
    for r in N.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % step == 0, best).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in got.items()}


def recall(got, want):
    hits = sum(len({i for _, i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def check(got, want, rows, least):
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert set(got) == set(want) and recall(got, want) >= least
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, len(want[q]) + 1))
        assert [(s, i) for _, i, s in near] == sorted((s, i) for _, i, s in near)
        assert all(i != q and abs(s - np.linalg.norm(vectors[q] - vectors[i])) < 1e-9 for _, i, s in near)


def named(x):
    return [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [4096, 60])
def test_finds_the_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(block)
    # Single vectors, groups around centres, one dense group, and a common direction for all.
    centres = rng.normal(size=(30, 24))
    x = np.concatenate([rng.normal(size=(900, 24)), centres[rng.integers(30, size=900)] + rng.normal(size=(900, 24)) * 0.3,
                        centres[0] + rng.normal(size=(900, 24)) * 0.1]) + 5 * rng.normal(size=24)
    rows = named(x[rng.permutation(len(x))])
    check(found(spark, rows, step=20), brute(rows, step=20), rows, 0.95)


def test_more_codes_than_one(spark, monkeypatch):
    # Cells as for a table many times as large.
    monkeypatch.setattr(N, "PER_CELL", 0.05)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 16))
    rows = named(centres[rng.integers(200, size=3_000)] + rng.normal(size=(3_000, 16)) * 0.25)
    assert N.fit_probes(N.directions(np.array([v for _, v in rows]), np.zeros(16)), 3_000, 10)[0] >= 2
    check(found(spark, rows, step=20), brute(rows, step=20), rows, 0.95)


def test_copies_and_few_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8))
    x[100:400] = x[7]
    rows = named(x)
    check(found(spark, rows, step=50), brute(rows, step=50), rows, 0.95)
    copies = found(spark, rows, step=50)[150]
    assert [(i, s) for _, i, s in copies] == [(7, 0.0), *((i, 0.0) for i in range(100, 109))]
    few = named(rng.normal(size=(5, 3)))
    assert {q: [i for _, i, _ in v] for q, v in found(spark, few).items()} == {q: [i for i, _ in v] for q, v in brute(few).items()}


def test_query_has_the_recall_asked_for(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
        got = {}
        for r in N.op12_nearest(spark, d).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        check({q: sorted(v) for q, v in got.items()}, brute(rows), rows, 0.9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 2), (1, [1.0, 0.1], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1),
            (6, [inf, 1.0], 1), (7, [], 1), (8, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (100, [-3e38, 0.0], 1), (200, [-3e38, 0.0], 1), (0, [0.0, 2.0], 1),
            (300, [1.0], 1)]
    got = found(spark, rows, schema=SCHEMA + ", cell int")
    near = {q: [i for _, i, _ in v] for q, v in got.items()}
    # Key 0 has two different vectors, each a query that finds the other; a size of its own finds nothing.
    assert sorted(near) == [0, 100, 200] and near[100] == [200, 0, 0, 1] and near[200] == [100, 0, 0, 1]
    assert sorted(near[0]) == [0, 0, 1, 1, 100, 100, 200, 200] and got[100][0][2] == 0.0
    assert N.nearest(spark.createDataFrame(rows, SCHEMA + ", cell int").limit(0), F.col("vec_id") % 100 == 0).count() == 0
    # Copies of the mean itself have no direction at all.
    same = [(i, [1.0, 2.0]) for i in range(40)]
    assert [i for _, i, _ in found(spark, same)[0]] == list(range(1, 11))
