"""The pivot index against all pairs by brute force and against SQL."""

from __future__ import annotations

import numpy as np
import pytest

from catalumen.llm import embedding_dup as V
from tests.oracle import compare, connect


def brute(rows, least):
    """``{key: (links, component)}`` of (key, vector, label) rows with distinct keys."""
    keys, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    now = keys.copy()
    for _ in range(len(rows)):
        new = np.minimum(now, np.where(linked, now[None, :], now.max() + 1).min(1))
        if (new == now).all():
            break
        now = new
    return {int(k): (int(n), int(c)) for k, n, c in zip(keys, linked.sum(1), now)}


def cloud(rng, n, d):
    """Single vectors, pairs at cosines around the limit, a dense cluster, a chain and exact copies."""
    rows = []
    for _ in range(n):
        a = rng.normal(size=d)
        rows.append(a)
        kind = rng.integers(6)
        if kind == 0:
            b = rng.normal(size=d)
            b -= a * (a @ b) / (a @ a)
            c = rng.uniform(0.92, 0.96)
            rows.append(c * a / np.linalg.norm(a) + np.sqrt(1 - c * c) * b / np.linalg.norm(b))
        elif kind == 1:
            rows += [a * rng.uniform(0.5, 3)] + [a] * int(rng.integers(3))
    centre = rng.normal(size=d)
    rows += [centre + rng.normal(size=d) * 0.15 for _ in range(n // 4)]
    step = rng.normal(size=d)
    for _ in range(15):
        rows.append(step)
        step = step + rng.normal(size=d) * 0.3
    order = rng.permutation(len(rows))
    return [(int(i), [float(v) for v in np.float32(rows[j])], int(rng.integers(2))) for i, j in enumerate(order)]


@pytest.mark.parametrize("block", [2048, 40])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rows = cloud(np.random.default_rng(block), 400, 24)
    want = brute(rows, 0.93)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component"]) for r in V.near_vectors(frame, 0.93).collect()}
    links = sum(n for n, _ in want.values())
    assert set(got) == set(want) and links > 1000
    assert all(got[k][0] <= want[k][0] for k in want) and sum(n for n, _ in got.values()) >= 0.99 * links


def test_many_pivots_keep_the_links_of_dense_groups(spark, monkeypatch):
    # As many pivots as a million vectors have; a third of the rows in a group that is linked throughout, a third in a wider cone.
    monkeypatch.setattr(V, "LEAST_PIVOTS", 1024)
    rng, n, d = np.random.default_rng(3), 600, 32
    x = np.concatenate([rng.normal(size=d) + rng.normal(size=(n, d)) * 0.2, rng.normal(size=d) + rng.normal(size=(n, d)) * 0.35, rng.normal(size=(n, d))])
    rows = [(i, [float(c) for c in np.float32(v)], 0) for i, v in enumerate(x)]
    want = brute(rows, 0.93)
    got = {r["vec_id"]: r["n_links"] for r in V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93).collect()}
    for part in (range(n), range(n, 2 * n)):
        links = sum(want[i][0] for i in part)
        assert links > n and sum(got[i] for i in part) >= 0.995 * links
    assert all(got[i] <= want[i][0] for i in want)


def test_query_equals_sql(spark, smoke_dir):
    for d in (smoke_dir, "/root/testdata/sf0.01"):
        assert compare(spark, connect(d), "op7", V.op7_embedding_dup, V.SQL, d) is None


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, 0), (2, [1.0, 0.0], 1, 0), (3, [2.0, 0.1], 1, 0), (4, [1.0, 0.0], 2, 0), (5, [1.0, 0.0], None, 0), (6, None, 1, 0),
            (7, [0.0, 0.0], 1, 0), (8, [1.0, None], 1, 0), (9, [nan, 1.0], 1, 0), (10, [inf, 1.0], 1, 0), (11, [], 1, 0),
            (12, [1.0, 0.0, 0.0], 1, 0), (None, [1.0, 0.0], 1, 0), (14, [3e38, 0.0], 1, 0), (14, [3e38, 0.0], 1, 0), (15, [1e-30, 0.0], 1, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, size int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component"]) for r in V.near_vectors(frame, 0.93).collect() if r["vec_id"])
    assert got == [(1, 5, 1), (2, 5, 1), (3, 5, 1), *((i, 0, i) for i in range(4, 13)), (14, 5, 1), (14, 5, 1), (15, 5, 1)]
    assert V.near_vectors(frame, 0.93).count() == 16 and V.near_vectors(frame.limit(0), 0.93).count() == 0


def test_a_key_with_two_vectors(spark):
    # Two far vectors under one key, each with one near neighbour; the groups stay apart.
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (5, [1.0, 0.1], 0), (7, [0.1, 1.0], 0), (9, [-1.0, 0.0], 0), (8, [-1.0, 0.1], 0)]
    got = sorted(tuple(r) for r in V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (5, 1, 1), (7, 1, 1), (8, 1, 8), (9, 1, 8)]
