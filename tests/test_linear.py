"""The sparse linear classifier against dense numpy steps, and its quality against naive Bayes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalumen.functions import text
from catalumen.operators import linear, metrics, termparts, textmodel


def dense_fit(x, y, classes, rounds, ridge, seen=None):
    """The same steps on dense matrices; ``seen`` masks features by class."""
    n, w = len(x), None
    nnz = (x != 0).sum(1)
    scale = 1 / np.sqrt(2 / n * (nnz[:, None] * x * x).sum(0))
    xs = x * scale
    w = v = np.zeros((x.shape[1], len(classes)))
    own = np.array([[c == label for c in classes] for label in y])
    for beyond in linear.momentum(rounds):
        z = -1 + xs @ v
        pull = 2 / n * np.where(own, -np.maximum(1 - z, 0), np.maximum(1 + z, 0))
        g = xs.T @ pull
        if seen is not None:
            g = np.where(seen, g, 0)
        new = v - (g + ridge * v) / (1 + ridge)
        w, v = new, new + beyond * (new - w)
    return scale, w


def sparse(spark, x, names, keys, labels, parts=3):
    rows = [(k, l, [(names[j], float(v)) for j, v in enumerate(row) if v]) for k, l, row in zip(keys, labels, x)]
    return spark.createDataFrame(rows, "id long, label string, terms array<struct<term:string,weight:double>>").repartition(parts)


@pytest.mark.parametrize("per_part, values", [(None, 4_000_000), (20, 60)])
def test_equals_dense_steps(spark, monkeypatch, per_part, values):
    monkeypatch.setattr(termparts, "VALUES", values)
    rng = np.random.default_rng(3)
    x = rng.random((80, 15)) * (rng.random((80, 15)) < 0.3)
    x[5] = 0
    y = [f"c{int(np.argmax(row @ rng.random((15, 4))))}" for row in x]
    names = [f"t{j:02d}" for j in range(15)]
    model = linear.fit_linear(sparse(spark, x, names, range(80), y), "label", rounds=6, per_part=per_part)
    classes = sorted(set(y))
    scale, w = dense_fit(x, y, classes, 6, linear.RIDGE)
    got = {(r["class"], r["term"]): r["weight"] for r in model.weights.collect()}
    want = {(f"000|{c}", t): w[j, k] for j, t in enumerate(names) for k, c in enumerate(classes) if abs(w[j, k]) > 1e-12}
    assert {k: v for k, v in got.items() if abs(v) > 1e-12} == pytest.approx(want, rel=1e-6, abs=1e-9)
    new = rng.random((40, 15)) * (rng.random((40, 15)) < 0.3)
    z = np.round(-1 + (new * scale) @ w, 9)
    found = {r["id"]: (r["pred"], r["score"]) for r in model.predict(sparse(spark, new, names, range(40), [None] * 40), "id").collect()}
    assert {i: p for i, (p, _) in found.items()} == {i: classes[k] for i, k in enumerate(z.argmax(1))}
    assert [found[i][1] for i in range(40)] == pytest.approx(z.max(1).tolist())


def test_settings_share_terms_and_keep_their_own(spark):
    rng = np.random.default_rng(4)
    x = rng.random((60, 8)) * (rng.random((60, 8)) < 0.5)
    y = [f"c{i % 3}" for i in range(60)]
    names = ["a", "b", "c", "d", "\x01000|p", "\x01000|q", "\x01001|p", "\x01001|q"]
    model = linear.fit_linear(sparse(spark, x, names, range(60), y), "label", settings=2, rounds=5, per_part=9)
    classes = ["c0", "c1", "c2"] * 2
    seen = np.array([[j < 4 or (j < 6) == (k < 3) for k in range(6)] for j in range(8)])
    _, w = dense_fit(x, y, classes, 5, linear.RIDGE, seen)
    got = {(r["class"], r["term"]): r["weight"] for r in model.weights.collect()}
    want = {(f"{k // 3:03d}|{classes[k]}", t): w[j, k] for j, t in enumerate(names) for k in range(6) if abs(w[j, k]) > 1e-12}
    assert {k: v for k, v in got.items() if abs(v) > 1e-12} == pytest.approx(want, rel=1e-6, abs=1e-9)
    assert model.predict(sparse(spark, x, names, range(60), y), "id").groupBy("setting").count().count() == 2


def test_better_than_naive_bayes_where_terms_go_together(spark):
    # A class is told by a rare term; common terms lean to other classes and come in correlated runs.
    rng = random.Random(6)
    docs = []
    for i in range(900):
        c = rng.choice([0, 0, 0, 1, 1, 2, 3])
        lean = rng.choice([c, (c + 1) % 4, (c + 1) % 4])
        run = " ".join(f"common{lean}{k}" for k in range(6))
        docs.append((i, f"brand{c}", f"{run} mark{c}{rng.randrange(3)} noise{rng.randrange(50)}"))
    df = spark.createDataFrame(docs, "id long, label string, t string").withColumn("train", F.col("id") % 3 != 0)
    rows = textmodel.sparse_rows(df, "id", text.space_tokens(F.col("t")), keep=["label", "train"]).cache()
    train, test = rows.filter("train"), rows.filter("not train")
    counts = textmodel.exploded(train)
    terms = textmodel.vocabulary(counts, 2).cache()
    classes, weights = textmodel.fit_naive_bayes(counts, terms, train, "label")
    bayes = textmodel.NaiveBayes(terms, classes, weights).predict(test, "id")
    weighed = textmodel.tfidf_rows(rows, terms, F.lit(600), True).cache()
    model = linear.fit_linear(weighed.filter("train"), "label", per_part=40)
    found = model.predict(weighed.filter("not train"), "id")
    scores = [metrics.evaluate(test.join(p, "id"), "label", "pred", []).first()["macro_f1"] for p in (bayes, found)]
    assert scores[1] > max(0.95, scores[0] + 0.02)


def test_no_labels_and_no_terms(spark):
    rows = spark.createDataFrame([(1, None, [("a", 1.0)])], "id long, label string, terms array<struct<term:string,weight:double>>")
    with pytest.raises(ValueError, match="label"):
        linear.fit_linear(rows, "label")
    rows = spark.createDataFrame([(1, "x", []), (2, "y", [("a", 1.0)]), (3, "y", None)], rows.schema)
    model = linear.fit_linear(rows, "label", rounds=3)
    assert {r["id"]: r["pred"] for r in model.predict(rows, "id").collect()} == {1: "x", 2: "y", 3: "x"}


def test_weights_stay_out_of_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.random((80, 30)) * (rng.random((80, 30)) < 0.3)
    y = [f"c{i % 4}" for i in range(80)]
    names = [f"t{j:02d}" for j in range(30)]
    rows = sparse(spark, x, names, range(80), y)
    want = {r["id"]: (r["pred"], r["score"]) for r in linear.fit_linear(rows, "label", rounds=4).predict(rows, "id").collect()}
    monkeypatch.setattr(termparts, "PART_TERMS", 10)
    monkeypatch.setattr(termparts, "PART_PAIRS", 20)
    monkeypatch.setattr(termparts, "PACKED", 50)
    sent, collect = [], type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda self: sent.append(collect(self)) or sent[-1])
    got = {r["id"]: (r["pred"], r["score"]) for r in linear.fit_linear(rows, "label", rounds=4).predict(rows, "id").collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert [got[i][1] for i in want] == pytest.approx([s for _, s in want.values()])
    assert max(len(t) for t in sent if "term" in t.column_names) <= 20


def test_gradients_are_added_up_in_blocks(spark, monkeypatch):
    """A row for each pack, class and term is not exchanged as such; records are packed once for all rounds."""
    rng = np.random.default_rng(3)
    x = rng.random((60, 12)) * (rng.random((60, 12)) < 0.5)
    rows = sparse(spark, x, [f"t{j:02d}" for j in range(12)], range(60), [f"c{i % 3}" for i in range(60)])
    plans, write = {}, linear.cut_lineage

    def planned(df, purpose="stage"):
        plans.setdefault(purpose, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, purpose)

    for module in (linear, termparts):
        monkeypatch.setattr(module, "cut_lineage", planned)
    linear.fit_linear(rows, "label", rounds=3, per_part=10)
    assert len(plans["linear-weights"]) == 3 and len(plans["packs"]) == 2
    assert all("FlatMapGroupsInArrow" in p and "HashAggregate" not in p.split("FlatMapGroupsInArrow")[0] for p in plans["linear-weights"])
    assert not any("Generate" in p for p in plans["linear-scales"])


def test_pulls_are_added_up_in_bounded_runs(monkeypatch):
    """Records of many entries that push at many classes at once."""
    import pyarrow as pa

    monkeypatch.setattr(termparts, "VALUES", 1_000)
    rng = np.random.default_rng(7)
    classes, names = 40, [f"t{j}" for j in range(30)]
    labels = pa.table({"class": [f"000|c{k:02d}" for k in range(classes)], "label": [f"c{k:02d}" for k in range(classes)], "setting": [0] * classes})
    w = rng.random((30, classes))
    w[3:] = 0
    pairs = pa.table({
        "class": [f"000|c{k:02d}" for j in range(3) for k in range(classes)], "term": [names[j] for j in range(3) for k in range(classes)],
        "weight": [w[j, k] for j in range(3) for k in range(classes)]})
    x = rng.random((50, 30))
    y = [f"c{i % classes:02d}" for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"label": y, "terms": [[{"term": n, "weight": v} for n, v in zip(names, row)] for row in x]})
    longest, repeat = [0], np.repeat

    def watched(a, n, *rest, **named):
        out = repeat(a, n, *rest, **named)
        longest[0] = max(longest[0], len(out))
        return out

    monkeypatch.setattr(np, "repeat", watched)
    got = {}
    for b in linear._gradient(termparts.Part(labels, pairs), 0.1)(iter([batch])):
        for r in b.to_pylist():
            got[r["class"], r["term"]] = got.get((r["class"], r["term"]), 0) + r["g"]
    z = -1 + x @ w
    own = np.array([[label == f"c{k:02d}" for k in range(classes)] for label in y])
    want = x.T @ (0.1 * np.where(own, -np.maximum(1 - z, 0), np.maximum(1 + z, 0)))
    assert got == pytest.approx({(f"000|c{k:02d}", n): want[j, k] for j, n in enumerate(names) for k in range(classes)})
    assert longest[0] <= 1_500
