"""The subsequence kernel against its definition, and held-out quality with gapped and inserted letters."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalumen.llm import toxicity as X
from catalumen.llm.base import flat_bytes, table

INSULTS = ("blorkhead", "snizzwit", "grumpkin", "dunderfop")


def kernel(a, b):
    """Sum over letter triples in order, spanning at most SPAN letters, of the decay of both spans."""
    def triples(w):
        out = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < X.SPAN:
                out[w[i], w[j], w[k]] = out.get((w[i], w[j], w[k]), 0) + X.DECAY ** (k - i + 1)
        return out

    x, y = triples(a), triples(b)
    return sum(v * y.get(t, 0) for t, v in x.items())


def letters(*texts):
    return X.letters_of(*flat_bytes(pa.array(texts, pa.string())))


def code(word):
    return letters(word).code.astype(np.uint8).tobytes()


def test_features_give_the_kernel():
    words = ["idiot", "idxiot", "banana", "ab", "zzz", "mississippi"]
    rows = X.triples_of([code(w) for w in words]).astype(float)
    for (i, a), (j, b) in itertools.product(enumerate(words), repeat=2):
        norm = (kernel(a, a) * kernel(b, b)) ** 0.5
        assert rows[i] @ rows[j] == pytest.approx(kernel(a, b) / norm if norm else 0, abs=1e-5)


def test_word_scores_are_linear_in_the_triples():
    weights = np.random.default_rng(1).normal(size=X.CODES**3).astype(np.float32)
    words = ["idiot", "mississippi", "aaaaaaa", "ab", "overlong" * 3]
    got = X.word_scores(letters(" ".join(words), "", "idiot"), weights, 50.0, {})
    want = X.triples_of([code(w) for w in [*words, "idiot"]]) @ weights + 50.0
    assert got == pytest.approx(want, abs=1e-3)


def test_words_join_single_letters_and_skip_signs():
    found = letters("an I.d-1.o.t", "i d i o t", "x", "")
    words = [found.code[a:a + n].tolist() for a, n in zip(found.first, found.length)]
    idiot = letters("idiot").code.tolist()
    assert words == [letters("an").code.tolist(), idiot, idiot, letters("x").code.tolist()] and found.of.tolist() == [0, 0, 1, 2]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]

    def text(bad):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(INSULTS))
        return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)

    labels = np.array([i % 4 == 0 for i in range(1200)])
    return X.fit([text(bad) for bad in labels], labels), text


def scores(spark, model, texts):
    rows = list(enumerate(texts))
    return [r["score"] for r in X.score(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()]


def test_insults_with_gaps_and_inserted_letters(spark, model):
    found, text = model
    clean = scores(spark, found, [text(False) for _ in range(200)])
    bent = ["blo.rkhead", "blorkxhead", "snizzwitt", "g r u m p k i n", "dunderf0p", "grumpkiin", "SNIZZWIT", "dunnderfop"]
    bad = scores(spark, found, [text(False) + " " + w for w in bent])
    assert np.mean(np.array(clean) >= 0.5) < 0.03 and np.mean(np.array(bad) >= 0.5) >= 0.8


def test_held_out_quality_of_the_query(spark):
    d = "/root/testdata/sf0.1"
    got = X.op6_toxicity(spark, d).join(table(spark, d, "labels"), "doc_id").filter("held_out")
    rows = got.select("score", "toxic", "predicted").toPandas()
    rank, bad = rows["score"].rank(), rows["toxic"] == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / bad.sum() / (~bad).sum()
    assert auc > 0.93 and (rows["predicted"] == rows["toxic"]).mean() > 0.95
    assert ((rows["score"] >= 0.5).astype(int) == rows["predicted"]).all()


def test_odd_rows(spark, model):
    long = "ba ne " * 200_000 + "blorkhead snizzwit"
    rows = [(1, None, 0), (2, "", 0), (3, " \t!? 9", 0), (None, "blorkhead snizzwit", 0), (5, long, 0), (5, long, 0), (6, "日本 ñandú", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {r["doc_id"]: r["score"] for r in X.score(frame, model[0]).collect()}
    assert got[1] == got[2] == got[3] < 0.5 < min(got[None], got[5]) and 0 <= got[6] < 0.5
    assert X.score(frame, model[0]).count() == 7 and X.score(frame.limit(0), model[0]).count() == 0
    labels = spark.createDataFrame([(1, None), (1, 1), (None, 0), (9, 1)], "doc_id long, toxic int")
    assert X.fold_model(frame, labels).bias == X.EMPTY.bias
    assert X.score(frame, X.fold_model(frame, labels.limit(0))).filter(F.col("score") >= 0.5).count() == 0


def test_sample_is_chosen_on_narrow_rows(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(X, "fit", lambda texts, toxic: taken.append(list(zip(texts, toxic.tolist()))))
    docs = spark.createDataFrame([(i, f"text {i % 40}" + "x" * (i % 40)) for i in range(60)] + [(3, "another"), (70, None), (None, "y")], "doc_id long, text string")
    # Document 5 has two labels, 1 after 0; texts 0 to 19 stand in two documents.
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(60)] + [(5, 1), (3, 0), (None, 1), (70, 1), (4, None)], "doc_id long, toxic int")
    X.learn(docs, labels)
    X.learn(docs.orderBy(F.desc("doc_id")).repartition(3), labels.repartition(2))
    assert taken[0] == taken[1]
    want = {(t, l) for t, l in ((r["text"], r["doc_id"] % 10 == 0 or r["doc_id"] == 5) for r in docs.filter("doc_id is not null and text is not null").collect())}
    assert set(taken[0]) == want and len(taken[0]) == len(want)
    X.learn(docs, labels, toxic_rows=2, other_rows=5, most_bytes=200)
    some = taken[2]
    assert set(some) <= want and sum(l for _, l in some) <= 2 and 0 < sum(not l for _, l in some) <= 5
    assert all(sum(len(t) for t, l in some if l == label) <= 100 for label in (True, False))
