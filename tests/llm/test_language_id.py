"""Language identification: exact best paths on small cases, held-out accuracy on the table."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalumen.llm import language_id as L
from catalumen.llm.base import table


def path_value(score, path, switch):
    return sum(score[i][k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(30))
def test_viterbi_is_the_best_of_all_paths(seed):
    rng = np.random.default_rng(seed)
    score = -rng.integers(0, 9, (6, 3)).astype(np.float32)
    best = max(path_value(score, p, 4.0) for p in itertools.product(range(3), repeat=6))
    assert path_value(score, L.viterbi(score, 4.0), 4.0) == best
    constant = L.one_language(score, np.array([0, 6]), 4.0)[0]
    assert constant < 0 or path_value(score, [constant] * 6, 4.0) == best


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, "/root/testdata/sf0.01", "documents")


@pytest.fixture(scope="module")
def model(docs):
    return L.fold_model(docs)


def test_held_out_accuracy(spark, docs):
    got = L.op10_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    row = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert row[0] > 0.97 and row[1] > 100
    assert got.count() == docs.count() and got.filter("score < 0 or score > 1").count() == 0


def test_mixed_text_gets_spans(spark, docs, model):
    one = {r["lang"]: r["text"] for r in docs.filter("n_chars between 1500 and 3000").groupBy("lang").agg(
        F.min_by("text", "doc_id").alias("text")).collect()}
    mixed = one["en"] + "\n" + one["fr"]
    row = L.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    first, last = row["spans"][0], row["spans"][-1]
    assert (first["lang"], first["start"], last["lang"], last["end"]) == ("en", 0, "fr", len(mixed))
    assert abs(first["end"] - len(one["en"])) < 60


def test_odd_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 – 34 €!", "a"), (None, "the thing and the other", "a"),
            (5, "the thing and the other " * 20_000, "a"), (5, "the thing and the other " * 20_000, "a"), (6, "Привет мир", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang"], r["score"]) for r in L.identify(frame, model).collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert got[3:6] == [(None, "en", 1.0), (5, "en", 1.0), (5, "en", 1.0)] and got[6][1] in model.languages
    assert L.identify(frame.limit(0), model).count() == 0
    for rows in (frame.limit(0), frame.filter("doc_id in (1, 2)")):
        empty = L.learn(rows, "text", "lang")
        assert {r["lang"] for r in L.identify(frame, empty).collect()} == {"und"}


def test_scripts_narrow_the_candidates(spark):
    rows = [("привет мир как дела друг", "ru"), ("hello world how are you friend", "en")] * 20
    model = L.learn(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    frame = spark.createDataFrame([(1, "борщ"), (2, "zzz qqq")], "doc_id long, text string")
    assert [r["lang"] for r in L.identify(frame, model).collect()] == ["ru", "en"]


def test_keep_known_drops_texts_without_letters(spark, model):
    rows = [(1, None, "a"), (2, "12 !", "b"), (3, "the thing", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    assert [tuple(r) for r in L.keep_known(frame, model).collect()] == [(3, "the thing", "c")]
