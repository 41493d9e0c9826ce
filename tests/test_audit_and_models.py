from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalumen.functions import text
from catalumen.operators import audit, images, termparts, textmodel


def test_duplicates_count_both_ways_with_null_keys(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "x"), ("b", "x"), ("b", "x"), ("b", "x")], "i string, d string")
    row = audit.duplicates(df, ["i", "d"]).first()
    assert (row["distinct_keys"], row["records"], row["duplicate_occurrences"], row["duplicated_keys"]) == (3, 6, 3, 2)


def test_stage_diff_treats_null_as_a_value(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1), (4, "q", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "Y", None), (4, "q", 1), (5, "n", 1)], "k int, s string, n int")
    rows = {r["k"]: (r["status"], r["changed_columns"]) for r in audit.stage_diff(a, b, "k", ["s", "n"]).collect()}
    assert rows == {1: ("equal", []), 2: ("changed", ["s", "n"]), 3: ("missing", None), 4: ("equal", []), 5: ("extra", None)}


def test_metric_drift(spark):
    a = spark.createDataFrame([("m", 1.0), ("only_a", 2.0), ("close", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("m", 1.1), ("only_b", 2.0), ("close", 1.0 + 1e-13)], "metric string, value double")
    passed = {r["metric"]: r["passed"] for r in audit.metric_drift(a, b, 1e-12).collect()}
    assert passed == {"m": False, "only_a": False, "only_b": False, "close": True}


def test_funnel_gives_the_first_failing_reason(spark):
    df = spark.createDataFrame([("t", None, 0), ("t", "a", 0), ("t", "a", 5), ("v", None, 9)], "split string, label string, n int")
    rows = {(r["split"], r["reason"]): (r["n"], r["percent"]) for r in audit.funnel(
        df, {"no_label": F.col("label").isNull(), "no_text": F.col("n") == 0}, ["split"]).collect()}
    assert rows[("t", "no_label")][0] == rows[("t", "no_text")][0] == rows[("t", "eligible")][0] == 1
    assert math.isclose(rows[("t", "eligible")][1], 100 / 3) and rows[("v", "no_label")] == (1, 100.0)


def test_checks_and_verdict(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    counted = audit.counters(df, {"missing": F.col("v").isNull(), "negative": F.col("v") < 0})
    assert {r["counter"]: r["value"] for r in counted.collect()} == {"records": 3, "missing": 1, "negative": 1}
    verdict = audit.overall_verdict(audit.check_table(counted, {"records": 3, "missing": 0})).first()
    assert (verdict["checks"], verdict["failed"], verdict["passed"]) == (2, 1, False)


def test_trace_keeps_unmatched_targets(spark):
    targets = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    stage = spark.createDataFrame([(1, "a"), (9, "z")], "k int, v string")
    rows = {r["k"]: (r["in_first"], r["first_v"]) for r in audit.trace(targets, "k", {"first": stage}).collect()}
    assert rows == {1: (True, "a"), 2: (False, None), 3: (False, None)}


@pytest.mark.parametrize("flags, want", [
    ((False, True, True, True, True, True, True), "MISSING_FROM_CANONICAL"),
    ((True, False, True, True, True, True, True), "MISSING_FROM_B2"),
    ((True, True, False, True, True, True, True), "SPLIT_MISMATCH"),
    ((True, True, True, False, False, True, True), "LABEL_NOT_FROM_EXPECTED_FALLBACK_SOURCE"),
    ((True, True, True, True, False, False, False), "LABEL_WITHOUT_CANONICAL_APPROVED_TEXT"),
    ((True, True, True, True, True, False, True), "INPUT_LOST_OR_ABSENT_AT_B2"),
    ((True, True, True, True, True, True, False), "INPUT_LOST_AT_B3"),
    ((True,) * 7, "LABEL_AND_INPUT_ALIGNED")])
def test_trace_classes(spark, flags, want):
    row = spark.range(1).select(audit.trace_class(*[F.lit(f) for f in flags]).alias("c")).first()
    assert row["c"] == want


def test_admissibility_rules(spark):
    rows = [("seen", 3, 0, 0, 0), ("clean", 0, 0, 0, 0), ("in_validation", 0, 0, 1, 0), ("in_test", 0, 0, 0, 2)]
    df = spark.createDataFrame(rows, "label string, train int, a int, b int, t int")

    def decide(downstream, sealed):
        out = audit.admissibility(df, F.col("train"), [F.col("a"), F.col("b")], F.col("t"), F.lit(downstream), F.lit(sealed))
        return {r["label"]: r["admissibility"] for r in out.collect()}

    assert decide(True, True) == {"seen": "INADMISSIBLE", "clean": "ADMISSIBLE", "in_validation": "NOT_ESTABLISHED", "in_test": "NOT_ESTABLISHED"}
    assert decide(False, True)["clean"] == decide(True, False)["clean"] == "NOT_ESTABLISHED"


def test_class_table_and_encoding(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string")
    classes = audit.class_table(train, "label")
    records = spark.createDataFrame([("a",), ("c",), (None,)], "label string")
    got = {r["label"]: (r["class_id"], r["known"]) for r in audit.encode_labels(records, "label", classes).collect()}
    assert got == {"a": (0, True), "c": (None, False), None: (None, False)}


def test_image_lookup_keeps_last_duplicate_and_order(spark):
    listings = spark.createDataFrame(
        [("l1", "i1", ["i2", "", "i9"]), ("l2", None, ["i1"]), ("l3", None, None)], "id string, main string, others array<string>")
    table = spark.createDataFrame(
        [("i1", 1, True, 0), ("i1", 5, True, 1), ("i2", 2, False, 2), ("i7", 3, True, 3)],
        "image_id string, height int, physical_file_available boolean, row_order int")
    inventory = images.last_per_key(table, "image_id", F.col("row_order"), ["height", "physical_file_available"])
    refs = images.explode_references(listings, "id", "main", "others")
    attached = images.attach_inventory(refs, inventory)
    counts = {r["id"]: tuple(r)[1:] for r in images.image_counts(attached, "id", "physical_file_available").collect()}
    assert counts == {"l1": (3, 1, 2, True, True), "l2": (1, 1, 0, False, False), "l3": (0, 0, 0, False, False)}
    claimed = {r["id"]: r["n"] for r in listings.select(
        "id", images.referenced_count(F.col("main"), F.col("others")).alias("n")).collect()}
    assert claimed == {"l1": 4, "l2": 1, "l3": 0}
    ref = images.image_reference(F.col("image_id"), F.col("metadata_available"), F.col("physical_file_available"),
                                 F.lit("p"), F.col("height"), F.col("height"))
    nested = {r["id"]: r for r in images.nest_references(attached, "id", ref).collect()}
    assert nested["l1"]["main_image"]["height"] == 5
    assert [o["image_id"] for o in nested["l1"]["other_images"]] == ["i2", "i9"]
    assert nested["l1"]["other_images"][1]["metadata_available"] is False and nested["l1"]["other_images"][1]["height"] is None
    assert nested["l2"]["main_image"] is None and [o["image_id"] for o in nested["l2"]["other_images"]] == ["i1"]
    assert nested["l3"]["other_images"] == []
    status = {r["image_id"]: r["status"] for r in images.reference_audit(refs, inventory).collect() if r["image_id"]}
    assert status["i7"] == "never_referenced" and status["i9"] == "referenced_without_metadata" and status["i1"] == "referenced_with_metadata"


DOCS = [(0, "red shoe red"), (1, "red hat"), (2, "blue shoe"), (3, "blue blue hat green"), (4, "red green")]


def grams(t, bigrams):
    w = t.split()
    return w + ([f"{a} {b}" for a, b in zip(w, w[1:])] if bigrams else [])


@pytest.mark.parametrize("bigrams, sublinear, min_df, cap", [(True, True, 2, None), (False, False, 1, None), (True, True, 1, 4)])
def test_tfidf_matches_brute_force(spark, bigrams, sublinear, min_df, cap):
    df = spark.createDataFrame(DOCS, "id int, t string")
    rows = textmodel.sparse_rows(df, "id", text.space_tokens(F.col("t")), bigrams)
    terms = textmodel.vocabulary(textmodel.exploded(rows.filter(F.col("id") < 4)), min_df, cap)
    got = {(r["id"], r["term"]): r["weight"] for r in textmodel.tfidf(rows, "id", terms, F.lit(4), sublinear).collect()}
    idf = textmodel.idf_table(terms, F.lit(4))
    parts = termparts.weigh(rows, idf, "idf", sublinear, per_part=2)
    assert {(r["id"], r["term"]): r["weight"] for r in textmodel.exploded(parts).collect()} == pytest.approx(got)
    assert parts.count() == 5
    df_count, total = Counter(), Counter()
    for i, t in DOCS[:4]:
        total.update(grams(t, bigrams))
        df_count.update(set(grams(t, bigrams)))
    vocab = [t for t in sorted(df_count, key=lambda t: (-total[t], t)) if df_count[t] >= min_df][:cap]
    want = {}
    for i, t in DOCS:
        raw = {}
        for term, n in Counter(grams(t, bigrams)).items():
            if term in vocab:
                raw[term] = (1 + math.log(n) if sublinear else n) * (math.log(5 / (1 + df_count[term])) + 1)
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want.update({(i, term): v / norm for term, v in raw.items()})
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k]) for k in want)


def test_naive_bayes_matches_brute_force(spark):
    labels = {0: "a", 1: "a", 2: "b", 3: "b", 4: "c"}
    rows = spark.createDataFrame([(i, t, labels[i]) for i, t in DOCS], "id int, t string, label string")
    counts = textmodel.term_counts(rows, "id", text.space_tokens(F.col("t")), keep=["label"])
    terms = textmodel.vocabulary(counts, 2)
    classes, weights = textmodel.fit_naive_bayes(counts, terms, rows, "label")
    targets = spark.createDataFrame([(10, "red red unseen"), (11, "green blue"), (12, "nothing known"), (13, "")], "id int, t string")
    target_rows = textmodel.sparse_rows(targets, "id", text.space_tokens(F.col("t")))
    model = textmodel.NaiveBayes(terms, classes, weights)
    scores = model.scores(target_rows, "id")
    got = {(r["id"], r["class"]): r["score"] for r in scores.collect()}

    vocab = {t for t, n in Counter(t for _, d in DOCS for t in set(d.split())).items() if n >= 2}
    for i, t in [(10, "red red unseen"), (11, "green blue"), (12, "nothing known"), (13, "")]:
        for c in "abc":
            mine = [w for j, d in DOCS if labels[j] == c for w in d.split() if w in vocab]
            score = math.log(sum(v == c for v in labels.values()) / 5)
            for w in t.split():
                if w in vocab:
                    score += math.log((mine.count(w) + 1) / (len(mine) + len(vocab)))
            assert math.isclose(got[(i, c)], score, rel_tol=1e-9), (i, c)
    assert len(got) == 12
    best = {r["id"]: r["pred"] for r in model.predict(target_rows, "id").collect()}
    assert best[10] == "a" and best[13] == "a"
    total = scores.groupBy("id").agg(F.sum("probability").alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0) for r in total)


def test_naive_bayes_prediction_for_many_classes(spark):
    import random

    rng = random.Random(4)
    rows = [(i, f"c{rng.randrange(300):03d}", " ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randint(0, 9)))) for i in range(900)]
    docs = spark.createDataFrame(rows, "id long, cls string, text string").cache()
    rows = textmodel.sparse_rows(docs, "id", F.array_remove(F.split("text", " "), ""), keep=["cls"]).cache()
    counts = textmodel.exploded(rows)
    terms = textmodel.vocabulary(counts, 2)
    classes, weights = textmodel.fit_naive_bayes(counts, terms, docs, "cls")
    whole, parts = textmodel.NaiveBayes(terms, classes, weights), textmodel.NaiveBayes(terms, classes, weights, per_part=50)
    assert len(whole.parts) == 1 and len(parts.parts) > 20
    got = {r["id"]: (r["pred"], round(r["score"], 9)) for r in whole.predict(rows, "id").collect()}
    assert got == {r["id"]: (r["pred"], round(r["score"], 9)) for r in parts.predict(rows, "id").collect()}
    every = parts.scores(rows, "id").collect()
    want = {}
    for r in every:
        want[r["id"]] = min(want.get(r["id"], (1e9,)), (-r["score"], r["class"]))
    assert got == {i: (c, round(-z, 9)) for i, (z, c) in want.items()} and len(got) == 900
    # Model parts meet the records where they lie.
    assert "Exchange" not in whole.fold(rows.select("id", "terms"))._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


@pytest.mark.parametrize("most", [1, 40, 101, 400])
def test_vocabulary_cap_keeps_the_most_frequent(spark, monkeypatch, most):
    import random

    monkeypatch.setattr(textmodel, "HISTOGRAM", 8)
    rng = random.Random(most)
    rows = [(f"{rng.choice(['a', 'é', 'zz', ''])}{i}", rng.choice([1, 1, 1, 2, 2, 3, 50, 51, 900, 10**7])) for i in range(300)]
    df = spark.createDataFrame(rows, "term string, total_tf long").repartition(3)
    want = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:most]
    kept = textmodel.most_frequent(df, "total_tf", "term", most)
    assert sorted(map(tuple, kept.collect())) == sorted(want)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert textmodel.most_frequent(df.limit(0), "total_tf", "term", most).count() == 0


def test_pieces_of_batches_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(termparts, "ENTRIES", 10)
    lists = [[1] * n for n in (3, 3, 30, 0, 0, 1)] + [[]] * 25 + [None, [1, 2]]
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[i:i + 20], pa.list_(pa.int64()))], ["x"]) for i in (0, 20)]
    pieces = list(termparts.gathered(iter(batches), "x"))
    assert [v for p in pieces for v in p.column("x").to_pylist()] == lists
    sizes = [sum(len(v or []) + 1 for v in p.column("x").to_pylist()) for p in pieces]
    assert all(size <= 10 or len(p) == 1 for size, p in zip(sizes, pieces)) and len(pieces) < len(lists) / 2


def test_counts_of_terms_equal_a_counter(spark):
    from collections import Counter

    texts = [(1, "a b a b a"), (2, None), (3, ""), (4, "\u00e4 z Z"), (4, "b")]
    df = spark.createDataFrame(texts, "id long, t string")
    rows = textmodel.sparse_rows(df, "id", text.space_tokens(F.col("t")), True)
    want = []
    for i, t in texts:
        words = (t or "").split()
        counts = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
        want.append((i, sorted(counts.items(), key=lambda x: x[0].encode()) or None))
    assert sorted(((r["id"], r["terms"] and [tuple(e) for e in r["terms"]]) for r in rows.collect()), key=str) == sorted(want, key=str)
    totals = {tuple(r) for r in textmodel.vocabulary(rows).collect()}
    assert totals == {tuple(r) for r in textmodel.vocabulary(textmodel.exploded(rows)).collect()} and ("a", 1, 3) in totals and ("b", 2, 3) in totals


def test_large_tables_are_exchanged_and_written_once(spark, monkeypatch):
    """A vocabulary of many parts is neither sent through the driver nor are the rows written again for each part."""
    df = spark.createDataFrame([(i, f"w{i % 50} w{i % 7} same") for i in range(400)], "id long, t string").repartition(3)
    rows = textmodel.sparse_rows(df, "id", text.space_tokens(F.col("t")), True).cache()
    terms = textmodel.vocabulary(rows, 1).cache()
    whole = {r["id"]: r["terms"] for r in textmodel.tfidf_rows(rows, terms, F.lit(400), True).collect()}
    monkeypatch.setattr(termparts, "PART_TERMS", 5)
    monkeypatch.setattr(termparts, "PACKED", 60)
    monkeypatch.setattr(termparts, "BUCKET_ROWS", 10)
    sent, collect = [], type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda self: sent.append(collect(self)) or sent[-1])
    parts = textmodel.tfidf_rows(rows, terms, F.lit(400), True)
    got = {r["id"]: r["terms"] for r in parts.collect()}
    assert got.keys() == whole.keys() and terms.count() > 50
    for i, entries in whole.items():
        assert [e["term"] for e in got[i]] == [e["term"] for e in entries]
        assert [e["weight"] for e in got[i]] == pytest.approx([e["weight"] for e in entries])
    assert sum(len(t) for t in sent) <= 5
    assert "BroadcastHashJoin" not in parts._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shipped", [True, False])
def test_tokens_are_counted_and_weighed_in_one_worker(spark, tmp_path, monkeypatch, shipped):
    """A second Python step in a task would keep a second worker with its own batches and copies of them."""
    from catalumen.plans import texts

    documents = [(i, f"w{i % 50} w{i % 7} same same") for i in range(400)] + [(400, None), (401, "")]
    spark.createDataFrame(documents, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    if not shipped:
        monkeypatch.setattr(termparts, "PART_TERMS", 5)
        monkeypatch.setattr(termparts, "PACKED", 60)
        monkeypatch.setattr(termparts, "BUCKET_ROWS", 10)
    plans, write = [], textmodel.cut_lineage
    monkeypatch.setattr(textmodel, "cut_lineage", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    got = texts.tfidf_weights(spark, str(tmp_path), "tfidf_unigrams")
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert plans[0].count("MapInArrow") == 1
    assert not shipped or plans[-1].count("MapInArrow") == 1
    rows = textmodel.sparse_rows(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", texts.tokens_for("tfidf_unigrams"))
    train = rows.filter(texts.split_of("doc_id") == "train").cache()
    monkeypatch.undo()
    want = textmodel.tfidf_rows(rows, textmodel.vocabulary(train, 2).cache(), F.lit(train.count()), False)
    want = {r["doc_id"]: [tuple(e) for e in r["terms"]] for r in want.collect()}
    assert {r["doc_id"]: [tuple(e) for e in r["terms"]] for r in got.collect()} == want and sum(map(len, want.values())) > 800


def test_texts_are_tokenised_once(spark, tmp_path, monkeypatch):
    """Packs of coded words are written; neither the look-up nor the weights read a text again."""
    from catalumen.plans import texts

    documents = [(i, f"W{i % 50} w{i % 7}, same same") for i in range(400)] + [(400, None), (401, "")]
    spark.createDataFrame(documents, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name, value in (("PART_TERMS", 5), ("PACKED", 60), ("BUCKET_ROWS", 10), ("MERGED", 20)):
        monkeypatch.setattr(termparts, name, value, raising=False)
    got = texts.tfidf_weights(spark, str(tmp_path), "tfidf_bigrams")
    assert "regexp_extract_all" not in got._jdf.queryExecution().executedPlan().toString()
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in documents}
    grams = {i: Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]) for i, w in words.items()}
    train = {r["doc_id"] for r in spark.range(402).select(F.col("id").alias("doc_id")).filter(texts.split_of("doc_id") == "train").collect()}
    df = Counter(t for i in train for t in grams[i])
    for r in got.collect():
        want = {t: (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df[t])) + 1) for t, n in grams[r["doc_id"]].items() if df[t] > 1}
        length = math.sqrt(sum(w * w for w in want.values()))
        assert [e["term"] for e in r["terms"]] == sorted(want)
        assert [e["weight"] for e in r["terms"]] == pytest.approx([want[t] / length for t in sorted(want)])
    alone = texts.tfidf_weights(spark, str(tmp_path), "tfidf_bigrams", names=False).collect()
    assert {r["doc_id"]: [e[0] for e in r["terms"]] for r in alone} == {r["doc_id"]: [e[1] for e in r["terms"]] for r in got.collect()}


def test_a_bucket_answers_many_packs_with_one_look_up(monkeypatch):
    """A look-up for each pack builds a table of the bucket's terms each time: packs times terms."""
    import pyarrow as pa

    terms = [f"t{i}" for i in range(200)]
    block = termparts._blob(pa.table({"term": pa.array(terms + terms[:5]), "n": pa.array(range(205))}))
    wanted = {f"p{i}": [f"t{i}", "unknown", f"t{199 - i}"] for i in range(100)}
    asked = pa.table({"bucket": pa.array([3] * 100, pa.int32()), "pack": pa.array([*wanted]),
                      "asked": pa.array([termparts._blob(pa.table({"term": w})) for w in wanted.values()], pa.binary())})
    calls, index_in = [], termparts.pc.index_in
    monkeypatch.setattr(termparts.pc, "index_in", lambda *a, **k: calls.append(1) or index_in(*a, **k))
    found = termparts.answered(pa.table({"bucket": pa.array([3], pa.int32()), "block": pa.array([block], pa.binary())}), asked)
    assert len(calls) == 1 and set(found.column("bucket").to_pylist()) == {3}
    for name, blob in zip(found.column("pack").to_pylist(), found.column("found").to_pylist()):
        rows = termparts._table(blob).to_pylist()
        want = [(at, n) for at, t in enumerate(wanted[name]) for n, own in enumerate(terms + terms[:5]) if own == t]
        assert sorted((r["__at"], r["n"]) for r in rows) == want
    assert found.column("pack").to_pylist() == [*wanted]


@pytest.mark.parametrize("words", [["a", "b", "ab", "a", "b"], ["a b", "c", "a", "b c", "", "\x01", "a b", "c"]])
def test_word_pairs_are_counted_as_texts(words):
    """Words with blanks or bytes below them make pairs that are spelled like others, or sort before the word."""
    import pyarrow as pa

    lists = [words, None, [], words[::-1], ["z"]]
    batch = pa.record_batch({"id": pa.array(range(5)), "terms": pa.array(lists, pa.list_(pa.string()))})
    for given in (batch, termparts.recoded(batch, "terms")):
        got = textmodel.counted(given, True).column("terms").to_pylist()
        for r, own in zip(got, lists):
            want = Counter([*(own or []), *(f"{a} {b}" for a, b in zip(own or [], (own or [])[1:]))])
            assert (r and [(e["term"], e["tf"]) for e in r]) == (sorted(want.items(), key=lambda x: x[0].encode()) or None)


def test_buckets_of_terms_are_even_whatever_their_length():
    import numpy as np
    import pyarrow as pa

    for size in (1, 3, 8, 9, 16, 17, 24, 32, 60):
        terms = pa.array(sorted({f"{i * 7919:x}".rjust(size, "_")[-size:] for i in range(40_000)}))
        held = np.bincount(termparts._buckets(terms, 8), minlength=8)
        assert size < 3 or held.max() < 1.5 * held.mean()
        assert (termparts._buckets(terms.slice(5), 8) == termparts._buckets(terms, 8)[5:]).all()


def test_terms_are_counted_by_a_column_of_their_records(spark, monkeypatch):
    """Pairs of a term and a class are counted in packs, not as a row for each record and term."""
    from functools import partial

    monkeypatch.setattr(termparts, "PACKED", 40)
    monkeypatch.setattr(termparts, "MERGED", 30)
    docs = [(i, ["x", "y", None][i % 3], f"w{i % 9} w{i % 4} w{i % 4}" if i % 7 else None, "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(docs, "id long, label string, t string, side string").repartition(3)
    packs = termparts.Packs(df.select("id", "label", "side", text.space_tokens(F.col("t")).alias("terms")), made=partial(textmodel.counted, with_bigrams=False))
    own = [(label, t) for _, label, t, side in docs if side == "a" and t]
    tf = Counter((w, label) for label, t in own for w in t.split())
    df = Counter((w, label) for label, t in own for w in set(t.split()))
    got = {(r["term"], r["label"]): (r["df"], r["total_tf"]) for r in termparts.term_totals(packs.where("side", "a"), "label").collect()}
    assert got == {k: (df[k], n) for k, n in tf.items()}
    alone = {r["term"]: r["total_tf"] for r in textmodel.vocabulary(packs.where("side", "a")).collect()}
    assert alone == Counter(w for _, t in own for w in t.split())


def test_long_terms_are_not_shipped(spark, monkeypatch):
    """Few rows can hold much text: the driver's share is bounded in bytes as well."""
    df = spark.createDataFrame([(i, " ".join(f"{j % 10}" * 40 for j in range(i, i + 3))) for i in range(30)], "id long, t string").repartition(2)
    rows = textmodel.sparse_rows(df, "id", text.space_tokens(F.col("t"))).cache()
    terms = textmodel.vocabulary(rows, 1).cache()
    whole = {r["id"]: r["terms"] for r in textmodel.tfidf_rows(rows, terms, F.lit(30), False).collect()}
    monkeypatch.setattr(termparts, "PART_BYTES", 300, raising=False)
    sent, collect = [], type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda self: sent.append(collect(self)) or sent[-1])
    assert {r["id"]: r["terms"] for r in textmodel.tfidf_rows(rows, terms, F.lit(30), False).collect()} == whole
    assert terms.count() == 10 and not sum(map(len, sent))


def test_vocabulary_of_naive_bayes_is_not_broadcast(spark, monkeypatch):
    """A broadcast goes through the driver, and grows with the vocabulary until Spark gives it up."""
    df = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} v{i}", "ab"[i % 2]) for i in range(40)], "id long, t string, label string")
    plans, write = [], textmodel.cut_lineage
    counts = textmodel.term_counts(df, "id", text.space_tokens(F.col("t")), keep=["label"]).cache()
    terms = write(textmodel.vocabulary(counts, 2))

    def plan(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return frame

    monkeypatch.setattr(textmodel, "cut_lineage", lambda df, *a: write(plan(df), *a))
    classes, weights = textmodel.fit_naive_bayes(counts, terms, df, "label")
    plan(weights)
    assert any("Join" in p for p in plans) and not any("BroadcastHashJoin" in p and "LeftSemi" in p for p in plans)
    got = {(r["class"], r["term"]): r["weight"] for r in weights.collect()}
    seen = Counter((label, w) for _, t, label in df.collect() for w in t.split())
    known = {r["term"] for r in terms.collect()}
    assert got == pytest.approx({k: math.log(n + 1) for k, n in seen.items() if k[1] in known})
    assert {r["class"] for r in classes.collect()} == {"a", "b"}
