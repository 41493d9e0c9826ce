from __future__ import annotations

import hashlib
import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalumen.functions import identity, text
from catalumen.operators import profile, ranking

TITLES = [
    "plain title", "  two  spaces\tand\ttabs ", "line\nbreak\r\nhere", "no break wide　gap",
    "unit\x1fsep\x1cfile", "bad � char", "abc", "", "   ", " ", "MiXeD Case_1 2x", "naïve café ÜBER",
]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, t string")


def test_spaces_match_python_split(spark):
    rows = frame(spark, TITLES).select("t", text.squeeze_spaces(F.col("t")).alias("s"),
                                       text.space_tokens(F.col("t")).alias("w")).collect()
    for row in rows:
        assert row["s"] == " ".join(row["t"].split())
        assert row["w"] == row["t"].split()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \t\n\x0b\x1c\x1f\x85  　é_9-"))), min_size=1, max_size=20))
def test_spaces_property(spark, values):
    rows = frame(spark, values).select("id", text.space_tokens(F.col("t")).alias("w")).collect()
    for row in rows:
        assert row["w"] == values[row["id"]].split()


def test_missing_text_has_no_tokens(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(text.space_tokens(F.col("t")).alias("w")).first()["w"] == []


def test_word_tokens(spark):
    import re
    rows = frame(spark, TITLES).select("t", text.word_tokens(F.col("t")).alias("w")).collect()
    for row in rows:
        assert row["w"] == re.findall(r"\w+", row["t"].lower())


def test_title_flags(spark):
    rows = {r["t"]: r for r in frame(spark, TITLES).select("t", text.title_flags(F.col("t")).alias("f")).select("t", "f.*").collect()}
    assert rows["bad � char"]["has_replacement"] and not rows["plain title"]["has_replacement"]
    assert rows["abc"]["is_short"] and rows["   "]["is_short"] and not rows["plain title"]["is_short"]
    assert rows["unit\x1fsep\x1cfile"]["is_changed"] and not rows["plain title"]["is_changed"]


def test_field_block_skips_empty_fields_and_keeps_order(spark):
    df = spark.createDataFrame([("b c", None, " a "), ("", "  ", None)], "x string, y string, z string")
    block = text.field_token_block({"z": F.col("z"), "y": F.col("y"), "x": F.col("x")})
    first, second = [r["b"] for r in df.select(block.alias("b")).collect()]
    assert first["combined_tokens"] == ["a", "b", "c"] and first["present_text_fields"] == ["z", "x"]
    assert first["field_tokens"] == {"z": ["a"], "x": ["b", "c"]} and first["token_count"] == 3
    assert second["combined_tokens"] == [] and second["present_text_fields"] == []


@pytest.mark.parametrize("n", [0, 1, 253, 254, 255, 508, 509])
def test_chunks_lose_nothing(spark, n):
    tokens = [f"t{i}" for i in range(n)]
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    row = df.select(text.chunks(F.col("t")).alias("c"), text.chunk_count(F.size("t")).alias("n")).first()
    assert [t for c in row["c"] for t in c] == tokens
    assert len(row["c"]) == row["n"] == max(1, math.ceil(n / 254))
    assert all(len(c) == 254 for c in row["c"][:-1])


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r["b"] for r in df.select(text.bigrams(F.col("t")).alias("b")).collect()] == [["a b", "b c"], [], []]


def test_bucket_is_the_unsigned_head_of_the_digest(spark):
    rows = spark.range(500).select("id", identity.bucket(F.col("id")).alias("b")).collect()
    for row in rows:
        digest = hashlib.sha256(f"{identity.SPLIT_SEED}|{row['id']}".encode()).hexdigest()
        assert row["b"] == int(digest[:16], 16) % 100_000


def test_record_id_with_missing_part(spark):
    df = spark.createDataFrame([(7, "i1", None)], "n int, item string, domain string")
    made = df.select(identity.record_id("listing", F.col("n"), F.col("item"), F.col("domain")).alias("r")).first()["r"]
    assert made == "listing:" + hashlib.sha256(b"7|i1|").hexdigest()[:16]


def test_content_hash_ignores_column_order(spark):
    df = spark.createDataFrame([(1, None, "x")], "b int, a string, c string")
    one = identity.content_hash({c: F.col(c) for c in "abc"})
    two = identity.content_hash({c: F.col(c) for c in "cba"})
    row = df.select(one.alias("x"), two.alias("y")).first()
    payload = json.dumps({"a": None, "b": 1, "c": "x"}, separators=(",", ":"), sort_keys=True)
    assert row["x"] == row["y"] == hashlib.sha256(payload.encode()).hexdigest()


def test_fingerprint_ignores_order_but_not_content(spark):
    values = [(i, f"l{i % 3}") for i in range(200)]
    random.Random(1).shuffle(values)
    views = {"ids": ["k"], "labels": ["l"]}

    def prints(rows, parts):
        df = spark.createDataFrame(rows, "k long, l string").repartition(parts)
        return {r["view"]: (r["records"], r["fingerprint"]) for r in profile.population_fingerprints(df, views).collect()}

    base = prints(sorted(values), 1)
    assert prints(values, 7) == base
    changed = prints([(k if k else 999, l) for k, l in values], 3)
    assert changed["ids"] != base["ids"] and changed["labels"] == base["labels"]
    assert prints(values + values[:1], 2)["labels"] != base["labels"]


def test_rank_by_number_is_dense(spark):
    keys = random.Random(3).sample(range(10**6), 3_000)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    ranks = {r["k"]: r["row_index"] for r in ranking.rank_by_number(df, "k").collect()}
    assert ranks == {k: i for i, k in enumerate(sorted(keys))}


def test_permutation_is_complete_repeatable_and_seeded(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(300)], "k long, v string")
    one = {r["k"]: r["v"] for r in ranking.permute_column(df, "k", "v", "s1").collect()}
    two = {r["k"]: r["v"] for r in ranking.permute_column(df.repartition(7), "k", "v", "s1").collect()}
    other = {r["k"]: r["v"] for r in ranking.permute_column(df, "k", "v", "s2").collect()}
    assert one == two != other
    assert sorted(one.values()) == sorted(f"v{i}" for i in range(300))
    order = sorted(range(300), key=lambda i: hashlib.sha256(f"s1|{i}".encode()).hexdigest())
    assert one == {i: f"v{order[i]}" for i in range(300)}


@pytest.mark.parametrize("hot_share", [0.0, 0.4])
def test_exact_percentiles_match_numpy(spark, hot_share):
    import numpy as np

    rng = np.random.default_rng(5)
    values = rng.normal(size=2_001)
    values[: int(hot_share * len(values))] = 0.5
    df = spark.createDataFrame([("x", float(v)) for v in values] + [("y", 3.0)], "g string, v double")
    fractions = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
    rows = {r["g"]: r for r in profile.describe(df, "g", "v", fractions).collect()}
    assert np.allclose(rows["x"]["percentiles"], np.quantile(values, fractions))
    assert math.isclose(rows["x"]["std"], values.std()) and math.isclose(rows["x"]["mean"], values.mean())
    assert rows["y"]["percentiles"] == [3.0] * len(fractions) and rows["y"]["std"] == 0


def test_nearest_to_targets_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(2, 10), (1, 14), (3, 30)], "k long, n int")
    rows = {r["target"]: r["k"] for r in profile.nearest_to_targets(df, "k", "n", (12, 100)).collect()}
    assert rows == {12: 1, 100: 3}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "zz", "_1"]), max_size=40), min_size=1, max_size=8))
def test_terms_are_counted_inside_the_row(spark, documents):
    from collections import Counter

    df = spark.createDataFrame(list(enumerate(documents)), "id int, t array<string>")
    for row in df.select("id", text.count_terms(F.col("t")).alias("c")).collect():
        assert {c["term"]: c["tf"] for c in row["c"] or []} == Counter(documents[row["id"]])
