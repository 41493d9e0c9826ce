from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from catalumen.operators import components, joins


def skewed(spark, n=4_000, seed=1):
    """A third of the rows share one key; some keys are null, some have no match."""
    rng = random.Random(seed)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(200)}") for i in range(n)]
    right = [("hot", 1)] + [(f"k{i}", i) for i in range(0, 200, 2)]
    return spark.createDataFrame(rows, "id long, k string"), spark.createDataFrame(right, "k string, v long")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    left, right = skewed(spark)
    want = sorted(map(tuple, left.join(right, ["k"], how).select("id", "k", *(["v"] if how in ("left", "inner") else [])).collect()))
    got = joins.join_spread(left, right, ["k"], how, max_hot=20)
    assert sorted(map(tuple, got.select("id", "k", *(["v"] if how in ("left", "inner") else [])).collect())) == want


def test_hot_keys_are_few_and_get_salts_by_size(spark):
    left, _ = skewed(spark)
    hot = {r["k"]: r["__salts"] for r in joins.hot_keys(left, ["k"], 20).collect()}
    assert len(hot) <= 20 and hot["hot"] >= 5


def test_hot_rows_reach_many_tasks(spark):
    left, right = skewed(spark, 30_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.join_spread(left, right, ["k"], "inner", max_hot=1_000)
        sizes = [r["n"] for r in joined.filter(F.col("k") == "hot").groupBy(F.spark_partition_id()).agg(
            F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_one_to_one_check(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, b string")
    assert joins.assert_one_to_one(a, b, "k").count() == 2
    plan = joins.assert_one_to_one(a, b, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    for bad in ([(1, "p")], [(1, "p"), (2, "q"), (2, "r")], [(1, "p"), (2, "q"), (3, "r")], [(1, "p"), (2, "q"), (None, "r")]):
        with pytest.raises(Exception, match="one to one"):
            joins.assert_one_to_one(a, spark.createDataFrame(bad, "k int, b string"), "k").collect()


def union_find(records, refs):
    parent = {r: r for r in records}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    owner = {}
    for r, item in refs:
        a, b = find(r), find(owner.setdefault(item, r))
        parent[max(a, b)] = min(a, b)
    return {r: find(r) for r in records}


GRAPHS = {
    "chain": [(i, f"e{i}") for i in range(60)] + [(i + 1, f"e{i}") for i in range(59)],
    "hot_item": [(i, "all") for i in range(0, 90)] + [(i, f"own{i}") for i in range(100)],
    "random": [(random.Random(4).randrange(120), "x")] + [
        (a, f"i{b}") for a, b in ((random.Random(s).randrange(120), random.Random(s + 999).randrange(90)) for s in range(130))],
    "no_references": [],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("salted", [False, True])
def test_components_match_union_find(spark, name, salted, monkeypatch):
    if salted:
        monkeypatch.setattr(components, "ONE_TASK_EDGES", 0)
    ids = list(range(125))
    refs = GRAPHS[name]
    records = spark.createDataFrame([(i,) for i in ids], "r long")
    references = spark.createDataFrame(refs, "r long, item string")
    got = {x["r"]: x["component"] for x in components.connected_components(records, references, "r", "item").collect()}
    assert got == union_find(ids, refs)


def bucket_split(key):
    b = int(hashlib.sha256(f"phase-a-split-v001|{key}".encode()).hexdigest()[:16], 16) % 100_000
    return "train" if b < 80_000 else "validation" if b < 90_000 else "test"


def component_key(ids):
    digests = [hashlib.sha256(i.encode()).hexdigest() for i in ids]
    lanes = [str(sum(int(d[a:a + 15], 16) for d in digests)) for a in (0, 15)]
    return "component|" + hashlib.sha256("|".join([str(len(ids)), *lanes]).encode()).hexdigest()


def test_component_split_uses_a_fingerprint_of_the_ids(spark):
    ids = list(range(1, 30))
    refs = [(i, f"m{i % 4}") for i in ids if i % 2]
    records = spark.createDataFrame([(i,) for i in ids], "r long")
    references = spark.createDataFrame(refs, "r long, item string")
    rows = components.component_split(records, references, "r", "item").collect()
    members = defaultdict(list)
    for r, c in union_find(ids, refs).items():
        members[c].append(str(r))
    for row in rows:
        ids_of = sorted(members[row["component"]])
        assert row["size"] == len(ids_of)
        assert row["split"] == bucket_split(component_key(ids_of))


def test_components_of_any_size_have_one_key_rule(spark):
    members = spark.range(3000).selectExpr("id as r", "if(id < 2990, 0, id) as component")
    keys = {r["component"]: (r["size"], r["component_key"]) for r in components.component_keys(members, "r").collect()}
    again = {r["component"]: (r["size"], r["component_key"]) for r in components.component_keys(members.repartition(7), "r").collect()}
    assert keys == again and len(keys) == 11
    assert keys[0] == (2990, component_key([str(i) for i in range(2990)])) and keys[2999] == (1, component_key(["2999"]))


def test_leakage_and_overlap(spark):
    rows = [("a", "train"), ("a", "train"), ("b", "train"), ("b", "test"), ("c", "test"), ("d", "train"), ("d", "validation"), ("d", "test")]
    df = spark.createDataFrame(rows, "k string, split string")
    per_key = {r["key"]: (r["n_splits"], r["n_rows"], r["n_repeats_within"]) for r in components.leaking_keys(df, "k").collect()}
    assert per_key == {"a": (1, 2, 1), "b": (2, 2, 0), "c": (1, 1, 0), "d": (3, 3, 0)}
    pairs = {(r["split_a"], r["split_b"]): (r["shared_keys"], r["first_example"]) for r in components.split_overlap(df, "k").collect()}
    assert pairs == {("test", "train"): (2, "b"), ("test", "validation"): (1, "d"), ("train", "validation"): (1, "d")}


def test_lookup_gives_the_same_rows_either_way(spark):
    left, right = skewed(spark)
    small = sorted(map(tuple, joins.lookup(left, right, ["k"]).select("id", "v").collect()), key=str)
    large = sorted(map(tuple, joins.lookup(left, right, ["k"], max_rows=5).select("id", "v").collect()), key=str)
    assert small == large and len(small) == left.count()
