"""Split tables, areas under curves, path distances, structure blocks and totals over several batches, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalumen.functions import jsontext, paths
from catalumen.operators import areas, ranking, taxonomy
from catalumen.session import refuse_local_folder
from catalumen.sources import bundles, sinks
from catalumen.streaming import incremental


def folders_listed(frame):
    """Folders that the scan of a frame without a shuffle opens, by its own metric."""
    plan = frame._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().head().metrics().apply("numPartitions").value()


def test_a_split_is_read_without_the_others(spark, tmp_path):
    df = spark.range(3_000).select("id", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    path = str(tmp_path / "t")
    sinks.write_by_split(df, path, order=["id"], files_per_split=6)
    one = sinks.read_splits(spark, path, ["test"])
    assert one.count() == 1_000 and folders_listed(one) == 1
    assert folders_listed(sinks.read_splits(spark, path, ["test", "train"])) == 2 and folders_listed(spark.read.parquet(path)) == 3
    listed = spark.createDataFrame([("train", 0), ("test", 1)], "split string, held_out int")
    chosen = sinks.read_chosen(spark, path, listed.filter("held_out = 1"))
    assert sorted(r["id"] for r in chosen.collect()) == list(range(2, 3_000, 3))
    assert "dynamicpruning" in chosen._jdf.queryExecution().toString().lower()
    # Each file holds a range of its own, in order.
    ranges = {}
    for r in spark.read.parquet(path).select("id", F.input_file_name().alias("f"), "split").collect():
        ranges.setdefault((r["split"], r["f"]), []).append(r["id"])
    assert all(v == sorted(v) for v in ranges.values())
    for split in ("train", "validation", "test"):
        ends = sorted((v[0], v[-1]) for (s, _), v in ranges.items() if s == split)
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_local_folders_are_refused_on_a_cluster():
    for scheme, master in (("file", "local[8]"), ("file", "local"), ("hdfs", "yarn"), ("s3a", "spark://host:7077")):
        refuse_local_folder(scheme, master)
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            refuse_local_folder("file", master)


def test_matrix_report(spark):
    rows = [("a", "train", [0.5, 0.5]), ("b", "train", [0.9, 0.9]), ("c", "test", [1.0]), ("a", "test", [0.5, 0.5])]
    report = bundles.matrix_report(spark.createDataFrame(rows, "id string, split string, p array<double>"), "id", {"p": 2}, "split", {"train": 2, "test": 1})
    assert {(r["check"], r["observed"], r["expected"], r["passed"]) for r in report.collect()} == {
        ("rows:train", 2, 2, True), ("rows:test", 2, 1, False), ("p:row_sum", 1, 0, False), ("p:wrong_width", 1, 0, False),
        ("id:repeated_id", 1, 0, False), ("ids_in_two_splits", 1, 0, False)}


@pytest.mark.parametrize("ties", [3, 40, 10_000])
def test_areas_with_ties(spark, ties):
    rng = np.random.default_rng(ties)
    s = np.round(rng.random(700) * ties) / ties
    y = rng.random(700) < 0.3 + 0.4 * s
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)] + [(None, True), (0.5, None)], "s double, y boolean").repartition(5)
    got = areas.ranking_areas(df, "s", "y").first()
    pos, neg = s[y], s[~y]
    auroc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg)
    auprc = np.mean([y[s >= v].mean() for v in pos])
    aurc = np.mean([(~y[s >= v]).mean() for v in s])
    assert (got["records"], got["positives"]) == (700, int(y.sum()))
    assert [got[c] for c in ("auroc", "auprc", "aurc")] == pytest.approx([auroc, auprc, aurc])
    # No window runs over all scores at once: the only one without a key is over ranges.
    plan = areas.running_counts(areas.counted_scores(df, "s", "y"))._jdf.queryExecution().optimizedPlan().toString()
    assert all("__range" in line for line in plan.splitlines() if "Window" in line)


def test_areas_without_a_class(spark):
    df = spark.createDataFrame([(0.1, True), (0.2, True)], "s double, y boolean")
    row = areas.ranking_areas(df, "s", "y").first()
    assert (row["auroc"], row["auprc"], row["aurc"]) == (None, 1.0, 0.0)
    row = areas.ranking_areas(df.limit(0), "s", "y").first()
    assert row["records"] == 0 and row["auroc"] is row["auprc"] is row["aurc"] is None


def test_hierarchical_metrics(spark):
    rng = random.Random(2)
    rows = [(">".join(rng.choice("12") for _ in range(rng.randint(1, 4))), None if i % 9 == 0 else ">".join(rng.choice("12") for _ in range(rng.randint(1, 4)))) for i in range(200)]
    df = spark.createDataFrame(rows, "t string, p string")

    def common(a, b):
        n = 0
        for x, y in zip(a, b or []):
            if x != y:
                break
            n += 1
        return n

    split = [(t.split(">"), p and p.split(">")) for t, p in rows]
    c = sum(common(t, p) for t, p in split)
    d, g = sum(len(t) for t, _ in split), sum(len(p or []) for _, p in split)
    far = [len(t) + len(p) - 2 * common(t, p) for t, p in split if p]
    row = taxonomy.hierarchical_metrics(df, "t", "p").first()
    assert [row[k] for k in ("records", "precision", "recall", "f1", "mean_distance")] == pytest.approx([200, c / g, c / d, 2 * c / (g + d), np.mean(far)])
    depth = [r["c"] for r in df.select(paths.common_depth(F.col("t"), F.col("p")).alias("c")).collect()]
    assert depth == [common(t, p) for t, p in split]


def test_structure_block(spark):
    raw = '{"a":"x","b":"","c":[],"d":[1],"e":{},"f":2,"g":2.5,"h":true,"i":null,"j k":"y"}'
    fields = ("a", "b", "c", "d", "e", "f", "g", "h", "i", "j k", "z")
    df = spark.createDataFrame([(raw,), ("{}",)], "raw string").withColumn("v", F.parse_json("raw"))
    listing, attribute = (df.select(jsontext.structure_block(F.col("v"), fields, flag).alias("b")).select("b.*").collect() for flag in (True, False))
    assert listing[0]["field_types"] == dict(zip(fields, ["str", "str", "list", "list", "dict", "int", "float", "bool", "missing", "str", "missing"]))
    assert {f for f, there in listing[0]["field_presence"].items() if there} == {"a", "b", "d", "e", "f", "g", "h", "j k"}
    assert {f for f, there in attribute[0]["field_presence"].items() if there} == {"a", "d", "f", "g", "h", "j k"}
    assert set(listing[1]["field_presence"].values()) == {False} and set(listing[1]["field_types"].values()) == {"missing"}


def test_permutation_report(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 1)], "k int, d int")
    assert tuple(ranking.permutation_report(df, "k", "d").first()) == (4, 3, False, 1)
    assert tuple(ranking.permutation_report(df.limit(0), "k", "d").first()) == (0, 0, True, 0)


def test_totals_go_on_after_a_restart(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame(rows, "id long, who string, raw string, value double").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = incremental.file_stream(spark, source, "id long, who string, raw string, value double", files_per_batch=1)
        incremental.run_to_end(incremental.running_totals(stream, "id", "who", "raw", "value", sink))
        return {r["group"]: (r["records"], r["malformed"], r["total"], r["batches"]) for r in incremental.latest_totals(spark, sink).collect()}

    arrive([(1, "a", "{}", 1.0), (2, "b", "{", None)])
    arrive([(3, "a", "{}", 2.0), (1, "a", "{}", 1.0)])
    before = spark.conf.get(incremental.STATE_STORE)
    assert run() == {"a": (2, 0, 3.0, 2), "b": (1, 1, 0.0, 1)}
    arrive([(4, "a", "x", 4.0), (2, "b", "{", 9.0)])
    assert run() == {"a": (3, 1, 7.0, 3), "b": (1, 1, 0.0, 1)} == run()
    assert spark.conf.get(incremental.STATE_STORE) == before


def test_totals_are_kept_without_a_call_for_each_group(spark, tmp_path):
    schema = "id long, who string, raw string, value double"
    spark.createDataFrame([(1, "a", "{}", 1.0), (2, "a", "{}", float("nan")), (3, None, None, 2.0), (3, None, None, 2.0)], schema).write.parquet(str(tmp_path / "in"))
    query = incremental.running_totals(
        incremental.file_stream(spark, str(tmp_path / "in"), schema), "id", "who", "raw", "value", str(tmp_path / "out"))
    incremental.run_to_end(query)
    operators = {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]}
    assert operators == {"dedupe", "stateStoreSave"}
    got = {r["group"]: (r["records"], r["malformed"], r["total"], r["batches"]) for r in incremental.latest_totals(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": (2, 0, 1.0, 1), None: (1, 1, 2.0, 1)}


def test_content_of_variants_equals_that_of_json(spark):
    values = ['"x"', '""', '" \\u2003\\u001c"', '"\\u200b"', "0", "1.5", "1e300", "false", "null", "[]", "[null]", '["a"]', '[[" "]]', "{}", '{"a":null}', '{"a":[0]}', None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string").withColumn("v", F.try_parse_json("raw"))
    rows = df.select("raw", jsontext.variant_has_content(F.col("v")).alias("got"), F.coalesce(jsontext.has_content(F.to_json("v")), F.lit(False)).alias("want")).collect()
    assert {r["raw"]: r["got"] for r in rows} == {r["raw"]: r["want"] for r in rows} and {r["got"] for r in rows} == {True, False}
