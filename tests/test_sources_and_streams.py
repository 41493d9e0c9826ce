from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from catalumen.operators import audit, ranking, scoring
from catalumen.plans import streams
from catalumen.session import cut_lineage, shared_root
from catalumen.sources import bundles, delimited, files, jsonlines, sinks
from catalumen.streaming import incremental


def test_strict_tsv_keeps_quotes_and_skips_blank_lines(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text('a "quoted title\t1>2\n\n   \nplain\t3\n', encoding="utf-8")
    rows = delimited.split_columns(delimited.read_lines(spark, str(path)), ["title", "path"]).collect()
    assert [tuple(r) for r in rows] == [('a "quoted title', "1>2"), ("plain", "3")]


@pytest.mark.parametrize("line", ["one", "a\tb\tc"])
def test_strict_tsv_stops_on_other_widths(spark, tmp_path, line):
    path = tmp_path / "t.tsv"
    path.write_text(f"x\t1\n{line}\n")
    lines = delimited.read_lines(spark, str(path))
    with pytest.raises(Exception, match="expected 2 columns"):
        delimited.split_columns(lines, ["title", "path"]).collect()
    kept = delimited.split_columns(lines, ["title", "path"], fail=False)
    assert kept.filter("malformed").count() == 1 and kept.count() == 2


def test_header_is_checked(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("title\tpath\nx\t1\n")
    assert delimited.read_with_header(spark, str(path), ["title", "path"]).count() == 1
    with pytest.raises(ValueError, match="header"):
        delimited.read_with_header(spark, str(path), ["path", "title"])


def test_quote_aware_scan_counts(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text('"a\tb"\t1\nonly\n\t2\nx\t3\t4\n')
    frame = delimited.scan_quoted(spark, str(path), ["title", "path"]).cache()
    got = {r["counter"]: r["value"] for r in audit.counters(
        frame, delimited.scan_counters(frame, ["title", "path"])).collect()}
    assert got == {"records": 4, "malformed": 2, "empty_title": 1, "empty_path": 0}
    assert frame.filter("NOT malformed").orderBy("path").first()["title"] == "a\tb"


def test_file_order_index_over_several_files_and_splits(spark, tmp_path):
    want = []
    for name in ("a.txt", "b.txt", "c.txt"):
        lines = [f"{name}-{i:05d}-{'x' * (i % 40)}" for i in range(3_000)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        lines = delimited.read_lines(spark, str(tmp_path), ordered=True)
        got = {r["row_index"]: r["value"] for r in ranking.file_order_index(lines).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got[i] for i in range(len(want))] == want


def test_json_lines_strict_and_permissive(spark, tmp_path):
    good, bad = tmp_path / "g.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"a":1,"b":{"c":[1]}}\n\n{"a":2}\n')
    bad.write_text('{"a":1}\n{broken\n[1,2]\n3\n{"a":null}\n')
    assert jsonlines.read_raw(spark, str(good)).count() == 2
    assert [r["a"] for r in jsonlines.read_typed(spark, str(good), "a int").orderBy("a").collect()] == [1, 2]
    with pytest.raises(Exception, match="not a JSON object"):
        jsonlines.read_raw(spark, str(bad)).collect()
    with pytest.raises(Exception):
        jsonlines.read_typed(spark, str(bad), "a int").collect()
    kept = jsonlines.read_raw(spark, str(bad), fail=False)
    assert kept.filter("malformed").count() == 3 and kept.filter(F.col("doc").isNotNull()).count() == 2


def test_gzipped_json_lines_know_their_file(spark, tmp_path):
    for i in range(3):
        with gzip.open(tmp_path / f"p{i}.json.gz", "wt") as f:
            f.write("".join(json.dumps({"i": i, "j": j}) + "\n" for j in range(5)))
    (tmp_path / "other.txt").write_text("ignored")
    frame = jsonlines.read_gzipped(spark, str(tmp_path), 4)
    assert {r["file_name"]: r["n"] for r in frame.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        f"p{i}.json.gz": 5 for i in range(3)}


def test_image_table_inventory_and_availability(spark, tmp_path):
    with gzip.open(tmp_path / "images.csv.gz", "wt") as f:
        f.write("image_id,height,width,path\ni1,1,2,a\\x.jpg\n,3,4,b.jpg\ni2,5,6,\ni3,7,8,a/missing.jpg\ni4,1,1,../x.jpg\ni5,1,1,a/y.gif\n")
    root = tmp_path / "root"
    (root / "a").mkdir(parents=True)
    for name in ("x.jpg", "y.gif"):
        (root / "a" / name).write_bytes(b"data" + name.encode())
    table = files.read_image_table(spark, str(tmp_path / "images.csv.gz"))
    assert {r["image_id"] for r in table.collect()} == {"i1", "i3", "i4", "i5"}
    listed = files.list_files(spark, str(root))
    assert {(r["relative_path"], r["extension"], r["length"]) for r in listed.collect()} == {("a/x.jpg", ".jpg", 9), ("a/y.gif", ".gif", 9)}
    marked = {r["image_id"]: r["physical_file_available"] for r in files.mark_available(table, listed).collect()}
    assert marked == {"i1": True, "i3": False, "i4": False, "i5": False}
    (tmp_path / "bad.csv").write_text("image_id,path\n1,2\n")
    with pytest.raises(ValueError, match="height"):
        files.read_image_table(spark, str(tmp_path / "bad.csv"))


@pytest.mark.parametrize("limit", [0, 10**9])
def test_hash_manifest_and_drift(spark, tmp_path, limit):
    content = {f"f{i}.bin": bytes([i]) * (1_000 * i) for i in range(1, 4)}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    manifest = files.hash_manifest(spark, str(tmp_path), "*.bin", whole_file_limit=limit).cache()
    assert {r["relative_path"]: (r["length"], r["sha256"]) for r in manifest.collect()} == {
        n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items()}
    recorded = spark.createDataFrame(
        [("f1.bin", hashlib.sha256(content["f1.bin"]).hexdigest()), ("f2.bin", "0"), ("gone.bin", "1")], "relative_path string, sha256 string")
    assert {r["relative_path"] for r in files.manifest_drift(manifest, recorded).collect()} == {"f2.bin", "f3.bin", "gone.bin"}


def test_curves_bundles_and_config(spark, tmp_path):
    curve = spark.range(101).select((F.col("id") / 100).alias("threshold"), F.col("id").alias("n"))
    sinks.write_small_csv(curve, str(tmp_path / "curve"), ["threshold"])
    assert len(list((tmp_path / "curve").glob("*.csv"))) == 1
    assert bundles.read_curve(spark, str(tmp_path / "curve"), "threshold double, n long", 101).count() == 101
    with pytest.raises(ValueError, match="expected 100"):
        bundles.read_curve(spark, str(tmp_path / "curve"), "threshold double, n long", 100)
    rows = spark.createDataFrame([("a", [0.5, 0.5]), ("a", [0.9, 0.9]), ("b", [1.0])], "id string, p array<double>")
    rows.write.parquet(str(tmp_path / "bundle"))
    bundle = bundles.read_bundle(spark, str(tmp_path / "bundle"), ["id", "p"])
    assert {(r["array"], r["problem"], r["n"]) for r in bundles.bundle_problems(bundle, "id", {"p": 2}).collect()} == {
        ("p", "row_sum", 1), ("p", "wrong_width", 1), ("id", "repeated_id", 1)}
    with pytest.raises(ValueError, match="labels"):
        bundles.read_bundle(spark, str(tmp_path / "bundle"), ["labels"])
    (tmp_path / "c.json").write_text('{"x": 1}')
    assert bundles.load_config(str(tmp_path / "c.json")) == {"x": 1}
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError, match="mapping"):
        bundles.load_config(str(tmp_path / "d.json"))


def test_split_sink_report_and_predictions(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 80, "train").otherwise("test").alias("split"), F.lit(None).cast("string").alias("x"))
    sinks.write_by_split(df, str(tmp_path / "s"), files_per_split=3)
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=test", "split=train"]
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = 'train'").count() == 80
    sinks.write_jsonl(df.limit(2), str(tmp_path / "j"))
    line = next((tmp_path / "j").glob("*.json")).read_text().splitlines()[0]
    assert json.loads(line) == {"id": 0, "split": "train", "x": None}
    counted = audit.counters(df, {"train": F.col("split") == "train"})
    sinks.write_report(counted, audit.check_table(counted, {"train": 80, "records": 99}), str(tmp_path / "r"))
    report = json.loads(next((tmp_path / "r").glob("*.json")).read_text())
    assert report["counters"] == {"records": 100, "train": 80} and report["passed"] is False and len(report["checks"]) == 2
    sinks.write_predictions(df, str(tmp_path / "p"), "id", "split", "split")
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["id", "true_label", "predicted_label"]


def test_shared_folder_is_used_for_stages(spark):
    root = shared_root(spark)
    stage = cut_lineage(spark.range(10))
    assert stage.count() == 10 and all(root.replace("file:", "").rstrip("/") in f for f in stage.inputFiles())


def event_files(spark, folder, start, n):
    spark.range(start, start + n).select(
        F.col("id").alias("record_id"), F.when(F.col("id") % 10 == 0, "{bad").otherwise('{"a":1}').alias("raw")
    ).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_resumes_and_drops_repeated_ids(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    event_files(spark, source, 0, 100)
    schema = spark.read.parquet(source).schema

    def run():
        stream = incremental.file_stream(spark, source, schema, files_per_batch=1)
        incremental.run_to_end(incremental.ingest(stream, "record_id", "raw", sink))
        return spark.read.parquet(f"{sink}/records")

    assert run().count() == 100
    event_files(spark, source, 50, 100)
    event_files(spark, source, 0, 30)
    assert run().count() == 150 == run().select("record_id").distinct().count()
    totals = spark.read.parquet(f"{sink}/counters").agg(F.sum("records").alias("r"), F.sum("malformed").alias("m")).first()
    assert (totals["r"], totals["m"]) == (150, 15)


def test_scoring_resumes_and_refuses_another_model(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    event_files(spark, source, 0, 20)
    schema = spark.read.parquet(source).schema

    def run(model):
        stream = incremental.file_stream(spark, source, schema)
        incremental.run_to_end(incremental.score_resumable(
            stream, lambda df: df.select("record_id", (F.col("record_id") * 2).alias("score")), sink, {"model": model}))
        return spark.read.parquet(f"{sink}/scores").count()

    assert run("m1") == 20 == run("m1")
    event_files(spark, source, 20, 5)
    assert run("m1") == 25
    with pytest.raises(RuntimeError, match="model"):
        run("m2")


def test_routing_stream(spark, tmp_path):
    spark.createDataFrame([(1, 0.95), (2, 0.9), (3, 0.1)], "id int, conf double").write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), "id int, conf double")
    incremental.run_to_end(incremental.route(stream, "conf", 0.9, str(tmp_path / "out")))
    got = {r["id"]: r["route"] for r in spark.read.parquet(str(tmp_path / "out" / "routed")).collect()}
    assert got == {1: "accept", 2: "accept", 3: "review"}


def test_streams_over_a_table_in_part_files(spark, tmp_path):
    vectors = spark.range(60).select(
        F.col("id").alias("vec_id"), (F.col("id") % 2).cast("int").alias("label"),
        F.array((F.col("id") % 2).cast("float"), F.lit(0.5).cast("float")).alias("embedding"))
    events = spark.range(40).select(F.col("id").alias("event_id"), F.lit("a").alias("event_type"), F.lit("{}").alias("props"), F.lit(1.0).alias("value"))
    for parts in (1, 3):
        folder = str(tmp_path / f"in{parts}")
        vectors.repartition(parts).write.parquet(f"{folder}/embeddings.parquet")
        events.repartition(parts).write.parquet(f"{folder}/events.parquet")
        assert streams.stream_score(spark, folder).count() == 60
        assert sum(r["n"] for r in streams.stream_route(spark, folder).collect()) == 60
        assert tuple(streams.stream_counters(spark, folder).first()) == (40, 0)
        assert streams.stream_ingest(spark, folder).first()["distinct_ids"] == 40


def test_batch_score_loads_the_model_once_per_task(spark):
    def make():
        def model(batch):
            return batch.assign(y=batch["id"] * 2)
        return model

    rows = scoring.batch_score(spark.range(10), make, "id long, y long").collect()
    assert all(r["y"] == 2 * r["id"] for r in rows) and len(rows) == 10
