"""Strict JSON, numbers in file order after filters, and files of one name in several folders."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from catalumen.functions import labels
from catalumen.functions.jsontext import is_json_object
from catalumen.operators import ranking
from catalumen.sources import delimited, files

GOOD = ['{}', ' {"a": 1} ', '{"a": {"b": [1, "}{"]}}', '{"a]": "["}']
BAD = ['', ' ', '[]', '1', '"x"', 'null', '{"a":1} trailing', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "{'a':1}", '{"a":1', '{"a":1}}', '{"a":1}] [{"b":2}',
       '{"a":1}],"x":[{"b":1}', '{"a":1}, "k2": {"b":2}', '{"a":1}}, {"k":{"b":2}', 'x{"a":1}']


def test_only_one_whole_object_is_an_object(spark):
    for text in GOOD:
        assert isinstance(json.loads(text), dict)
    rows = spark.createDataFrame([(t,) for t in GOOD + BAD + [None]], "raw string")
    got = {r["raw"]: r["ok"] for r in rows.withColumn("ok", is_json_object(F.col("raw"))).collect()}
    assert got == {**{t: True for t in GOOD}, **{t: False for t in BAD}, None: None}


def test_labels_do_not_take_text_behind_a_list(spark):
    rows = spark.createDataFrame([('[{"value":"b"}] junk',), ('[{"value":" b "}]',)], "raw string")
    got = [tuple(r) for r in rows.select(labels.strict_label(F.col("raw"))["method"], labels.lenient_label(F.col("raw"))).collect()]
    assert got == [("not_list", '[{"value":"b"}] junk'), ("list_dict_value", "b")]


def test_numbers_are_dense_over_what_is_kept(spark, tmp_path):
    want = []
    for f in range(3):
        lines = []
        for i in range(400):
            lines.append(f"{f}-{i}\tx" if i % 7 else " ")
            if i % 7 and i % 3:
                want.append(f"{f}-{i}")
        (tmp_path / f"part{f}.tsv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = delimited.split_columns(delimited.read_lines(spark, str(tmp_path), ordered=True), ["id", "x"])
        kept = rows.filter(F.split("id", "-")[1].cast("int") % 3 != 0)
        got = {r["row_index"]: r["id"] for r in ranking.file_order_index(kept).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(want))


def test_files_of_one_name_in_several_folders(spark, tmp_path):
    for folder in ("x", "y/z"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "f.bin").write_bytes(folder.encode())
    manifest = files.hash_manifest(spark, str(tmp_path), "*.bin").cache()
    assert {r["relative_path"] for r in manifest.collect()} == {"x/f.bin", "y/z/f.bin"}
    assert files.manifest_drift(manifest, manifest).count() == 0
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        assert {r["relative_path"] for r in files.list_files(spark, root).collect()} == {"x/f.bin", "y/z/f.bin"}
