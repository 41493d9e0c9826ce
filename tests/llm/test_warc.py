"""WARC archives: exact round trips, payloads that look like records, assembly through concurrent-to, and SQL."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from catalumen.llm import warc as W
from tests.oracle import compare, connect

ODD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
ROWS = [(1, "http://a/1", "<p>é</p>", "x"), (2, "http://a/2", None, "x"), (3, "http://a/3", "", "x"), (4, "http://b\r\nEvil: 1", ODD, "x"),
        (5, "http://b/5", ODD + "tail", "x"), (9, None, "<p>é</p>", "x"), (7, "http://a/7", "<p>é</p>", "x"), (None, "http://n", "<p>é</p>", "x"),
        (11, "http://l", "long " * 400_000 + "WARC/1.1\r\n", "x"), (12, "http://same", "same", "x"), (12, "http://same", "same", "x")]


@pytest.fixture
def archive(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string").repartition(3)
    W.write_captures(pages, f"{tmp_path}/w")
    return f"{tmp_path}/w"


def test_round_trip(spark, archive):
    records = W.read_records(spark, archive).collect()
    assert len(records) == 3 * len(ROWS)
    got = sorted(bytes(r["payload"]) for r in records if r["type"] == "response")
    originals = [r for r in ROWS if not (r[2] == "<p>é</p>" and r[0] != 9 or r[0] == 2)]
    assert got == sorted((r[2] or "").encode() for r in originals)
    for r in records:
        if r["type"] == "response":
            digest = base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode()
            assert r["declared_digest"] == r["payload_digest"] == digest and r["payload_bytes"] == len(bytes(r["payload"]))
        if r["type"] == "revisit":
            assert r["payload_bytes"] == 0 and r["refers_to"] in {x["record_id"] for x in records if x["type"] == "response"}
    assert {r["target_uri"] for r in records} >= {"http://b  Evil: 1", None}


def test_archives_are_plain_warc(archive):
    from pathlib import Path

    for file in Path(archive).glob("*.gz"):
        data, at = gzip.decompress(file.read_bytes()), 0
        while at < len(data):
            assert data[at:at + 10] == b"WARC/1.1\r\n"
            end = data.index(b"\r\n\r\n", at)
            head = dict(line.split(b": ", 1) for line in data[at + 10:end].split(b"\r\n"))
            at = end + 4 + int(head[b"Content-Length"])
            assert data[at:at + 4] == b"\r\n\r\n"
            at += 4


def test_one_row_for_each_capture(spark, archive):
    captures = W.assemble(W.read_records(spark, archive)).collect()
    assert len(captures) == len(ROWS)
    for c in captures:
        twice = c["metadata"][0]["fields"].get("page-id") == "12"
        assert len(c["requests"]) == len(c["metadata"]) == (2 if twice else 1)
        assert c["requests"][0]["concurrent_to"] == [c["capture_id"]] and c["response"]["record_id"] == c["capture_id"]


def test_assembly_follows_links_either_way_and_through_others(spark):
    rows = [("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("r2", "revisit", []), ("q2", "request", ["r2"]),
            ("m2", "metadata", ["r2", "q2"]), ("lost", "request", ["nowhere"]), ("r3", "response", [])]
    got = W.assemble(spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>")).collect()
    flat = {c["capture_id"]: tuple(None if c[k] is None else [r["record_id"] for r in c[k]] for k in ("requests", "metadata")) for c in got}
    assert flat == {"r1": (["q1"], ["m1"]), "r2": (["q2"], ["m2"]), "r3": (None, None)}


def test_version_lines_in_payloads_and_cut_files(spark, tmp_path):
    twice = W.VERSION * 2
    htmls = [twice, f"a{twice}b{W.VERSION * 3}c", f"{twice}\r\n\r\n{twice}", "plain"]
    pages = spark.createDataFrame([(i, "http://a", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    W.write_captures(pages.repartition(1), f"{tmp_path}/w")
    got = [bytes(r["payload"]).decode() for r in W.read_records(spark, f"{tmp_path}/w").collect() if r["type"] == "response"]
    assert sorted(got) == sorted(htmls)
    # A cut record is passed over and takes nothing of the next file.
    (tmp_path / "cut").mkdir()
    record = "WARC/1.1\r\nWARC-Record-ID: <{}>\r\nWARC-Type: resource\r\nContent-Length: {}\r\n\r\nabc\r\n\r\n"
    for name, length in (("a", 3), ("b", 3000), ("c", 3)):
        (tmp_path / "cut" / f"{name}.gz").write_bytes(gzip.compress(record.format(name, length).encode()))
    found = W.read_records(spark, f"{tmp_path}/cut").coalesce(1).collect()
    assert sorted((r["record_id"], r["payload_bytes"]) for r in found) == [("<a>", 3), ("<c>", 3)]


def test_query_equals_sql(spark, smoke_dir):
    assert compare(spark, connect(smoke_dir), "op1", W.op1_warc, W.SQL, smoke_dir) is None


def test_query_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in W.op1_warc(spark, str(tmp_path)).collect()), key=str)
    n = {i: len((t or "").encode()) for i, _, t, _ in ROWS}
    want = [(i or 0, n[i], "response", None) for i in (3, 4, 5, 9, 11, 12, 12)]
    want += [(1, n[1], "revisit", 9), (7, n[7], "revisit", 9), (0, n[None], "revisit", 9), (2, 0, "revisit", 3)]
    assert got == sorted(want, key=str)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert W.op1_warc(spark, f"{tmp_path}/none").count() == 0
