"""The pipeline stage by stage against brute-force versions on the smallest tables."""

from __future__ import annotations

import numpy as np
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from catalumen.llm import decontaminate, packing, secret_scan
from catalumen.llm.base import table
from tests.llm.test_decontaminate import distance
from tests.llm.test_near_dup import brute
from tests.llm.test_packing import check_places

ORDER = ["language_id", "near_dup", "decontamination", "secret_scan", "packing"]


def words(text):
    return regex.findall(r"[\p{L}\p{N}\p{M}]+", text.lower())


def leaked(text, items):
    """Whether a run of the text's words is near an item, by trying every start of the words that share its first ones."""
    own = words(text)
    for item in items:
        most = int(len(item) * decontaminate.TOLERANCE)
        held = set(item)
        for a in range(len(own)):
            run = own[a:a + len(item)]
            if len(run) == len(item) and sum(w in held for w in run) >= len(item) - most and distance(item, run) <= most:
                return True
    return False


def test_stages_against_brute_force(spark, smoke_dir, tmp_path):
    docs = table(spark, smoke_dir, "documents")
    columns = docs.columns
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [words(r["text"]) for r in table(spark, smoke_dir, "benchmark").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ORDER
    keywords, tokenizer = secret_scan.automaton(), Tokenizer.from_file(packing.vocabulary())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, smoke_dir)
        if name == "packing":
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(text) and check_places(rows) > 0
            sizes = {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in text.items()}
            assert sum(r["length"] for r in rows) == sum(sizes.values())
            break
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = {r["doc_id"]: r for r in docs.collect()}
        if name == "language_id":
            want = {k: t for k, t in text.items() if t and any(map(str.isalpha, t))}
        elif name == "near_dup":
            groups = brute(list(text.items()), 5, 80)
            want = {k: t for k, t in text.items() if groups[k][1] == k}
        elif name == "decontamination":
            want = {k: t for k, t in text.items() if not leaked(t, items)}
        else:
            want = {k: secret_scan.redacted(t, secret_scan.scan(t, keywords)) for k, t in text.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
        text = {k: r["text"] for k, r in kept.items()}
        assert text == want, name


def test_run_equals_its_stages_and_takes_empty_tables(spark, smoke_dir, tmp_path):
    rows = corpus_pipeline.run(spark, smoke_dir).collect()
    assert check_places(rows) <= 1.05 * np.ceil(sum(r["length"] for r in rows) / 2048) + 1
    for name in ("documents", "benchmark"):
        table(spark, smoke_dir, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, smoke_dir, tmp_path):
    table(spark, smoke_dir, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = "the " * 100_000 + "password=" + "q" * 30
    rows = [(1, None, "en", None, None), (2, "", "en", "a", 0), (3, "the thing and the other", None, "a", 23), (None, "the thing and the other", "en", "a", 23),
            (5, long, "en", None, len(long)), (6, "12 34", "fr", "b", 5), (3, "the thing and the other", None, "a", 23)]
    rows += [(k, f"learn the words of this one {k} " * 3, "en", "c", 90) for k in range(20, 30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] or 0 for r in got if (r["doc_id"] or 0) < 20}) == [0, 3, 5] and check_places(got) > 0
