"""Packing: ids against the tokenizer itself, plans that use each length exactly, no gaps and few sequences."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from catalumen.llm import packing as P
from catalumen.llm.base import table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.vocabulary())


def encode(tokenizer, text):
    return np.asarray(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_ids_of_odd_texts(tokenizer):
    bpe, rng = P.WordBpe(P.vocabulary()), random.Random(3)
    parts = ["don't", "It's", "ß", "É", "über", "ﬁ", "é", "№5", "x²", " ", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|", "...", "!?",
             "12", "'s", "'", "日本", "🙂", "İ", "a" * 90, "\t", "\r\n", "µ", "×", "</w>", "a</w>b"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 8)))
        assert bpe.ids(text) == encode(tokenizer, text)[:-1].tobytes(), repr(text)


@pytest.mark.parametrize("seed", range(40))
def test_combinations_use_each_length_exactly(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 64])
    counts = {x: rng.choice([1, 2, 3, 50]) for x in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
    used = Counter()
    for times, lengths in P.combinations(counts, capacity):
        assert times > 0 and sum(lengths) <= capacity
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)


def test_exact_complements_are_found():
    assert P.combinations({11: 1, 10: 4, 6: 4, 5: 1}, 16) == [(1, (11, 5)), (4, (10, 6))]
    plan = P.combinations({900: 5, 600: 5, 400: 5, 148: 5}, 2048)
    assert plan == [(5, (900, 600, 400, 148))]


def check_places(rows, capacity=2048):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_query_over_the_table(spark, smoke_dir, tokenizer):
    got = P.op3_packing(spark, smoke_dir).collect()
    rows = {(r["doc_id"], r["piece"]): r for r in got}
    want = 0
    for doc in table(spark, smoke_dir, "documents").collect():
        ids = encode(tokenizer, doc["text"])
        for piece, a in enumerate(range(0, len(ids), 2048)):
            r, own = rows[doc["doc_id"], piece], ids[a:a + 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, len(own), zlib.crc32(own.tobytes()))
            want += 1
    assert want == len(got) == len(rows)
    assert check_places(got) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1


def test_sequences_hold_the_ids(spark, smoke_dir):
    cut = P.pieces(table(spark, smoke_dir, "documents").limit(40), P.vocabulary())
    kept = {(r["doc_id"], r["piece"]): bytes(r["ids"]) for r in cut.collect()}
    from catalumen.llm.base import written

    for r in P.sequences(written(cut, "pieces")).collect():
        assert bytes(r["ids"]) == b"".join(kept.pop((p["key"], p["piece"])) for p in r["parts"])
    assert not kept


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "word", 5), (3, "one two " * 30_000, 5), (4, "same", 5), (4, "same", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = P.pack_documents(docs, P.vocabulary()).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 1, 2: 1, None: 1, 3: 30, 4: 2}
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) and check_places(got) == 30
    assert P.pack_documents(docs.limit(0), P.vocabulary()).count() == 0
