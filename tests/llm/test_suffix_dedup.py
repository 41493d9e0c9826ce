"""Bucket refinement against all byte strings by brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from catalumen.llm import packs as K
from catalumen.llm import suffix_dedup as S
from catalumen.llm.base import table


def brute(rows, length):
    """``[(key, bytes, removed, spans, kept)]``, sorted."""
    data = [(k, (t or "").encode()) for k, t in rows]
    times = Counter(d[i:i + length] for _, d in data for i in range(len(d) - length + 1))
    out = []
    for k, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if times[d[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int(gone[0]) + int((gone[1:] > gone[:-1]).sum())
        out.append((-1 if k is None else k, len(d), int(gone.sum()), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return sorted(out)


def got(frame):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
                  for r in frame.collect())


@pytest.fixture
def tiny_packs(monkeypatch):
    monkeypatch.setattr(K, "PACK_BYTES", 20_000)
    monkeypatch.setattr(K, "BUCKET_KEYS", 1 << 10)
    monkeypatch.setattr(S, "CHUNK", 3_000)


@pytest.mark.parametrize("key_bits", [1, 3, 7, 8, 9, 15, 16, 23, 40])
def test_short_keys_come_back(key_bits):
    rng = random.Random(key_bits)
    for n in (1, 2, 3, 8, 9, 200, 1000):
        keys = np.array(sorted({rng.randrange(1 << key_bits) for _ in range(n)}), np.uint64)
        data = K.low_and_high(keys, key_bits)
        assert K.from_low_and_high(data, len(keys), key_bits).tolist() == keys.tolist()
        low = max(0, key_bits - (len(keys) - 1).bit_length())
        assert len(data) <= len(keys) * (low + 3) / 8 + low % 8 + 2


@pytest.mark.parametrize("levels", [[8], [8, 13], [8, 16, 20]])
def test_equal_strings_get_equal_names(levels):
    data, length = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint8), levels[-1]
    found = S.names(data, levels)
    strings = [data[i:i + length].tobytes() for i in range(501 - length)]
    assert len(found) == len(strings)
    assert len(set(found.tolist())) == len(set(strings)) == len(set(zip(found.tolist(), strings)))
    assert not len(S.names(data[:length - 1], levels))


def test_depths():
    assert S.depths(64, 200) == [64, 128, 200] and S.depths(8, 8) == [8] and S.depths(8, 9) == [8, 9]
    for first in (1, 12, 256):
        with pytest.raises(ValueError):
            S.depths(first, 200)


def test_settled_suffixes_go_no_further():
    rng = random.Random(4)
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)).encode() for _ in range(3)]
    texts = [letters[0] + letters[1][:30], letters[1][:30] + letters[2], letters[0][:19]]
    pack = SimpleNamespace(data=np.frombuffer(b"".join(texts), np.uint8), at=np.cumsum([0] + [len(t) for t in texts]))
    # Whole names: the runs are the shared strings; one of 19 bytes is too short to take part.
    for levels in ([8], [8, 16], [8, 16, 20]):
        start, end = S.Suffixes(pack, levels, 20, 64).open_runs(None)
        assert list(zip(start, end)) == [(60, 90), (90, 120)]
    # Names cut to a few bits open more, never less, and both ways of sorting agree.
    for bits in (9, 12, 60, 64):
        cut, whole = S.Suffixes(pack, [8], 20, bits), S.Suffixes(pack, [8], 20, 64)
        assert not (whole.opened(None) & ~cut.opened(None)).any()
        assert sorted(cut.where) == sorted(whole.where) and cut.times.sum() == whole.times.sum()
        assert (cut.keys[1:] > cut.keys[:-1]).all()
        # Buckets that are not counted are open.
        share = S.Suffixes(pack, [8], 20, bits, 2)
        assert not (whole.opened(None) & ~share.opened(None)).any() and 0 < len(share.where) < len(whole.where)


def test_query_equals_brute_force_on_the_table(spark, smoke_dir, tiny_packs):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, smoke_dir, "documents").collect()]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows, 200)]
    found = [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
             for r in S.op9_suffix_dedup(spark, smoke_dir).collect()]
    assert sorted(found) == want and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("seed, first", [(1, 8), (2, 4), (3, 16)])
def test_shared_strings_at_all_offsets(spark, seed, first, tiny_packs):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abé", k=rng.choice([15, 19, 20, 21, 45]))) for _ in range(10)] + ["a" * 33, "ab" * 20]
    rows = []
    for k in range(250):
        text = "".join("".join(rng.choices("xyz ", k=rng.randint(0, 25))) + rng.choice(pool) for _ in range(rng.randint(0, 6)))
        rows.append((k, text))
    rows += [(1000 + i, rows[i % 7][1]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(S.dedup_bytes(docs, length=20, first=first)) == brute(rows, 20)


def test_odd_rows(spark):
    rng = random.Random(9)
    shared = "".join(rng.choices("abcdefgh", k=200))
    long = "".join(rng.choices("0123456789", k=400_000))
    rows = [(1, None, 0), (2, "", 0), (3, shared, 0), (4, long + shared + "é", 0), (None, "q" * 201, 0), (6, "z" * 200, 0),
            (7, shared[:199], 0), (8, long[:300], 0), (8, long[:300], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    want = {1: (0, 0, 0), 2: (0, 0, 0), 3: (200, 200, 1), 4: (400_202, 500, 2), -1: (201, 201, 1), 6: (200, 0, 0), 7: (199, 0, 0),
            8: (300, 300, 1)}
    found = got(S.dedup_bytes(docs))
    assert len(found) == 9 and {r[0]: r[1:4] for r in found} == want
    assert S.dedup_bytes(docs.limit(0)).count() == 0
