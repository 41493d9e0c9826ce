"""Decontamination: exact distances, recall of edited items, and brute force over the table."""

from __future__ import annotations

import random
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import regex

from catalumen.llm import decontaminate as D
from catalumen.llm.base import table


LETTERS = D.letter_table()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(60))
def test_nearest_run_is_the_least_distance(seed):
    rng = random.Random(seed)
    item = [rng.randrange(4) for _ in range(rng.randint(1, 6))]
    words = [rng.randrange(4) for _ in range(rng.randint(0, 9))]
    runs = [(distance(item, words[a:b]), a, b) for a in range(len(words) + 1) for b in range(a, len(words) + 1)]
    cost, a, b = D.nearest_run(np.array(item, np.uint64), np.array(words, np.uint64))
    assert cost == min(runs)[0] and distance(item, words[a:b]) == cost


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.choice("rid")
        if kind == "r":
            out[i] = f"zz{rng.randrange(10**6)}"
        elif kind == "i":
            out.insert(i, f"yy{rng.randrange(10**6)}")
        elif len(out) > 1:
            out.pop(i)
    return out


@pytest.mark.parametrize("share,least", [(0.0, 1.0), (0.05, 0.99), (0.1, 0.98), (0.15, 0.95)])
def test_recall_of_edited_items(spark, share, least):
    rng = random.Random(7)
    filler = [f"f{i}" for i in range(3000)]
    items = [(i, " ".join(f"b{rng.randrange(900)}" for _ in range(rng.randint(14, 60)))) for i in range(200)]
    docs = []
    for i, text in items:
        words = text.split()
        put = edited(words, int(share * len(words)), rng)
        docs.append((i, " ".join(rng.choices(filler, k=rng.randint(0, 80)) + put + rng.choices(filler, k=rng.randint(0, 80)))))
    found = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
    hit = {r["doc_id"] for r in found if r["doc_id"] == r["item_id"]}
    assert len(hit) >= least * len(items)
    assert {r["doc_id"] for r in found if r["doc_id"] != r["item_id"]} == set()


@pytest.mark.parametrize("size", [120, 200, 500, 1000])
def test_recall_of_long_items(spark, size):
    rng = random.Random(size)
    items = [(i, " ".join(f"b{rng.randrange(5000)}" for _ in range(size))) for i in range(30)]
    docs = [(i, " ".join(["f"] * rng.randint(0, 80) + edited(t.split(), int(0.15 * size), rng) + ["f"] * rng.randint(0, 80))) for i, t in items]
    # All edits in one place: the first or the last 15 % of the words are others.
    cut = int(0.15 * size)
    docs += [(i, " ".join(["f"] * cut + t.split()[cut:])) if i % 2 else (i, " ".join(t.split()[:-cut] + ["f"] * cut)) for i, t in items]
    got = D.find_leaks(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id long, text string"),
                       spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r["doc_id"] % 30 == r["item_id"] and r["distance"] <= cut for r in got)
    assert len({r["doc_id"] for r in got if r["doc_id"] < 30}) >= 0.97 * 30
    assert len({r["doc_id"] for r in got if r["doc_id"] >= 30}) >= 0.97 * 30


def found_pairs(spark, docs, items):
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]) for r in got.collect()}


def test_items_with_repeated_pairs(spark):
    # Exact copies, behind words that hold the same pairs, and edited copies of lists whose pairs come again and again.
    rng = random.Random(5)
    texts = ["to be or not to be", "x y x y x y x y", "a a a a a a", "n " * 400, "1 0 2 0 1 0 2 0 3 0 1 0 2 0 1 0 2 0 3 0"]
    texts += [" ".join(rng.choices(["0", "1", "2"], k=rng.randint(20, 60))) for _ in range(40)]
    texts += [" ".join(f"{w}{i} v{w} {w}{i} v{w}" for w in rng.sample(range(900), rng.randint(5, 12))) for i in range(40)]
    items = list(enumerate(texts))
    exact = [(i, f"{t[:9]} {t[:9]} q {t} q") for i, t in items]
    assert {(i, i) for i, _ in items} <= found_pairs(spark, exact, items)
    near = [(i, " ".join(["q"] * 9 + edited(t.split(), int(0.1 * len(t.split())), rng) + ["q"] * 9)) for i, t in items[5:]]
    assert sum(i == j for i, j in found_pairs(spark, near, items)) >= 0.97 * len(near)


@pytest.mark.parametrize("seed", range(20))
def test_repeated_pairs_count_as_often_as_an_item_has_them(seed):
    # The windows that are walked against counting in each window.
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 40))) for _ in range(8)]
    block = D.block_of([(0, " ".join(rng.choice(list("abcd"), 20))), (1, "a b a b c a a a")], LETTERS)
    data = "".join(texts).encode()
    run = D.LetterRun(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), LETTERS)
    slot, of = D.pair_slots(run.hash), np.repeat(np.arange(8), np.diff(run.upto))
    good = block.pairs[slot] & (of[1:] == of[:-1])
    again, since = D.repeats(slot, good, block.times)
    for size in (2, 5, 20):
        for s in range(len(of)):
            inside = range(s, min(s + size, int(run.upto[of[s] + 1])) - 1)
            own, n = np.unique(slot[inside][good[inside]], return_counts=True)
            struck = sum(b >= s and a in inside for a, b in zip(again.tolist(), since.tolist()))
            assert good[inside].sum() - struck == np.minimum(n, block.times[own]).sum()


def test_every_exact_passage_of_the_table_is_found(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in table(spark, d, "documents").collect()}
    items = {r["item_id"]: r["text"] for r in table(spark, d, "benchmark").collect()}
    want = {(k, i) for i, t in items.items() for k, x in docs.items() if t in x}
    got = {(r["doc_id"], r["item_id"]): r for r in D.op4_decontamination(spark, d).collect()}
    assert want and want <= set(got)
    for (k, i), r in got.items():
        a, b = (regex.findall(r"[\p{L}\p{N}\p{M}]+", t.lower()) for t in (items[i], docs[k][r["start"]:r["end"]]))
        assert distance(a, b) == r["distance"] <= D.TOLERANCE * len(a)


def test_odd_rows(spark):
    items = [(1, "One two three, four five six seven"), (2, None), (3, ""), (4, "hapax"), (5, "One two three, four five six seven")]
    docs = [(1, None, 0), (2, "", 0), (3, "x " * 300_000 + "one TWO three four five six seven.", 0), (None, "Hapax!", 0), (7, "hapaxes", 0),
            (8, "one two three four", 0), (8, "one two three four", 0)]
    left = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in D.find_leaks(left, right).collect()), key=str)
    assert got == sorted([(3, 1, 0, 600_000, 600_033), (3, 5, 0, 600_000, 600_033), (None, 4, 0, 0, 5)], key=str)
    assert D.find_leaks(left, right.limit(0)).count() == 0 and D.find_leaks(left.limit(0), right).count() == 0
    # A filter does not look for single words unless it is told to.
    assert sorted(str(r["doc_id"]) for r in D.drop_leaks(left, right).collect()) == ["1", "2", "7", "8", "8", "None"]
    assert sorted(r["doc_id"] for r in D.drop_leaks(left, right, least_words=1).collect()) == [1, 2, 7, 8, 8]
    assert D.short_items(right) == [2, 3, 4] and D.short_items(right, least_words=8) == [1, 2, 3, 4, 5]


HAN, KANA = [chr(c) for c in range(0x4E00, 0x5200)], [chr(c) for c in range(0x3042, 0x3094)]
CYRILLIC = [chr(c) for c in range(0x430, 0x450)]


def passage(rng, script):
    """Units of a passage in a script, and what stands between them."""
    if script == "russian":
        return ["".join(rng.choices(CYRILLIC, k=rng.randint(3, 9))) for _ in range(rng.randint(16, 60))], " "
    if script == "typographic":
        return [f"b{rng.randrange(900)}" for _ in range(rng.randint(16, 60))], " \u2014 "
    letters = HAN if script == "chinese" else HAN[:200] + KANA
    return rng.choices(letters, k=rng.randint(30, 80)), ""


@pytest.mark.parametrize("script", ["chinese", "japanese", "russian", "typographic"])
@pytest.mark.parametrize("share, least", [(0.0, 1.0), (0.05, 0.98), (0.15, 0.9)])
def test_recall_in_other_scripts(spark, script, share, least):
    rng = random.Random(f"{script} {share}")
    items, docs = [], []
    for i in range(60):
        units, between = passage(rng, script)
        items.append((i, between.join(units) + ("。" if between == "" else ".")))
        put = list(units)
        for _ in range(int(share * len(units))):
            at, (other, _) = rng.randrange(len(put)), passage(rng, script)
            kind = rng.choice("rid")
            if kind == "r":
                put[at] = other[0]
            elif kind == "i":
                put.insert(at, other[0])
            else:
                put.pop(at)
        around = [between.join(passage(rng, script)[0]) for _ in range(2)]
        # The copy in capitals, with hyphens for dashes and other marks around.
        copy = between.join(put).upper().replace("\u2014", "-")
        docs.append((i, f"{around[0]}，\u201c{copy}\u201d！ {around[1]}"))
    found = found_pairs(spark, docs, items)
    assert sum((i, i) in found for i, _ in items) >= least * len(items) and all(i == j for i, j in found)


def test_words_and_places_by_unicode():
    texts = ["Ünï-cödé “x”—y", "日本語のテキスト、ok", "", "Straße ПРИВЕТ", "plain old 7_8"]
    data = [t.encode() for t in texts]
    run = D.LetterRun(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]), LETTERS)
    whole = "".join(texts)
    words = [whole[a:b] for a, b in zip(run.start.tolist(), run.end.tolist())]
    assert words == ["Ünï", "cödé", "x", "y", *"日本語のテキスト", "ok", "Straße", "ПРИВЕТ", "plain", "old", "7", "8"]
    assert np.diff(run.upto).tolist() == [4, 9, 0, 2, 4]
    assert (D.words_of("ÜNÏ привет", LETTERS) == D.words_of("ünï ПРИВЕТ", LETTERS)).all()
    assert unicodedata.category("の")[0] == "L" and len(D.words_of("\ud800 a", LETTERS)) == 1


def test_a_task_that_filters_holds_arrays_for_a_bounded_piece_only():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 5_000, 3_000)) for _ in range(400)]
    block = D.block_of([(0, " ".join(f"item{i}" for i in range(12)))], LETTERS)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    rows = sum(part.num_rows for part in D.clean_rows([batch], "text", block))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts)
    assert sum(map(len, texts)) > 6 << 20
    assert peak < 100 << 20
