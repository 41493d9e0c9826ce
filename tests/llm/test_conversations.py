"""Structure repair against an exhaustive search over the edits of each conversation."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalumen.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def order(row):
    turn, role, text = row
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, role.encode(), digest)


def cheapest(kinds):
    """``(cost, letters)`` over all edits, by the contract's words: a row of ``(initial, must go, truncated)`` each."""
    best = {("", 0): (0, "")}
    legal = re.compile("s?(ua)*u?")

    def put(into, key, value):
        if key not in into or value < into[key]:
            into[key] = value

    def add(now):
        # Every roles string is held by its first letter and length: letters that follow depend on no more.
        for _ in range(4):
            for (first, n), (cost, letters) in list(now.items()):
                to = grow(first, n, "u" if speaks_user(first, n) else "a")
                put(now, to, (cost + 3, letters + "I"))
        return now

    def speaks_user(first, n):
        return (n - (first == "s")) % 2 == 0

    def grow(first, n, role):
        return (first or role, min(n + 1, 2 + (n + 1) % 2 + 2))

    for initial, gone, late in kinds:
        new = {}
        for (first, n), (cost, letters) in add(dict(best)).items():
            put(new, (first, n), (cost + 4, letters + "D"))
            if not gone:
                for role, price, letter in ((initial, 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                    if (role == "s" and n == 0) or (role == ("u" if speaks_user(first, n) else "a")):
                        put(new, grow(first, n, role), (cost + price + 3 * late, letters + letter))
        best = new
    assert legal.fullmatch("suaua")
    ends = [v for (first, n), v in add(best).items() if n == 0 or (speaks_user(first, n) and (first, n) != ("s", 1))]
    return min(ends)


def brute(rows, ids):
    """The contract's columns for each id, from rows after damage."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv in ids:
        given = sorted(by[conv], key=order)
        seen, faults = set(), []
        for _, role, text in given:
            full = text.rstrip(BLANK)
            faults.append("blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in given]
        turns = [t for t, _, _ in given if t is not None]
        cost, letters = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
        repaired, at = [], 0
        for letter in letters:
            said = "user" if (len(repaired) - bool(repaired and repaired[0][0][:1] == "s")) % 2 == 0 else "assistant"
            if letter == "I":
                repaired.append((said, ""))
                continue
            if letter != "D":
                repaired.append((said if letter == "R" else given[at][1], given[at][2]))
            at += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in repaired))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, letters,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def found(spark, rows, every=None):
    frame = spark.createDataFrame(rows, SCHEMA)
    summary, repaired = C.repair(frame, every=every)
    hashed = {r["conv_id"]: r["sha256"] for r in C.digests(repaired).collect()}
    return {r["conv_id"]: (*r[1:], hashed.get(r["conv_id"], hashlib.sha256(b"").hexdigest())) for r in summary.collect()}


def random_rows(rng, n, longest):
    rows = []
    for conv in range(n):
        for turn in range(int(rng.integers(0, longest))):
            role = str(rng.choice(["system", "user", "assistant", "tool", "", "User", "s", "ua"], p=[.12, .35, .35, .06, .03, .03, .03, .03]))
            text = str(rng.choice(["One.", "two", "Three!  ", "", " \n", "vier?", "é.", "five. ", f"{conv} {turn}.", f"{turn} x"]))
            rows.append((conv, None if rng.random() < .05 else int(turn * rng.integers(1, 3)), None if rng.random() < .03 else role, None if rng.random() < .03 else text))
    return rows


@pytest.mark.parametrize("block", [1 << 18, 3])
def test_equals_exhaustive_search(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = random_rows(np.random.default_rng(block), 150, 12)
    want = brute(rows, {r[0] for r in rows})
    assert found(spark, rows) == want
    assert len({len(v[6]) for v in want.values()}) > 5 and any("I" in v[6] for v in want.values()) and any("R" in v[6] for v in want.values())


def test_walk_equals_exhaustive_search():
    rng, known = np.random.default_rng(5), {}
    for _ in range(3_000):
        kinds = [(str(rng.choice(["s", "u", "a", "t", ""])), bool(rng.random() < .2), bool(rng.random() < .2)) for _ in range(rng.integers(0, 14))]
        walk = C.Walk("x")
        for initial, gone, late in kinds:
            walk.row(initial, "blank" if gone else "truncated" if late else None, False, known)
        _, _, moves, _, place, tail, *_, cost = walk.end()
        assert (cost, C.back(moves, place)[0] + tail) == cheapest(kinds)
    # The automaton stays small however long conversations are.
    assert len({config for config, _ in known}) < 2_000


def test_batches_and_a_giant_conversation(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        rng = np.random.default_rng(9)
        rows = [(7, t, str(rng.choice(["user", "assistant", "system"], p=[.48, .48, .04])), f"{rng.integers(900)}" + "." * int(rng.integers(2))) for t in range(6_000)]
        rows += [(8, 1, "user", "same.")] * 3_000 + random_rows(rng, 5, 9)
        assert found(spark, rows) == brute(rows, {r[0] for r in rows})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_equals_brute_force(spark, smoke_dir):
    for d in (smoke_dir, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        want = brute(damage(rows), {r[0] for r in rows})
        got = {r["conv_id"]: tuple(r)[1:] for r in C.op11_conversation_repair(spark, d).collect()}
        assert got == want
        assert sum(v[5] for v in want.values()) > 0


def test_odd_rows(spark):
    rows = [(None, 3, "user", "a."), (None, None, None, None), (1, None, "user", "x."), (1, None, "user", "x."), (2, 5, "user", "y" * 300_000), (2, 9, "assistant", "z.")]
    every = spark.createDataFrame([(1,), (1,), (4,), (None,)], "conv_id long")
    got = found(spark, rows, every)
    assert got == brute(rows, {None, 1, 2, 4})
    assert got[4] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    more = spark.createDataFrame(rows, SCHEMA).withColumn("name", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("copies", F.lit(3))
    summary, repaired = C.repair(more)
    assert summary.count() == 3 and repaired.count() > 0
    summary, repaired = C.repair(more.limit(0))
    assert summary.count() == 0 and repaired.count() == 0 and C.digests(repaired).count() == 0
    named = spark.createDataFrame([("a", 1, "user", "q?"), ("b", 1, "user", "r?")], "conv_id string, turn int, role string, text string")
    assert sorted(r["conv_id"] for r in C.repair(named).rows.collect()) == ["a", "a", "b", "b"]
