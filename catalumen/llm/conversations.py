"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A legal conversation is empty or an optional system row followed by pairs of a
user and an assistant row. Rows are dealt by conversation and sorted by turn;
one pass over the sorted stream carries the search from Arrow batch to Arrow
batch. The search is a finite automaton: it holds, for each of four places in
the legal order, the cost above the cheapest and the alphabetical rank of the
best edits that lead there, and both take few values. Each row leaves four
bytes, from where its places are reached. A conversation longer than ``BLOCK``
rows writes these bytes out as rows of their own, and a second stream reads
them from the last block to the first. Texts are shuffled once, when the edits
are known, and flow through in order.

A stream holds one block, the edits of one conversation (one letter a row,
which is one cell of the result) and a batch of texts. A conversation is
streamed by one task, since its digest is a hash over its rows in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalumen.llm.base import query, small_batches, table, written

BLANKS = " \t\n\x0b\x0c\r"
# Rows whose four bytes a task holds before it writes them out.
BLOCK = 1 << 18

START, SYSTEM, USER, ASSISTANT = range(4)
ANEW, DROP, ADD, LATE = 3, 4, 3, 3
# What may still be saved from a dearer place: see ``step``.
WORTH = 7
OPS = "DKR"
SPEAK = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}

Config = tuple[tuple[int | None, ...], tuple[int, ...]]
FIRST: Config = ((0, None, None, None), (0, 0, 0, 0))


class Repair(NamedTuple):
    """``summary``: a row a conversation; ``rows``: the repaired rows, of one conversation after the other and in order."""

    summary: DataFrame
    rows: DataFrame


def moves(place: int, kind: str) -> Iterator[tuple[int, int, str]]:
    """``(place, cost, letters)`` that a row of this kind can lead to.

    ``kind`` is ``d`` for a row that must go, or the role's initial, in upper
    case if the row is truncated. Two rows put in before one row are the most
    that can be of use: they lead back to the place they started from.
    """
    cost = 0
    for added in range(3):
        yield place, cost + DROP, "I" * added + "D"
        if kind != "d":
            late = LATE if kind.isupper() else 0
            initial, speaker = kind.lower(), SPEAK[place]
            if initial == "s" and place == START:
                yield SYSTEM, cost + late, "I" * added + "K"
            if initial == ("u" if speaker == USER else "a"):
                yield speaker, cost + late, "I" * added + "K"
            yield speaker, cost + late + ANEW, "I" * added + "R"
        place, cost = SPEAK[place], cost + ADD


def step(config: Config, kind: str) -> tuple[Config, int, bytes]:
    """The automaton's next state, the cost that all its places share, and a byte a place: from where, rows added, edit.

    The edits up to a row end with that row's own letter, so of two different
    ones none begins the other and their order is settled for good. A place
    more than ``WORTH`` above the cheapest can't be part of a cheapest
    repair: from any place, a row put in and a row dropped reach all that can
    follow from any other.
    """
    costs, ranks = config
    best: list[tuple | None] = [None] * 4
    for place, cost in enumerate(costs):
        if cost is not None:
            for to, more, letters in moves(place, kind):
                found = (cost + more, ranks[place], letters, place)
                if best[to] is None or found < best[to]:
                    best[to] = found
    least = min(b[0] for b in best if b)
    best = [b if b and b[0] - least <= WORTH else None for b in best]
    order = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
    rank = {to: i for i, (_, _, to) in enumerate(order)}
    return (
        (tuple(b and b[0] - least for b in best), tuple(rank.get(to, 0) for to in range(4))),
        least,
        bytes(b[3] | (len(b[2]) - 1) << 2 | OPS.index(b[2][-1]) << 4 if b else 0 for b in best),
    )


def finish(config: Config) -> tuple[int, int, str]:
    """``(cost, place, letters)`` of the cheapest way to end."""
    tails = {START: (0, ""), ASSISTANT: (0, ""), USER: (ADD, "I"), SYSTEM: (2 * ADD, "II")}
    costs, ranks = config
    found = min((costs[p] + more, ranks[p], letters, p) for p, (more, letters) in tails.items() if costs[p] is not None)
    return found[0], found[3], found[2]


def back(block: bytes, place: int) -> tuple[str, int]:
    """The letters of a block that ends at a place, and the place it began with."""
    letters = []
    for at in range(len(block) - 4, -4, -4):
        byte = block[at + place]
        letters.append("I" * (byte >> 2 & 3) + OPS[byte >> 4])
        place = byte & 3
    return "".join(reversed(letters)), place


def tuples(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The rows of all batches, one after the other, with None for null."""
    for frame in frames:
        yield from zip(*[c.astype(object).where(c.notna(), None).tolist() for _, c in frame.items()])


class Walk:
    """One conversation on its way through the stream."""

    def __init__(self, name: str | None):
        self.name, self.config, self.moves, self.number, self.cost = name, FIRST, bytearray(), 0, 0
        self.low = self.high = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def turn(self, turn: int) -> None:
        if turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def row(self, initial: str, fault: str | None, again: bool, known: dict) -> None:
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial, kind = initial, "d"
        if fault == "blank":
            self.blank += 1
        elif again:
            self.duplicate += 1
        else:
            kind = initial if initial in ("s", "u", "a") else "o"
            if fault == "truncated":
                self.truncated += 1
                kind = kind.upper()
        found = known.get((self.config, kind))
        if found is None:
            found = known[self.config, kind] = step(self.config, kind)
        self.config, more, came = found
        self.cost += more
        self.moves += came

    def block(self) -> tuple:
        """The moves so far, as a row; the walk goes on without them."""
        row = (self.name, self.number, bytes(self.moves), False, None, None, *[None] * 6)
        self.moves, self.number = bytearray(), self.number + 1
        return row

    def end(self) -> tuple:
        more, place, tail = finish(self.config)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.name, self.number, bytes(self.moves), True, place, tail, gaps, self.blank, self.duplicate, self.truncated,
                self.illegal, self.cost + more)


DECIDED = ("name string, block int, moves binary, last boolean, place int, tail string, gaps long, blank long, "
           "duplicate long, truncated long, illegal long, cost long")


def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of moves of every conversation; the last one has its counts, its cost and its end."""
    columns = [c.split()[0] for c in DECIDED.split(", ")]
    known: dict[tuple[Config, str], tuple[Config, int, bytes]] = {}
    out: list[tuple] = []
    held, walk = 0, None
    for name, turn, initial, fault, copies, fresh in tuples(frames):
        if walk is None or walk.name != name:
            if walk is not None:
                out.append(walk.end())
                held += len(walk.moves) + 100
            walk = Walk(name)
        if turn is not None and copies:
            walk.turn(int(turn))
        for copy in range(copies):
            walk.row(initial, fault, bool(copy) or not fresh, known)
            if len(walk.moves) >= 4 * BLOCK:
                held += len(walk.moves)
                out.append(walk.block())
            if held >= 4 * BLOCK:
                yield pd.DataFrame(out, columns=columns, dtype=object)
                out, held = [], 0
    if walk is not None:
        out.append(walk.end())
    yield pd.DataFrame(out, columns=columns, dtype=object)


def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The letters of each block, from the last block of a conversation to its first."""
    out, held, place = [], 0, START
    for name, block, came, last, at, tail in tuples(frames):
        letters, place = back(came, at if last else place)
        out.append((name, block, letters + (tail if last else "")))
        held += len(letters) + 100
        if held >= 4 * BLOCK:
            yield pd.DataFrame(out, columns=["name", "block", "letters"], dtype=object)
            out, held = [], 0
    yield pd.DataFrame(out, columns=["name", "block", "letters"], dtype=object)


REPAIRED = "name string, place long, role string, text string, edit string"


def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The repaired rows; each conversation's letters come before its rows."""
    edits, at, state, place = "", 0, START, 0
    for frame in frames:
        out = []
        for name, letters, role, text in tuples(iter([frame])):
            if letters is not None:
                edits, at, state, place = letters, 0, START, 0
            else:
                letter, at = edits[at], at + 1
                if letter != "D":
                    state = SYSTEM if letter == "K" and state == START and role[:1] == "s" else SPEAK[state]
                    out.append((name, place, NAMES[state] if letter == "R" else role, text, letter))
                    place += 1
            while edits[at:at + 1] == "I":
                state = SPEAK[state]
                out.append((name, place, NAMES[state], "", "I"))
                place, at = place + 1, at + 1
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REPAIRED.split(", ")], dtype=object)


def first_fault(text: Column) -> Column:
    """``blank``, ``truncated`` or null; a row that repeats is told from the others of its conversation."""
    full = F.rtrim(text, F.lit(BLANKS))
    return F.when(full == "", "blank").when(~F.right(full, F.lit(1)).isin(".", "!", "?"), "truncated")


def streamed(rows: DataFrame, *then: str) -> DataFrame:
    """All rows of a conversation in one partition, together, and in the order of ``then``."""
    return rows.repartition("name").sortWithinPartitions("name", *[F.col(c).asc_nulls_first() for c in then])


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           every: DataFrame | None = None) -> Repair:
    """Counts of faults, the cheapest edits and the repaired rows of each conversation.

    Rows of a conversation are taken by turn, null first; different rows of
    one turn by role, then by the SHA-256 of role and text. A null role or text
    counts as one space, a null conversation is one of its own, and equal rows
    count each. A row without text is ``blank``, one whose role and text
    came before is a ``duplicate``, one that does not end with ``.``, ``!`` or
    ``?`` is ``truncated``; only its first fault counts. ``illegal`` counts
    neighbours whose roles' initials are not su, ua or au, and ``gaps`` the
    numbers missing between the first turn and the last. Keeping a row (K) is free, calling it user or
    assistant (R) costs 3, dropping it (D) 4, putting in an empty user or
    assistant row (I) 3; blank and duplicate rows must go and a truncated row
    that stays costs 3 more. Of equally cheap edits the first by alphabet are
    taken. ``every`` adds conversations that may have no rows (its column is
    named as ``conv``): all zeros and no edits. Empty tables give no rows; other columns are ignored.

    ``rows.rows`` has ``place`` from 0 and ``edit``; texts of one conversation
    stand together and in order in its partitions, as long as it is not written or shuffled.
    """
    kind = rows.schema[conv].dataType
    small_batches(rows.sparkSession)
    base = rows.select(
        F.col(conv).cast("string").alias("name"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # Equal rows of a turn become one row with a count before anything is shuffled.
    narrow = base.groupBy("name", "turn", "role", "digest", first_fault(F.col("text")).alias("fault")).agg(F.count(F.lit(1)).alias("copies"))
    earlier = Window.partitionBy("name", "digest").orderBy(F.col("turn").asc_nulls_first())
    narrow = narrow.withColumn("fresh", F.row_number().over(earlier) == 1)
    if every is not None:
        none = every.select(F.col(conv).cast("string").alias("name")).distinct()
        narrow = narrow.unionByName(none.withColumn("copies", F.lit(0).cast("long")), allowMissingColumns=True)
    stream = streamed(narrow, "turn", "role", "digest").select(
        "name", F.col("turn").cast("string").alias("turn"), F.left(F.coalesce("role", F.lit("")), F.lit(1)).alias("kind"), "fault",
        "copies", F.coalesce("fresh", F.lit(False)).alias("fresh"))
    decided = written(stream.mapInPandas(decide, DECIDED), "decided")
    blocks = decided.select("name", "block", "moves", "last", F.coalesce("place", F.lit(0)).alias("place"), "tail")
    pieces = blocks.repartition("name").sortWithinPartitions("name", F.desc("block")).mapInPandas(trace, "name string, block int, letters string")
    parts = F.array_sort(F.collect_list(F.struct("block", "letters")))
    audits = written(pieces.groupBy("name").agg(F.array_join(F.transform(parts, lambda p: p["letters"]), "").alias("audit")), "audits")
    ends = decided.filter("last").select("name", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    summary = ends.join(audits.withColumnRenamed("name", "of"), F.col("name").eqNullSafe(F.col("of"))).select(
        F.col("name").cast(kind).alias(conv), *ends.columns[1:], "audit")
    edits = audits.select("name", F.col("audit").alias("letters"), F.lit(0).alias("nth"))
    told = base.withColumn("nth", F.lit(1)).unionByName(edits, allowMissingColumns=True)
    repaired = streamed(told, "nth", "turn", "role", "digest").select("name", "letters", "role", "text").mapInPandas(rewrite, REPAIRED)
    return Repair(summary, repaired.select(F.col("name").cast(kind).alias(conv), "place", "role", "text", "edit"))


def digests(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``(conv, sha256)`` over ``role:text`` of a repair's rows, joined by newlines; no shuffle, since they come in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made, out = None, None, []
        for name, role, text in tuples(frames):
            if made is None or now != name:
                if made is not None:
                    out.append((now, made.hexdigest()))
                now, made = name, hashlib.sha256()
            else:
                made.update(b"\n")
            made.update(f"{role}:{text}".encode())
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["name", "sha256"], dtype=object)
                out = []
        if made is not None:
            out.append((now, made.hexdigest()))
        yield pd.DataFrame(out, columns=["name", "sha256"], dtype=object)

    kind = rows.schema[conv].dataType
    found = rows.select(F.col(conv).cast("string").alias("name"), "role", "text").mapInPandas(run, "name string, sha256 string")
    return found.select(F.col("name").cast(kind).alias(conv), "sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fault in a fifth to a quarter of their rows, decided by the CRC-32 of ``conv_id:turn``."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hit = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.withColumn("hit", hit).filter("hit <> 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


@query("op11_conversation_repair")
def op11_conversation_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    summary, rows = repair(damaged(given), every=given)
    hashed = digests(rows).withColumnRenamed("conv_id", "of")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return summary.join(hashed, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        *summary.columns, F.coalesce("sha256", nothing).alias("repaired_sha256"))
