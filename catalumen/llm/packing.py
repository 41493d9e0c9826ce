"""Packing token runs into sequences: exact complements by hashed length sums, best fit for the rest.

Texts become pieces of at most a sequence's length. Only the histogram of piece
lengths, one number for each length, reaches the driver; there, sums of one,
two and three lengths that exactly fill a gap are used up as often as the
counts allow, and what is left is packed best fit. The plan says how many times
each combination is used; pieces find their place in it by their rank among the
pieces of their length, which Spark counts.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalumen.llm.base import query, row_slices, small_batches, table, written

CAPACITY = 2048
END_ID = 0
# Ranks are counted in this many parts of each length, so that no length is one task's work.
RANK_PARTS = 256
# A task remembers the ids of up to twice as many runs of characters.
REMEMBERED = 250_000

# Texts of these characters, and without the marks of special tokens, need no Unicode normalisation.
PLAIN = re.compile(r"[\x20-\x7e\t\n\rÀ-ÖØ-öø-ÿ]*")
# The vocabulary's own pre-tokens (a fixed pattern), for lower-case plain text.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
WORD_END = b"\xff"


class WordBpe:
    """Ids of the word-end BPE vocabulary; equal to the tokenizer's own, which does all texts that are not plain.

    Tokens are byte strings; the end of a word is one more byte that no UTF-8
    text has. Ids of a vocabulary file are in the order of its merges, so they
    serve as ranks. A run of characters between blanks is encoded once and
    remembered.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        of_char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {}
        for token, i in vocabulary.items():
            ended = token.endswith("</w>") and len(token) > 4
            body = token[:-4] if ended else token
            ranks[bytes(of_char[c] for c in body) + (WORD_END if ended else b"")] = i
        self.encode_word = tiktoken.Encoding(
            "words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def run_ids(self, run: str) -> bytes:
        """Ids of a run that is not among the recent ones; what has not been met for long is forgotten."""
        found = self.older.get(run)
        if found is None:
            ids = array("I")
            for word in PRETOKEN.findall(run.lower()):
                ids.extend(self.encode_word(word.encode() + WORD_END))
            found = ids.tobytes()
        if len(run) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[run] = found
        return found

    def ids(self, text: str) -> bytes:
        """Ids of a text as unsigned little-endian 32-bit numbers."""
        if PLAIN.fullmatch(text) is None or "<|" in text:
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, slow = self.known, self.run_ids
        return b"".join([known.get(run) or slow(run) for run in text.split()])


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece, start, length, ids)``: each text's ids and the end id, cut every ``capacity`` ids.

    ``ids`` are unsigned little-endian 32-bit numbers. A null or empty text is
    the end id alone. Null and repeated keys keep their rows.
    """
    small_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for batch in batches:
            for part in row_slices(batch, "text", 1 << 20):
                where, piece, ids = [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    own = (bpe.ids(t) if t else b"") + end
                    for n, a in enumerate(range(0, len(own), 4 * capacity)):
                        where.append(i)
                        piece.append(n)
                        ids.append(own[a:a + 4 * capacity])
                number = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(where, pa.int64())), pa.array(number, pa.int32()),
                     pa.array(number * capacity), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["key", "piece", "start", "length", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, piece int, start long, length long, ids binary")
    return found.withColumnRenamed("key", key)


class LengthSums:
    """Which sums the available lengths make, one, two or three at a time; made anew when a length runs out."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.renew()

    def renew(self) -> None:
        self.one = self.left > 0
        self.one[0] = False
        n = len(self.one)
        waves = np.fft.rfft(self.one, 2 * n)
        self.two = np.rint(np.fft.irfft(waves * waves, 2 * n))[:n] > 0

    def enough(self, lengths: list[int]) -> int:
        """How many times the lengths can be taken together."""
        return min(int(self.left[x]) // n for x, n in Counter(lengths).items())

    def fill(self, length: int, gap: int) -> list[int] | None:
        """One, two or three lengths that exactly fill ``gap`` beside ``length``; the largest first."""
        if self.one[gap] and self.enough([length, gap]):
            return [gap]
        if self.two[gap]:
            for a in np.flatnonzero(self.one[:gap] & self.one[gap:0:-1])[::-1].tolist():
                if 2 * a < gap:
                    break
                if self.enough([length, a, gap - a]):
                    return [a, gap - a]
        for a in np.flatnonzero(self.one[:gap] & self.two[gap:0:-1])[::-1].tolist():
            if 3 * a < gap:
                break
            rest = gap - a
            for b in np.flatnonzero(self.one[:rest] & self.one[rest:0:-1])[::-1].tolist():
                if 2 * b < rest:
                    break
                if self.enough([length, a, b, rest - b]):
                    return [a, b, rest - b]
        return None


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(times, lengths)`` that use every length exactly ``counts`` times, no sequence longer than ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = [(int(left[capacity]), (capacity,))] if left[capacity] else []
    left[capacity] = 0
    sums = LengthSums(left)
    for length in range(capacity - 1, 0, -1):
        while left[length] and (found := sums.fill(length, capacity - length)):
            lengths = [length, *found]
            times = sums.enough(lengths)
            for x in lengths:
                left[x] -= times
            out.append((times, tuple(lengths)))
            if not left[lengths].all():
                sums.renew()
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Longest first, each into the fullest open sequence that takes it; equal sequences are kept as one entry."""
    groups: dict[int, Counter] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in groups:
            groups[gap] = Counter()
            insort(gaps, gap)
        groups[gap][lengths] += n

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                group = groups[gaps[at]]
                lengths, have = next(iter(group.items()))
                used = min(n, have)
                group[lengths] -= used
                if not group[lengths]:
                    del group[lengths]
                if not group:
                    del groups[gaps.pop(at)]
                put((*lengths, length), used)
                n -= used
            else:
                fit = capacity // length
                whole, rest = divmod(n, fit)
                if whole:
                    put((length,) * fit, whole)
                if rest:
                    put((length,) * rest, 1)
                n = 0
    return [(n, lengths) for group in groups.values() for lengths, n in group.items()]


def slots(spark: SparkSession, plan: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """One row for each length: which ranks go to which sequences, and where in them."""
    used: Counter = Counter()
    of_length: dict[int, list] = {}
    sequence = 0
    for times, lengths in plan:
        offset = 0
        for x in lengths:
            of_length.setdefault(x, []).append((used[x], used[x] + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return spark.createDataFrame(
        list(of_length.items()),
        "length long, places array<struct<first:long,beyond:long,sequence:long,at:long>>")


def ranked(pieces: DataFrame, key: str) -> DataFrame:
    """``rank`` from 0 among the pieces of the same length, counted in parts."""
    parts = max(RANK_PARTS, 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = pieces.withColumn("__part", F.pmod(F.xxhash64(key, "piece"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("length", "__part").orderBy(key, "piece"))
    return split.withColumn("__inside", inside).join(starts, ["length", "__part"]).withColumn(
        "rank", F.col("__before") + F.col("__inside") - 1).drop("__part", "__inside", "__before")


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; no sequence has a gap or more than ``capacity`` ids.

    ``pieces`` must give the same rows each time it is read, so pass a written
    table. It needs the columns ``key``, ``piece`` and ``length``; others are kept.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The plan has at most a few entries for each length, whatever the number of pieces.
    places = F.broadcast(slots(pieces.sparkSession, combinations(counts, capacity)))
    found = ranked(pieces, key).join(places, "length").withColumn("__place", F.element_at(F.filter(
        "places", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["beyond"])), 1))
    return found.select(
        *pieces.columns, (F.col("__place.sequence") + F.col("rank") - F.col("__place.first")).alias("sequence_id"),
        F.col("__place.at").alias("offset"))


def sequences(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``(sequence_id, ids, parts)``: the packed sequences themselves, with (key, piece, offset) of their parts."""
    part = F.struct("offset", F.col(key).alias("key"), "piece", "ids")
    rows = pack(pieces, key, capacity).groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"),
                       F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with a checksum of their ids in place of the ids, and their places."""
    cut = pieces(docs, path, key, text).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(written(cut, "pieces"), key)


@query("op3_packing")
def op3_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
