"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

All suffixes of a corpus are first put into buckets by their leading bytes (the
first depth). A bucket with one suffix is settled. Suffixes of open buckets are
refined by the buckets of their suffixes at a later offset: the bucket at the next
depth comes from the pair of buckets at the present one, and the refined buckets
serve to refine again, until the depth is the length asked for. A suffix goes on
only if the buckets of all its later offsets, as far as the length reaches, are open
as well; the texts shrink to the runs of such suffixes from depth to depth.

Buckets are named by hashes instead of ranks, so every task gives equal strings
equal names without asking. Before the last depth, names are cut to a few bits
more than there are suffixes: a bucket that is open only by chance costs a look at
the next depth, where a settled one would be wrong. For the same reason only a
quarter of the buckets before the last depth, chosen by name, is counted; the others
stay open. A string that is unique has dozens of counted buckets, and one that
is settled is enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.llm.base import query, small_batches, table, written
from catalumen.llm.hashing import BASE, BYTE_VALUES, U, mix
from catalumen.llm.packs import Pack, answer, answer_short, n_buckets, packed, replies_in, send, send_short, with_replies

LENGTH = 200
# Depth of the first buckets, a power of two.
FIRST = 64
# Names are made for this many positions at a time, which stay in a processor's cache.
CHUNK = 1 << 16
# Room for names before the last depth: half of it is taken, so about two in five unique suffixes look open, and
# a run of them as long as a string that would go on has no chance worth counting.
SPARE_BITS = 1
# Of the buckets before the last depth one in two to this power is counted.
SHARE_BITS = 2
RUNS = "pack long, keys array<long>, ends array<long>, data binary, size long"


def depths(first: int, length: int) -> list[int]:
    """The first depth, doubled as long as it is less than ``length``, then ``length``."""
    if not 2 <= first <= length or first & (first - 1):
        raise ValueError("the first depth is a power of two, 2 or more and no deeper than the length")
    out = [first]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def names(data: np.ndarray, levels: list[int]) -> np.ndarray:
    """Names of all strings of ``levels[-1]`` bytes, each level's from two names at the level before."""
    out, depth = BYTE_VALUES[data], 1
    while depth < levels[0]:
        out = out[:max(0, len(out) - depth)] * U(pow(int(BASE), depth, 1 << 64)) + out[depth:]
        depth *= 2
    out = mix(out)
    for shallow, deep in pairwise(levels):
        step = deep - shallow
        out = mix(out[:max(0, len(out) - step)] * BASE + out[step:])
    return out


def top(bits: int) -> np.uint64:
    """A mask of the leading bits."""
    return U(((1 << bits) - 1) << (64 - bits))


class Suffixes:
    """Buckets of the suffixes of a row's texts or runs at one depth, as far as the row alone can tell.

    ``keys`` are the names of the buckets, cut to ``bits`` and sorted; ``where``
    lists the suffixes bucket by bucket and ``times`` says how many each has.
    Of the names, one in ``2**share_bits`` is counted; the buckets of the others are open.
    ``skip`` marks texts that do not take part. Texts shorter than ``length`` do not either.
    """

    def __init__(self, pack: Pack, levels: list[int], length: int, bits: int, share_bits: int = 0, skip: np.ndarray | None = None):
        self.pack, self.depth, self.length = pack, levels[-1], length
        size, n = np.diff(pack.at), max(0, len(pack.data) - self.depth + 1)
        use = size >= length
        if skip is not None:
            use &= ~skip
        name = np.empty(n, U)
        for a in range(0, n, CHUNK):
            b = min(n, a + CHUNK)
            name[a:b] = names(pack.data[a:b + self.depth - 1], levels)
        # The last starts of a text have too few bytes.
        last = np.where(use, pack.at[1:] - self.depth + 1, pack.at[:-1])
        edge = np.zeros(len(pack.data) + 1, np.int8)
        np.add.at(edge, pack.at[:-1][use], 1)
        np.add.at(edge, last[use], -1)
        self.whole = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
        where = np.flatnonzero(self.whole & (name & U((1 << share_bits) - 1) == 0))
        key = name[where] & top(bits)
        places = max(1, len(where) - 1).bit_length()
        if bits + places <= 64:
            # Key and place in one number: sorting plain numbers is much faster than sorting places by keys.
            key = np.sort(key | np.arange(len(where), dtype=U))
            low = U((1 << places) - 1)
            self.where = where[(key & low).astype(np.int64)]
            key &= top(bits)
        else:
            order = np.argsort(key)
            key, self.where = key[order], where[order]
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        self.keys, self.times = key[begin], np.diff(begin, append=len(key))

    def opened(self, elsewhere: np.ndarray | None) -> np.ndarray:
        """For each byte, whether the bucket of its suffix has several; ``elsewhere`` marks keys that other rows have."""
        several = self.times > 1
        if elsewhere is not None:
            several |= elsewhere
        out = np.zeros(len(self.pack.data), bool)
        out[:len(self.whole)] = self.whole
        out[self.where] = np.repeat(several, self.times)
        return out

    def open_runs(self, elsewhere: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the byte runs in which every string of this depth is open, if ``length`` bytes or longer."""
        is_open = self.opened(elsewhere).astype(np.int8)
        turn = np.diff(is_open, prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + self.depth - 1
        long = end - start >= self.length
        return start[long], end[long]


class Copies:
    """Whole texts that other texts equal: by a name of the text, and which of this pack's own come first."""

    def __init__(self, pack: Pack, length: int):
        size = np.diff(pack.at)
        long = np.flatnonzero(size >= length)
        name = np.array([int.from_bytes(hashlib.blake2b(
            pack.data[pack.at[i]:pack.at[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in long], U)
        self.texts = long
        self.keys, first, self.key_of, times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        self.here = times > 1
        self.later = np.ones(len(long), bool)
        self.later[first] = False


def stood_for(pack: Pack, length: int, replies: dict) -> np.ndarray:
    """Texts for which an equal one, in this pack or in one with a smaller number, stands."""
    copies, out = Copies(pack, length), np.zeros(len(pack.at) - 1, bool)
    none = np.zeros(len(copies.keys), bool)
    out[copies.texts] = copies.later | replies.get("earlier", none)[copies.key_of]
    return out


def copied(pack: Pack, length: int, replies: dict) -> np.ndarray:
    """Texts that equal another one."""
    copies, out = Copies(pack, length), np.zeros(len(pack.at) - 1, bool)
    none = np.zeros(len(copies.keys), bool)
    out[copies.texts] = (copies.here | replies.get("copies", none))[copies.key_of]
    return out


def refined(rows: DataFrame, levels: list[int], length: int, whole_texts: DataFrame | None = None) -> DataFrame:
    """The runs of ``rows`` whose suffixes stay open at depth ``levels[-1]``; rows as ``packed`` gives them.

    ``keys`` of the result are the places in the pack at which the runs start. At
    the last depth names are whole, and the runs are the repeated bytes. With
    ``whole_texts``, replies on copies, ``rows`` are packs: a copy that another
    text stands for takes no part beyond its own pack.
    """
    name, last, of_packs = f"open{levels[-1]}", levels[-1] == length, whole_texts is not None
    share_bits = 0 if last else SHARE_BITS
    counted = int(rows.agg(F.sum("size")).first()[0] or 0) >> share_bits
    # Short names make light rows, so a range of them may hold four times as many.
    buckets = n_buckets(rows, 1 if last else 1 / (4 << share_bits))
    width = buckets.bit_length() - 1
    bits = 64 if last else min(64, max(width + 1, counted.bit_length() + SPARE_BITS))

    def suffixes(pack: Pack) -> Suffixes:
        # Copies in a pack are left out before anything is sent; of copies in several packs each pack sends one.
        return Suffixes(pack, levels, length, bits, share_bits, stood_for(pack, length, {}) if of_packs else None)

    def own_keys(pack: Pack, _) -> tuple[np.ndarray, None]:
        return suffixes(pack).keys, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in range(batch.num_rows):
                pack, replies = Pack(batch, row), replies_in(batch, row)
                start, end = suffixes(pack).open_runs(replies.get(name))
                text = np.searchsorted(pack.at, start, "right") - 1
                if of_packs:
                    go_on = ~stood_for(pack, length, replies)[text]
                    start, end = start[go_on], end[go_on]
                    place = start
                else:
                    place = pack.keys.to_numpy()[text] + (start - pack.at[text])
                if not len(start):
                    continue
                data = b"" if last else b"".join(pack.data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist()))
                ends = np.cumsum(end - start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pack.number], pa.int64()), pa.array([place], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())),
                     pa.array([press.compress(data)], pa.binary()), pa.array([int(ends[-1])], pa.int64())],
                    ["pack", "keys", "ends", "data", "size"])

    if last:
        found = answer(send(rows, own_keys, buckets), name)
    else:
        found = answer_short(send_short(rows, own_keys, buckets, bits - width), name, bits - width)
    answers = [written(found, name)]
    if of_packs:
        answers.append(whole_texts)
    # Rows and replies grow together: one plan for all sizes.
    return written(with_replies(rows.hint("merge"), *answers).mapInArrow(run, RUNS), f"runs{levels[-1]}")


def dedup_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept)`` for every row; ``kept`` are the remaining UTF-8 bytes.

    A byte goes if a string of ``length`` bytes covers it that also starts
    anywhere else, in the same text or another; strings never cross texts.
    ``n_spans`` counts the runs of removed bytes. A null text is empty. Null and
    repeated keys keep their rows, and repeated rows are copies of each other.
    """
    levels = depths(first, length)
    packs = written(packed(docs, key, text), "packs")
    small_batches(docs.sparkSession)

    def whole(pack, _):
        found = Copies(pack, length)
        return found.keys, np.full(len(found.keys), pack.number)

    few = n_buckets(packs, 1 / 2000)
    whole_texts = written(answer(send(packs, whole, few), "copies").unionByName(
        answer(send(packs, whole, few, ranked=True), "earlier")), "copies")
    runs = refined(packs, levels[:1], length, whole_texts)
    for i in range(1, len(levels)):
        runs = refined(runs, levels[:i + 1], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pack, n = Pack(batch, row), int(batch.column("size")[row].as_py())
                cut = np.repeat(copied(pack, length, replies_in(batch, row)), np.diff(pack.at))
                if batch.column("starts")[row].is_valid:
                    start = batch.column("starts")[row].values.to_numpy()
                    size = np.diff(batch.column("run_ends")[row].values.to_numpy(), prepend=0)
                    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
                    cut |= np.cumsum(edge[:n]) > 0
                rows = []
                for i in range(len(pack.at) - 1):
                    own, out = pack.data[pack.at[i]:pack.at[i + 1]], cut[pack.at[i]:pack.at[i + 1]]
                    n_out = int(np.count_nonzero(out))
                    spans = int(out[0]) + int(np.count_nonzero(out[1:] > out[:-1])) if n_out else 0
                    rows.append((len(own), n_out, spans, own[~out].tobytes() if n_out else own.tobytes()))
                sizes, removed, spans, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pack.keys, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                     pa.array(kept, pa.binary())], ["key", "n_bytes", "n_removed", "n_spans", "kept"])

    found = runs.select("pack", F.col("keys").alias("starts"), F.col("ends").alias("run_ends"))
    out = with_replies(packs.hint("merge"), whole_texts).join(found.hint("merge"), "pack", "left").mapInArrow(
        run, "key long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("key", key)


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    return dedup_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
