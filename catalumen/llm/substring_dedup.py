"""Removal of repeated word windows by difference-cover anchors.

Positions of a text whose remainder modulo the period is in the cover are
anchors. For any two positions there is a step below the period that takes both
to cover positions, so two equal windows hold an equal, equally placed anchor run
of ``window - period + 1`` words. Only those runs are compared at first, at a
part of all positions; around the ones that another document has too, they are
extended to whole windows, and these are compared by their smallest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.llm.base import query, small_batches, table, written
from catalumen.llm.hashing import U, WordRun
from catalumen.llm.packs import Pack, answer, n_buckets, packed, replies_in, send, with_replies

WINDOW = 13
# Every number below the period is a difference of two cover numbers, modulo the period.
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR_BITS = 32


class Words:
    """The words of a pack, its anchors, and their keys."""

    def __init__(self, pack: Pack, window: int):
        self.run = WordRun(pack.data, pack.at)
        hashes, start = self.run.windows(window - PERIOD + 1, seed=11)
        cover = np.isin((start - self.run.upto[self.run.of[start]]) % PERIOD, COVER)
        self.start = start[cover]
        self.keys, self.key_of = np.unique(hashes[cover], return_inverse=True)
        # Anchors that two texts of this pack share need no answer.
        owner = self.run.of[self.start]
        low, high = np.full(len(self.keys), len(pack.order)), np.full(len(self.keys), -1)
        np.minimum.at(low, self.key_of, owner)
        np.maximum.at(high, self.key_of, owner)
        self.here = low < high


class Windows:
    """The whole windows around shared anchors, and the smallest document of this pack that has each."""

    def __init__(self, pack: Pack, words: Words, answered: np.ndarray, window: int):
        run = words.run
        shared = np.zeros(len(run.hash) + 1, np.int64)
        shared[words.start[(words.here | answered)[words.key_of]] + 1] = 1
        before = np.cumsum(shared)
        hashes, start = run.windows(window, seed=12)
        # A window holds the anchor runs that start at its first PERIOD words.
        near = before[np.minimum(start + PERIOD, len(run.hash))] > before[start]
        self.start = start[near]
        self.order = pack.order[run.of[self.start]]
        self.keys, self.key_of = np.unique(hashes[near], return_inverse=True)
        self.least = np.full(len(self.keys), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.key_of, self.order)


def removed_words(n_words: int, start: np.ndarray, window: int) -> np.ndarray:
    """True for each word that one of the windows covers."""
    edge = np.bincount(start, minlength=n_words + 1) - np.bincount(start + window, minlength=n_words + 1)
    return np.cumsum(edge[:n_words]) > 0


def dedup_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(key, n_words, n_removed, text)`` for every row of ``docs``; ``text`` is the kept words joined by one blank.

    A word goes if a window of ``window`` words of its document covers it whose
    words also start in a document with a smaller key. A null text has no
    words. A row without a key counts as larger than all others; rows that share
    a key never remove each other's words. Other columns are not read.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    packs = written(packed(docs, key, text), "packs")
    small_batches(docs.sparkSession)

    def anchors(pack, _):
        return Words(pack, window).keys, None

    # A word takes about six bytes.
    first = written(answer(send(packs, anchors, n_buckets(packs, len(COVER) / PERIOD / 6), ANCHOR_BITS), "anchors"), "anchors")

    def windows(pack, replies):
        found = Windows(pack, words := Words(pack, window), replies.get("anchors", np.zeros(len(words.keys), bool)), window)
        return found.keys, found.least

    second = answer(send(with_replies(packs, first), windows, n_buckets(packs, 1 / 24), ranked=True), "windows")
    second = written(second, "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pack, replies = Pack(batch, row), replies_in(batch, row)
                words = Words(pack, window)
                found = Windows(pack, words, replies.get("anchors", np.zeros(len(words.keys), bool)), window)
                smaller = replies.get("windows", np.zeros(len(found.keys), bool))
                gone = smaller[found.key_of] | (found.least[found.key_of] < found.order)
                cut = removed_words(len(words.run.hash), found.start[gone], window)
                upto = np.concatenate([[0], np.cumsum(cut)])[words.run.upto]
                texts = []
                for i in range(len(pack.order)):
                    own = pack.data[pack.at[i]:pack.at[i + 1]].tobytes().split()
                    if upto[i + 1] > upto[i]:
                        keep = ~cut[words.run.upto[i]:words.run.upto[i + 1]]
                        own = [own[j] for j in np.flatnonzero(keep).tolist()]
                    texts.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [pack.keys, pa.array(np.diff(words.run.upto), pa.int64()), pa.array(np.diff(upto), pa.int64()),
                     pa.array(texts, pa.binary()).cast(pa.string())], ["key", "n_words", "n_removed", "text"])

    out = with_replies(packs, first, second).mapInArrow(run, "key long, n_words long, n_removed long, text string")
    return out.withColumnRenamed("key", key)


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    return dedup_windows(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
