"""Benchmark decontamination: CGK walks and bit sampling over item-sized windows, then exact edit distance.

Words are the letters of the alphabet: distance counts inserted, deleted and
replaced words. A CGK walk copies a window's words to an output and steps on or
stays by a random bit of the word, so that windows at a small edit distance
give outputs at a small Hamming distance; a few sampled places of the output
make a key, and many walks reach the recall. Only windows that can be near an
item are walked: each edit spoils one word and two pairs of neighbours, so
enough words and pairs of the window must occur in the items at all.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.llm.base import flat_bytes, query, row_slices, small_batches, table
from catalumen.llm.hashing import U, mix, powers, randoms

# An item is found at up to this share of its words as edits.
TOLERANCE = 0.15
# Walks and sampled places of each: at the full tolerance they find at least 97 of 100 (see the tests).
WALKS = 48
PLACES = 3
# Window sizes grow by this factor; an item is looked for by its first words, as many as the next smaller size has.
SIZE_STEP = 1.15
# Walks drift apart with the number of edits: longer items are cut into parts of about so many words, each looked for alone.
PART_WORDS = 60
# Items of one pass over the documents, at most.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20
# Text bytes of one piece of work: some sixty bytes of arrays stand for each of them at a time.
SLICE_BYTES = 1 << 20
VOCABULARY_BITS = 23
# A filter does not look for items of fewer words: a single word or a phrase stands in clean documents as well.
LEAST_WORDS = 5


class Letters(NamedTuple):
    """What each code point is: 0 no part of a word, 1 a letter, digit or mark of a word, 2 a word by itself; and its value in lower case."""

    kind: np.ndarray
    value: np.ndarray


# Scripts that write no blanks between words: Thai to Lao, Myanmar, Khmer, Kana, Han.
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
         (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x2FFFF))
CODE_POINTS = 0x30000


def letter_table() -> Letters:
    """By Unicode category: letters, digits and marks make words, all else separates them; built once, it travels with the items."""
    kind, fold = np.zeros(CODE_POINTS + 1, np.uint8), np.arange(CODE_POINTS + 1, dtype=U)
    for c in range(CODE_POINTS):
        text = chr(c)
        if unicodedata.category(text)[0] in "LNM":
            kind[c] = 1
            small = text.lower()
            if len(small) == 1:
                fold[c] = ord(small)
    for low, high in ALONE:
        kind[low:high + 1] *= 2
    # What lies behind the table is Han.
    kind[CODE_POINTS] = 2
    return Letters(kind, mix(fold + U(1)))


class LetterRun:
    """Words of texts in a row: runs of letters, digits and marks in lower case; in scripts without blanks each letter is a word.

    ``start``, ``end`` and ``at`` (the texts' own starts) count code points.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, letters: Letters):
        code = data
        if len(data) and data.max() > 127:
            try:
                code = np.minimum(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), CODE_POINTS)
                at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
            except UnicodeDecodeError:
                # Not UTF-8: bytes are taken as they are.
                pass
        kind = letters.kind[code]
        inner, alone = kind > 0, kind == 2
        first, last = inner.copy(), inner.copy()
        joined = inner[1:] & inner[:-1] & ~alone[1:] & ~alone[:-1]
        first[1:] &= ~joined
        last[:-1] &= ~joined
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(code))]
        first[edges], last[edges - 1] = inner[edges], inner[edges - 1]
        self.at, self.start, self.end = at, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.upto = np.searchsorted(self.start, at)
        self.hash = np.zeros(0, U)
        if len(self.start):
            length = self.end - self.start
            begin = np.concatenate([[0], np.cumsum(length)])[:-1]
            where = np.flatnonzero(inner)
            place = np.arange(len(where)) - np.repeat(begin, length)
            terms = letters.value[code[where]] * powers(int(length.max()))[place]
            self.hash = mix(np.add.reduceat(terms, begin) + length.astype(U)) | U(1)


def words_of(text: str, letters: Letters) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return LetterRun(data, np.array([0, len(data)]), letters).hash


def sizes(most: int) -> list[int]:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * SIZE_STEP)))
    return out


def walk_plan(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Random multipliers and sampled places of all walks over ``size`` words: (step, walk) each."""
    steps = 2 * size
    random = randoms(steps * WALKS, size).reshape(steps, WALKS)
    rng = np.random.Generator(np.random.PCG64(size))
    order = rng.permuted(np.tile(np.arange(steps), (WALKS, 1)), axis=1)
    sampled = np.zeros((steps, WALKS), bool)
    for walk in range(WALKS):
        sampled[order[walk, :min(PLACES, steps)], walk] = True
    return random, sampled


def walk_keys(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``WALKS`` keys of each window of ``size`` words: (walk, window). Beyond the last word, words count as zero."""
    random, sampled = walk_plan(size)
    near = np.minimum(starts[:, None] + np.arange(size), len(words))
    window = np.append(words, U(0))[near]
    # Zeros behind each window, as far as a walk can get.
    window = np.hstack([window, np.zeros((len(starts), size + 1), U)]).ravel()
    base = np.arange(len(starts)) * (2 * size + 1)
    here = np.tile(base, (WALKS, 1))
    seen = np.zeros((PLACES, WALKS, len(starts)), U)
    count = np.zeros(WALKS, int)
    going = np.arange(WALKS)
    last = sampled.shape[0] - 1 - sampled[::-1].argmax(0)
    for step in range(int(last.max()) + 1):
        keep = last[going] >= step
        if not keep.all():
            going, here = going[keep], here[keep]
        now = window.take(here)
        for row in np.flatnonzero(sampled[step, going]).tolist():
            walk = going[row]
            seen[count[walk], walk] = now[row]
            count[walk] += 1
        now *= random[step, going, None]
        now >>= U(63)
        here += now.view(np.int64)
    key = np.arange(WALKS, dtype=U)[:, None] * U(1009) + U(size)
    for words_there in seen:
        key = mix(key ^ words_there)
    return key


def nearest_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the run of ``words`` with the least edit distance to ``item``; the first such end."""
    cost = np.zeros(len(words) + 1, np.int64)
    begin = np.arange(len(words) + 1)
    place = np.arange(len(words) + 1)
    for w in item:
        # Replace or match, then delete the item's word; insertions come after, in one pass over running minima.
        diagonal = np.concatenate([[1 << 40], cost[:-1] + (words != w)])
        down = cost + 1
        better = diagonal <= down
        new = np.where(better, diagonal, down)
        origin = np.where(better, np.concatenate([[0], begin[:-1]]), begin)
        slack = new - place
        least = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == least, place, 0))
        source = np.where(slack[source] == least, source, place)
        cost, begin = least + place, origin[source]
    at = int(cost.argmin())
    return int(cost[at]), int(begin[at]), at


@dataclass
class Block:
    """Some items, by window size: sorted keys of each walk with the part behind each; and all words and pairs."""

    ids: list
    words: list[np.ndarray]
    parts: list[tuple[int, int, int]]  # item, words before the part, edits it is found at
    keys: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    vocabulary: np.ndarray
    pairs: np.ndarray
    times: np.ndarray  # how often an item has the pair, at most
    letters: Letters


def pair_slots(words: np.ndarray) -> np.ndarray:
    """Slot of each word and the word after it in the table of pairs."""
    return mix(words[:-1] * U(0x9E3779B97F4A7C15) + words[1:]) >> U(64 - VOCABULARY_BITS)


def before_each(marks: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(marks)])


def repeats(slot: np.ndarray, good: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of good pairs that have occurred ``times`` times before, and where the first of these last ``times`` is."""
    where = np.flatnonzero(good)
    order = where[slot[where].argsort(kind="stable")]
    most = times[slot[order]].astype(np.int64)
    back = np.arange(len(order)) - most
    # 255 stands for any higher number as well.
    some = (back >= 0) & (most < 255) & (slot[order[np.maximum(back, 0)]] == slot[order])
    return order[some], order[back[some]]


def block_of(items: list[tuple], letters: Letters) -> Block:
    runs = [words_of(t, letters) for _, t in items]
    steps = sizes(max(map(len, runs), default=1))
    by_size: dict[int, list[int]] = {}
    parts = []
    for i, run in enumerate(runs):
        if len(run):
            count = max(1, round(len(run) / PART_WORDS))
            size = max(s for s in steps if s <= len(run) // count)
            for k in range(count):
                by_size.setdefault(size, []).append(len(parts))
                # Of all edits, some part has no more than its share.
                parts.append((i, k * (len(run) // count), int(len(run) * TOLERANCE) // count))
    vocabulary, pairs = np.zeros((2, 1 << VOCABULARY_BITS), bool)
    most = np.zeros(1 << VOCABULARY_BITS, np.uint8)
    for run in runs:
        vocabulary[run >> U(64 - VOCABULARY_BITS)] = True
        own, times = np.unique(pair_slots(run), return_counts=True)
        pairs[own] = True
        most[own] = np.maximum(most[own], np.minimum(times, 255))
    keys = {}
    for size, own in by_size.items():
        flat = np.concatenate([runs[i][a:a + size] for i, a, _ in (parts[p] for p in own)])
        found = walk_keys(flat, np.arange(len(own)) * size, size)
        order = found.argsort(1, kind="stable")
        keys[size] = [(found[w][o], np.array(own)[o]) for w, o in enumerate(order)]
    return Block([i for i, _ in items], runs, parts, keys, vocabulary, pairs, most, letters)


def candidates(run: LetterRun, block: Block) -> set[tuple[int, int, int]]:
    """(text, item, first word) of windows that share a key with a part of an item; the word is where the item would begin."""
    out: set[tuple[int, int, int]] = set()
    if not len(run.hash):
        return out
    words = before_each(block.vocabulary[run.hash >> U(64 - VOCABULARY_BITS)])
    of = np.repeat(np.arange(len(run.upto) - 1), np.diff(run.upto))
    stop = run.upto[1:][of]
    slot = pair_slots(run.hash)
    good = block.pairs[slot] & (of[1:] == of[:-1])
    pairs = before_each(good)
    again, since = repeats(slot, good, block.times)
    for size, walks in block.keys.items():
        # A window that begins near the end of its text may lack the words that edits have cut off.
        end = np.minimum(np.arange(len(of)) + size, stop)
        edits = max(block.parts[p][2] for p in walks[0][1])
        # The same pair over and over counts no oftener in a window than an item has it.
        first = np.maximum(run.upto[of[again]], again + 2 - size)
        here = since >= first
        extra = np.cumsum(np.bincount(first[here], minlength=len(of) + 1) - np.bincount(since[here] + 1, minlength=len(of) + 1))[:-1]
        starts = np.flatnonzero((words[end] - words[:-1] >= size - edits)
                                & (pairs[end - 1] - pairs - extra >= size - 1 - 2 * edits))
        for a in range(0, len(starts), 2048):
            some = starts[a:a + 2048]
            # Windows and the parts they share a key with, each pair once however many walks agree.
            pairs_here = []
            for (keys, parts), own in zip(walks, walk_keys(run.hash, some, size)):
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                hit = np.flatnonzero(high > low)
                many = high[hit] - low[hit]
                place = np.arange(many.sum()) + np.repeat(low[hit] - np.cumsum(many) + many, many)
                pairs_here.append(np.unique(np.repeat(some[hit], many) * len(block.parts) + parts[place]))
            window, part = np.divmod(np.unique(np.concatenate(pairs_here)), len(block.parts))
            for w, p in zip(window.tolist(), part.tolist()):
                item, before, _ = block.parts[p]
                out.add((int(of[w]), item, w - before))
    return out


def matches(run: LetterRun, block: Block) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, distance, start, end) of the best verified place of each item in each text, in words of the run."""
    grouped: dict[tuple[int, int], list[int]] = {}
    for text, item, start in candidates(run, block):
        grouped.setdefault((text, item), []).append(start)
    for (text, item), starts in sorted(grouped.items()):
        words = block.words[item]
        most = int(len(words) * TOLERANCE)
        best, done = None, -1
        for start in sorted(starts):
            if start < done:
                continue
            # Edits before the part move the item's begin by up to ``most`` words; starts before ``done`` are covered as well.
            first = max(int(run.upto[text]), start - most)
            done = start + most + 1
            last = min(int(run.upto[text + 1]), done + len(words) + 2 * most)
            if last <= first:
                continue
            near = run.hash[first:last]
            # Cheaper than the distance, and no place within it fails this: enough of the item's pairs are here.
            if np.isin(pair_slots(words), pair_slots(near)).sum() < len(words) - 1 - 2 * most:
                continue
            distance, a, b = nearest_run(words, near)
            if distance <= most and (best is None or distance < best[0]):
                best = (distance, first + a, first + b)
        if best:
            yield text, item, *best


def item_blocks(benchmark: DataFrame, item: str, text: str, letters: Letters, least: int) -> Iterator[list[tuple]]:
    """The items of at least ``least`` words in blocks of bounded size; only one block at a time is held."""
    block, size = [], 0
    for row in benchmark.filter(F.col(text).isNotNull()).select(item, text).toLocalIterator():
        if len(words_of(row[1], letters)) < least:
            continue
        block.append((row[0], row[1]))
        size += len(row[1])
        if len(block) == BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def short_items(benchmark: DataFrame, item: str = "item_id", text: str = "text", least_words: int = LEAST_WORDS) -> list:
    """Items that a search with this ``least_words`` leaves out."""
    letters = letter_table()
    return [r[0] for r in benchmark.select(item, text).toLocalIterator() if r[1] is None or len(words_of(r[1], letters)) < least_words]


def sent_blocks(benchmark: DataFrame, item: str, text: str, least: int) -> Iterator:
    """Each block of items as a broadcast of plain arrays, which executors without this package can read."""
    letters = letter_table()
    for items in item_blocks(benchmark, item, text, letters, max(1, least)):
        block = block_of(items, letters)
        plain = [getattr(block, f.name) for f in fields(Block)]
        yield benchmark.sparkSession.sparkContext.broadcast((*plain[:-1], tuple(letters)))


def received(sent) -> Block:
    *parts, letters = sent.value
    return Block(*parts, Letters(*letters))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
               item: str = "item_id", item_text: str = "text", least_words: int = 1) -> DataFrame:
    """``(key, item, distance, start, end)``: the best place of each benchmark item in each document that has it.

    A document has an item if a run of its words is within ``TOLERANCE`` of the
    item's words in edit distance; case, punctuation and blanks of any script do not
    count, and in scripts that write no blanks each letter is a word.
    ``start`` and ``end`` are code points. Null and empty texts match nothing, nor do
    items of fewer than ``least_words`` words (``short_items`` lists them; a search takes
    all that have a word, a filter leaves items out that common phrases would match);
    null or repeated keys keep their rows. The
    benchmark is the query set: its items pass over the documents in blocks of
    bounded size, so nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    key_type, item_type = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"key {key_type}, item {item_type}, distance int, start long, end long"
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = None
    for sent in sent_blocks(benchmark, item, item_text, least_words):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = received(sent)
            of_item = pa.array(block.ids)
            for batch in batches:
                for part in row_slices(batch, "text", SLICE_BYTES):
                    words = LetterRun(*flat_bytes(part.column("text")), block.letters)
                    got = list(matches(words, block))
                    if not got:
                        continue
                    texts, items, distance, first, last = map(np.array, zip(*got))
                    base = words.at[texts]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(texts)), of_item.take(pa.array(items)), pa.array(distance, pa.int32()),
                         pa.array(words.start[first] - base), pa.array(words.end[last - 1] - base)], ["key", "item", "distance", "start", "end"])

        own = rows.mapInArrow(run, schema)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"key": key, "item": item})


def clean_rows(batches: Iterator[pa.RecordBatch], text: str, block: Block) -> Iterator[pa.RecordBatch]:
    """The rows in whose text no item of the block is found."""
    for batch in batches:
        for part in row_slices(batch, text, SLICE_BYTES):
            clean = np.ones(part.num_rows, bool)
            clean[[m[0] for m in matches(LetterRun(*flat_bytes(part.column(text)), block.letters), block)]] = False
            yield part.filter(pa.array(clean))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text no benchmark item of ``least_words`` words or more is found."""
    small_batches(docs.sparkSession)
    schema = docs.schema
    for sent in sent_blocks(benchmark, "item_id", "text", least_words):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from clean_rows(batches, text, received(sent))

        docs = docs.mapInArrow(run, schema)
    return docs


@query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
