"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a support vector machine.

Two words are alike as far as they have letters in the same order, with fewer
letters in between counting more, so an insult with inserted or left-out
letters stays near the insult. Landmarks are words that go with the toxic label
and common words; the machine is trained on labelled sentences, each standing by
its witness, the word that now scores highest. Scores are linear in the letter
triples of a word, so the whole model folds into one small table and every text
is scored word by word without looking at landmarks again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.llm.base import flat_bytes, query, row_slices, small_batches, table
from catalumen.llm.near_dup import shingle_sets

# The model is fitted on at most so many labelled texts of each label, those whose texts hash lowest.
TOXIC_ROWS, OTHER_ROWS = 1_000, 2_500
# And on so many bytes of text.
SAMPLE_BYTES = 1 << 25
# Landmarks: words that go with the label, and words that are common elsewhere.
MARKED, COMMON = 128, 192
SENTENCES = 40_000
ROUNDS = 3
DECAY = 0.7
# A triple of letters spans at most so many.
SPAN = 6
# A task remembers the self-kernels of so many words.
REMEMBERED = 100_000
CODES = 32
TRIPLES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
# Digits and signs that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
BLANKS = (32, 9, 10, 11, 12, 13)
SENTENCE_ENDS = tuple(b".!?\n")


def byte_codes() -> np.ndarray:
    """Letters 1 to 26 in either case, letters outside ASCII 27 to 31 by their last byte, all else 0."""
    code = np.zeros(256, np.int32)
    for c in range(26):
        code[65 + c] = code[97 + c] = 1 + c
    for sign, letter in STAND_INS.items():
        code[ord(sign)] = code[ord(letter)]
    code[0x80:0xC0] = 27 + (np.arange(0x80, 0xC0) & 31) % 5
    return code


def least_self_kernel(length: np.ndarray) -> np.ndarray:
    """Root of a word's kernel with itself if no triple of its letters occurs twice, else less; zero below three letters."""
    total = np.zeros(len(length))
    for _, b in TRIPLES:
        total += np.maximum(length - b, 0) * DECAY ** (2 * (b + 1))
    return np.sqrt(total)


@dataclass
class Letters:
    """The letters of texts in a row: code, and the first letter, length and text of each word.

    Words end at blanks; signs inside a word are left out, and single letters
    that follow each other are one word.
    """

    code: np.ndarray
    first: np.ndarray
    length: np.ndarray
    of: np.ndarray
    place: np.ndarray  # byte of each word's first letter


def letters_of(data: np.ndarray, at: np.ndarray) -> Letters:
    code = byte_codes()[data]
    where = np.flatnonzero(code)
    code = code[where]
    blank = np.zeros(256, bool)
    blank[list(BLANKS)] = True
    gap = np.cumsum(blank[data])[where] if len(data) else np.zeros(0, np.int64)
    text = np.searchsorted(at, where, "right") - 1
    if not len(where):
        none = np.zeros(0, np.int64)
        return Letters(code, none, none, none, none)
    starts = np.concatenate([[True], (gap[1:] != gap[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(starts)
    length = np.diff(np.append(first, len(where)))
    own = text[first]
    joins = np.zeros(len(first), bool)
    joins[1:] = (length[1:] == 1) & (length[:-1] == 1) & (own[1:] == own[:-1])
    first = first[~joins]
    return Letters(code, first, np.diff(np.append(first, len(where))), text[first], where[first])


def word_sums(letters: Letters, weights: np.ndarray) -> np.ndarray:
    """For each word the sum of its triples' weights, nearer triples counting more."""
    total = np.zeros(len(letters.code), np.float32)
    word = np.repeat(np.arange(len(letters.first)), letters.length)
    code = letters.code.astype(np.int32)
    for a, b in TRIPLES:
        n = len(code) - b
        if n <= 0:
            break
        slot = code[:n] * CODES
        slot += code[a:a + n]
        slot *= CODES
        slot += code[b:]
        part = weights.take(slot)
        part *= np.float32(DECAY ** (b + 1))
        part *= word[:n] == word[b:]
        total[:n] += part
    return np.add.reduceat(total, letters.first) if len(letters.first) else np.zeros(0, np.float32)


def word_scores(letters: Letters, weights: np.ndarray, bias: float, exact: dict[bytes, float]) -> np.ndarray:
    """What the machine says of each word; words below three letters say nothing.

    The self-kernel is first taken as if no triple occurred twice, which can only
    raise a score; words that might be positive get their own, and ``exact`` remembers it.
    """
    least = least_self_kernel(letters.length)
    sums = word_sums(letters, weights)
    out = np.where(least > 0, sums / np.maximum(least, 1e-9), 0).astype(np.float64) + bias
    code = letters.code.astype(np.uint8)
    for i in np.flatnonzero((out > 0) & (least > 0)).tolist():
        word = code[letters.first[i]:letters.first[i] + letters.length[i]].tobytes()
        root = exact.get(word)
        if root is None:
            root = float(np.linalg.norm(raw_triples(np.frombuffer(word, np.uint8).astype(np.int64))[1]))
            if len(exact) < REMEMBERED:
                exact[word] = root
        out[i] = sums[i] / root + bias
    return out


def raw_triples(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a word's triples and their weights."""
    slots, values = [], []
    for a, b in TRIPLES:
        n = len(code) - b
        if n > 0:
            slots.append((code[:n] * CODES + code[a:a + n]) * CODES + code[b:])
            values.append(np.full(n, DECAY ** (b + 1)))
    if not slots:
        return np.zeros(0, np.int64), np.zeros(0)
    found, back = np.unique(np.concatenate(slots), return_inverse=True)
    return found, np.bincount(back, np.concatenate(values))


def triples_of(words: list[bytes]) -> np.ndarray:
    """Normalised triple features of some words, one row each."""
    out = np.zeros((len(words), CODES**3), np.float32)
    for row, word in zip(out, words):
        slots, values = raw_triples(np.frombuffer(word, np.uint8).astype(np.int64))
        row[slots] = values / max(float(np.linalg.norm(values)), 1e-9)
    return out


def landmark_features(words: list[bytes], fold: np.ndarray, known: dict[bytes, np.ndarray]) -> np.ndarray:
    """Nyström features of words and a constant; ``known`` remembers them."""
    for word in words:
        if word not in known:
            slots, values = raw_triples(np.frombuffer(word, np.uint8).astype(np.int64))
            own = values @ fold[slots] / max(float(np.linalg.norm(values)), 1e-9)
            known[word] = np.append(own, 1.0).astype(np.float32)
    return np.array([known[word] for word in words])


@dataclass
class Model:
    """Weight of each letter triple, the machine's bias, and the line from a text's features to its log-odds."""

    weights: np.ndarray
    bias: float
    line: np.ndarray


EMPTY = Model(np.zeros(CODES**3, np.float32), -1.0, np.array([-3.0, 0.0, 0.0]))


def text_features(letters: Letters, scores: np.ndarray, texts: int) -> np.ndarray:
    """(1, best word score, how many different words score above zero) of each text; no words count as the worst."""
    out = np.zeros((texts, 3))
    out[:, 0] = 1
    out[:, 1] = -1
    if len(scores):
        some, first = np.unique(letters.of, return_index=True)
        out[some, 1] = np.clip(np.maximum.reduceat(scores, first), -1, 1)
        code = letters.code.astype(np.uint8)
        where = np.flatnonzero(scores > 0)
        held = {(letters.of[i], code[letters.first[i]:letters.first[i] + letters.length[i]].tobytes()) for i in where.tolist()}
        out[:, 2] = np.log1p(np.bincount([i for i, _ in held], minlength=texts)) if held else 0
    return out


def hinge(rows: np.ndarray, signs: np.ndarray, cost: np.ndarray, passes: int = 60) -> np.ndarray:
    """Linear support vector machine by dual coordinate ascent; the last column of ``rows`` is constant."""
    alpha, theta = np.zeros(len(rows)), np.zeros(rows.shape[1])
    square = (rows * rows).sum(1)
    rng = np.random.default_rng(0)
    for _ in range(passes):
        # Rows that are right by a margin and carry no weight would not change.
        moving = np.flatnonzero((alpha > 0) | (signs * (rows @ theta) < 1))
        for i in rng.permutation(moving).tolist():
            new = min(max(alpha[i] + (1 - signs[i] * (rows[i] @ theta)) / square[i], 0), cost[i])
            if new != alpha[i]:
                theta += (new - alpha[i]) * signs[i] * rows[i]
                alpha[i] = new
    return theta


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return w


def sample_parts(column: pa.Array) -> tuple[list[Letters], np.ndarray]:
    """The letters of a sample, some texts at a time, and the sentence of each word; all text numbers are the sample's."""
    ends = np.zeros(256, bool)
    ends[list(SENTENCE_ENDS)] = True
    parts, sentences, done, sentence = [], [], 0, 0
    for part in row_slices(pa.RecordBatch.from_arrays([column], ["text"]), "text", 1 << 20):
        data, at = flat_bytes(part.column("text"))
        found = letters_of(data, at)
        found.code = found.code.astype(np.uint8)
        upto = np.cumsum(ends[data]) if len(data) else np.zeros(1, np.int64)
        sentences.append((upto[found.place] + found.of + sentence).astype(np.int64))
        sentence += int(upto[-1]) + part.num_rows
        found.of = found.of + done
        done += part.num_rows
        parts.append(found)
    return parts, np.concatenate(sentences) if sentences else np.zeros(0, np.int64)


def join_parts(parts: list[Letters]) -> Letters:
    before = np.cumsum([0] + [len(p.code) for p in parts])
    return Letters(np.concatenate([p.code for p in parts]), np.concatenate([p.first + b for p, b in zip(parts, before)]),
                   np.concatenate([p.length for p in parts]), np.concatenate([p.of for p in parts]), np.zeros(0, np.int64))


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Fit on a bounded sample of texts and their labels."""
    if not toxic.any() or toxic.all():
        return EMPTY
    column = pa.array(texts, pa.string())
    parts, sentence = sample_parts(column)
    code = np.concatenate([p.code for p in parts])
    letters = join_parts(parts)
    # Words as one Arrow column over the letters, so that no word is a Python object of its own.
    edges = np.append(letters.first, len(code)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(code)]).dictionary_encode()
    names, word = np.array(coded.dictionary.to_pylist(), object), coded.indices.to_numpy()
    # A quarter of the texts is kept for the line from features to log-odds, which must see words it has not met.
    kept_back = np.arange(len(texts)) % 4 == 3
    if not (toxic[kept_back].any() and toxic[~kept_back].any()):
        kept_back[:] = False
    bad, good = (toxic & ~kept_back)[letters.of], (~toxic & ~kept_back)[letters.of]

    # Copies and near copies mostly have the same least shingle; all of them count as one text.
    slices = row_slices(pa.RecordBatch.from_arrays([column], ["text"]), "text", 1 << 20)
    least = np.array([s[0] if len(s) else 0 for part in slices for s in shingle_sets(part.column("text"), 3)], np.uint64)
    least = np.where(least == 0, np.arange(len(texts), dtype=np.uint64), least)
    group = np.unique(least, return_inverse=True)[1]

    def texts_with(rows: np.ndarray) -> np.ndarray:
        pairs = np.unique(word[rows].astype(np.int64) * len(texts) + group[letters.of[rows]])
        return np.bincount(pairs // len(texts), minlength=len(names))

    in_bad, in_good = texts_with(bad), texts_with(good)
    enough = np.array([len(n) >= 3 for n in names])
    n_bad, n_good = (len(np.unique(group[rows & ~kept_back])) for rows in (toxic, ~toxic))
    odds = (in_bad + 0.1) / n_bad / ((in_good + 0.1) / n_good)
    # Words that go with the label: met in several toxic texts and twenty times as likely there.
    marked = np.flatnonzero(enough & (in_bad >= max(4, n_bad / 50)) & (odds >= 20))
    marked = marked[np.argsort(-in_bad[marked], kind="stable")]
    common = np.argsort(-in_good * enough, kind="stable")[:COMMON]
    if not len(marked):
        return EMPTY
    chosen = np.concatenate([marked[:MARKED], np.setdiff1d(common, marked)])
    triples = triples_of(names[chosen].tolist())
    values, vectors = np.linalg.eigh((triples @ triples.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    # Nyström map: kernel with the landmarks, times the inverse root of the landmarks' own kernel.
    root = vectors[:, keep] / np.sqrt(values[keep])
    fold = np.ascontiguousarray(triples.T @ root.astype(np.float32))
    del triples

    _, first = np.unique(sentence, return_index=True)
    is_marked = np.isin(word, marked)
    has_mark = np.maximum.reduceat(is_marked.astype(int), first) > 0
    positive = np.flatnonzero(has_mark & bad[first])
    negative = np.flatnonzero(good[first])
    rng = np.random.default_rng(0)
    negative = rng.choice(negative, min(SENTENCES, len(negative)), replace=False)
    positive = rng.choice(positive, min(SENTENCES, len(positive)), replace=False)
    stop = np.append(first[1:], len(word))
    picked = np.concatenate([positive, negative])
    signs = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    # At first a word is as bad as it is like the marked landmarks.
    start = np.where(np.arange(len(chosen)) < min(len(marked), MARKED), 1.0, -0.2)
    weights, bias, exact = (fold @ (root.T @ start)).astype(np.float32), -1.0, {}
    seen: dict[tuple[int, float], int] = {}
    known: dict[bytes, np.ndarray] = {}
    for _ in range(ROUNDS):
        scores = np.concatenate([word_scores(p, weights, bias, exact) for p in parts])
        # A toxic sentence stands by one of the words that go with the label.
        scores[bad & ~is_marked] = -np.inf
        witness = word[[a + scores[a:b].argmax() for a, b in zip(first[picked].tolist(), stop[picked].tolist())]]
        for pair in zip(witness.tolist(), signs.tolist()):
            seen[pair] = seen.get(pair, 0) + 1
        # Witnesses of earlier rounds stay, so that what has been learned of them is not lost.
        own, sign, times = np.array([(w, y, n) for (w, y), n in seen.items()]).T
        rows = landmark_features(names[own.astype(int)].tolist(), fold, known)
        theta = hinge(rows, sign, np.where(sign > 0, 100.0, 20.0))
        weights, bias = (fold @ theta[:-1]).astype(np.float32), float(theta[-1])
    scores = np.concatenate([word_scores(p, weights, bias, exact) for p in parts])
    features = text_features(letters, scores, len(texts))
    rows = kept_back if kept_back.any() else ~kept_back
    return Model(weights, bias, logistic(features[rows], toxic[rows].astype(float)))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
          toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of labelled texts, the same on every run.

    A document is toxic if any of its labels is 1; equal texts of one label count once.
    Of each label the texts that hash lowest are taken, at most ``toxic_rows``
    and ``other_rows`` of them, and of these as many as fit in half of
    ``most_bytes`` each (a text that does not fit is passed over). They are chosen
    on rows of key, hash and length; only texts that were chosen are moved.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(toxic).isin(0, 1)).groupBy(key).agg((F.max(toxic) == 1).alias("toxic"))
    hashed = docs.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes"))
    narrow = hashed.join(known.withColumnRenamed(key, "key"), "key").groupBy("toxic", "hash").agg(
        F.min(F.struct("key", "bytes")).alias("first")).select("toxic", "hash", "first.*")
    chosen = []
    for label, most in ((True, toxic_rows), (False, other_rows)):
        held = 0
        for r in narrow.filter(F.col("toxic") == label).orderBy("hash", "key").limit(most).collect():
            if held + r["bytes"] <= most_bytes // 2:
                held += r["bytes"]
                chosen.append((r["key"], r["hash"], label))
    wanted = docs.sparkSession.createDataFrame(chosen, f"key {docs.schema[key].dataType.simpleString()}, hash long, toxic boolean")
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).join(
        F.broadcast(wanted), ["key", "hash"]).dropDuplicates(["toxic", "hash"]).select("text", "toxic", "hash").toArrow()
    found = found.sort_by([("toxic", "descending"), ("hash", "ascending")])
    return fit(found.column("text").to_pylist(), np.array(found.column("toxic").to_pylist(), bool))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` for every row, from its whole text; in place and without a shuffle.

    A null or empty text has the score of a text without words. Null and
    repeated keys keep their rows; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact: dict[bytes, float] = {}
        for batch in batches:
            for part in row_slices(batch, "text", 1 << 20):
                letters = letters_of(*flat_bytes(part.column("text")))
                features = text_features(letters, word_scores(letters, model.weights, model.bias, exact), part.num_rows)
                odds = np.clip(features @ model.line, -30, 30)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(1 / (1 + np.exp(-odds)))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double")
    return found.withColumnRenamed("key", key)


def held_out(key: str) -> Column:
    """True for the fold that is never learned from; null ids are in neither."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def fold_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Learned from the labelled documents outside the held-out fold."""
    return learn(docs, labels.filter(~held_out("doc_id")))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fold_model(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
