"""Language identification: script ranges, per-word scores and a Viterbi path over the words of a text.

A word is a run of letters. The scripts of its letters leave only languages
that use one of them; byte trigrams give each of these a score. The best path
over a text's words pays a penalty for each change of language, so single odd
words do not change the label but passages in another language do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalumen.llm.base import flat_bytes, query, row_slices, small_batches, table

UNDETERMINED = "und"
# About so many texts of each language are learned from, chosen by a hash of their ids.
ROWS_PER_LANGUAGE = 2_000
TABLE_BITS = 16
# Price of a change of language, and the most that one word can say against a language (natural logarithms).
SWITCH = 20.0
WORD_LIMIT = 10.0
# A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.01

SPACE = 32
# Script of the first byte of a character in UTF-8 (fixed ranges of Unicode): each is one bit.
LATIN, GREEK, CYRILLIC, HEBREW, ARABIC, INDIC, KANA, HAN, HANGUL, REST = (1 << i for i in range(10))
LEAD_RANGES = ((0x41, 0x5A, LATIN), (0x61, 0x7A, LATIN), (0xC3, 0xCA, LATIN), (0xCD, 0xCF, GREEK), (0xD0, 0xD3, CYRILLIC),
               (0xD6, 0xD7, HEBREW), (0xD8, 0xDB, ARABIC), (0xE0, 0xE0, INDIC), (0xE3, 0xE3, KANA), (0xE4, 0xE9, HAN),
               (0xEA, 0xED, HANGUL), (0xCB, 0xCC, REST), (0xD4, 0xD5, REST), (0xDC, 0xDF, REST), (0xE1, 0xE2, REST),
               (0xEE, 0xF4, REST))

SPANS = T.ArrayType(T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Each byte in lower case with non-letters as blanks, and the script bit of a leading byte."""
    lower, script = np.full(256, SPACE, np.uint8), np.zeros(256, np.int32)
    lower[0x80:] = np.arange(0x80, 0x100)
    for c in range(26):
        lower[0x41 + c] = lower[0x61 + c] = 0x61 + c
    for low, high, bit in LEAD_RANGES:
        script[low:high + 1] = bit
    return lower, script


@dataclass
class Words:
    """The words of a run of texts: trigram bucket and word of each letter byte, bounds and scripts of each word."""

    bucket: np.ndarray
    first: np.ndarray  # of each word, in ``bucket``
    start: np.ndarray  # of each word, as a byte of the run
    end: np.ndarray
    scripts: np.ndarray
    upto: np.ndarray  # words before each text, and of all


def words_of(data: np.ndarray, at: np.ndarray) -> Words:
    lower, script = _byte_tables()
    code = lower[data]
    if len(data) > 1:
        # The upper-case letters U+00C0 to U+00DE, whose second byte is 32 below that of the lower-case ones.
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        code[1:][upper] += 32
    before, after = np.empty_like(code), np.empty_like(code)
    before[1:], after[:-1] = code[:-1], code[1:]
    edges = at[:-1][at[:-1] < len(data)]
    before[edges] = SPACE
    after[at[1:][at[1:] > 0] - 1] = SPACE
    letter = code != SPACE
    where = np.flatnonzero(letter)
    start = np.flatnonzero(letter & (before == SPACE))
    end = np.flatnonzero(letter & (after == SPACE)) + 1
    mixed = (before[where].astype(np.uint32) * np.uint32(257) + code[where]) * np.uint32(263) + after[where]
    bucket = (mixed * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
    first = np.searchsorted(where, start)
    scripts = np.bitwise_or.reduceat(script[data[where]], first) if len(first) else np.zeros(0, np.int32)
    return Words(bucket, first, start, end, scripts, np.searchsorted(start, at))


@dataclass
class Model:
    """Score of each trigram bucket by language, and the scripts of each language."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray


def learn(rows: DataFrame, text: str, lang: str, per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit from rows with a text and a language; the table of sums has a fixed size whatever the input.

    About ``per_language`` texts of each language are read, those whose texts
    hash lowest; their counts are added up by Spark.
    """
    small_batches(rows.sparkSession)
    rows = rows.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros(0, np.int32))
    chance = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"])))))
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / F.lit(1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in row_slices(batch, "text", 2 << 20):
                langs = np.array(part.column("lang").to_pylist(), object)
                data, at = flat_bytes(part.column("text"))
                found = words_of(data, at)
                of_text = np.repeat(np.arange(part.num_rows), np.diff(found.upto))
                for name in set(langs):
                    mine = langs[of_text] == name
                    if not mine.any():
                        continue
                    letters = np.repeat(mine, np.diff(np.append(found.first, len(found.bucket))))
                    got = np.bincount(found.bucket[letters], minlength=1 << TABLE_BITS)
                    # Behind the trigrams: words by each script bit.
                    bits = np.array([np.count_nonzero(found.scripts[mine] & (1 << b)) for b in range(10)])
                    sums[name] = sums.get(name, 0) + np.concatenate([got, bits])
        for name, total in sums.items():
            where = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(where), pa.string()), pa.array(where, pa.int32()), pa.array(total[where], pa.int64())],
                ["lang", "slot", "n"])

    # At most 2^16 + 10 sums for each language reach the driver.
    summed = rows.filter(share < chance[F.col("lang")]).mapInArrow(count, "lang string, slot int, n long").groupBy(
        "lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(summed["lang"].unique())
    if not names:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros(0, np.int32))
    full = np.zeros((len(names), (1 << TABLE_BITS) + 10))
    for i, name in enumerate(names):
        own = summed[summed["lang"] == name]
        full[i, own["slot"]] = own["n"]
    trigrams, bits = full[:, :1 << TABLE_BITS], full[:, 1 << TABLE_BITS:]
    seen = trigrams.sum(0) > 0
    weights = np.log((trigrams + 0.5) / (trigrams.sum(1, keepdims=True) + 0.5 * seen.sum()))
    weights -= weights.mean(0)
    weights[:, ~seen] = 0
    uses = bits >= SCRIPT_SHARE * bits.sum(1, keepdims=True).clip(1)
    return Model(names, np.ascontiguousarray(weights.T, np.float32), (uses * (1 << np.arange(10))).sum(1).astype(np.int32))


def word_scores(found: Words, model: Model) -> np.ndarray:
    """What each word says for each language: at most zero, zero for its best one."""
    if not len(found.first) or not model.languages:
        return np.zeros((0, len(model.languages)), np.float32)
    score = np.add.reduceat(model.weights[found.bucket], found.first, axis=0)
    fits = (found.scripts[:, None] & model.scripts[None, :]) != 0
    some = fits.any(1)
    score[~fits & some[:, None]] = -np.inf
    score -= score.max(1, keepdims=True)
    return np.maximum(score, -WORD_LIMIT)


def viterbi(score: np.ndarray, switch: float = SWITCH) -> list[int]:
    """Best label of each word; a change of label costs ``switch``. Ties go to the lower label and to no change."""
    labels = range(score.shape[1])
    value, back = [0.0] * len(labels), []
    for row in score.tolist():
        best = max(value)
        source = value.index(best)
        step = [source if best - switch > value[k] else k for k in labels]
        value = [(best - switch if best - switch > value[k] else value[k]) + row[k] for k in labels]
        back.append(step)
    path = [value.index(max(value))]
    for step in reversed(back[1:]):
        path.append(step[path[-1]])
    return path[::-1]


def one_language(score: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """For each text the language whose constant path is certainly the best, or -1.

    No change pays if no run of words favours another language by the price of
    one change: the largest sum over a run is the largest rise of a running sum.
    """
    texts = len(at) - 1
    out = np.full(texts, -1)
    filled = np.flatnonzero(np.diff(at))
    if not len(filled) or not score.shape[1]:
        return out
    totals = np.add.reduceat(score, at[filled], axis=0, dtype=np.float64)
    out[filled] = totals.argmax(1)
    of_text = np.repeat(np.arange(texts), np.diff(at))
    own = score[np.arange(len(score)), out[of_text]]
    for k in range(score.shape[1]):
        gain = np.cumsum((score[:, k] - own).astype(np.float64))
        base = np.concatenate([[0.0], gain])
        for i in np.flatnonzero((out >= 0) & (np.diff(at) > 0)):
            a, b = at[i], at[i + 1]
            run = base[a:b + 1]
            if (run - np.minimum.accumulate(run)).max() >= switch:
                out[i] = -2
    out[out == -2] = -1
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def labels(texts: pa.Array, model: Model) -> Iterator[tuple[str, float, list]]:
    """Main language, its share and the spans of each text."""
    names = model.languages
    data, at = flat_bytes(texts)
    found = words_of(data, at)
    score = word_scores(found, model)
    whole = one_language(score, found.upto)
    ascii_letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    for i in range(len(texts)):
        a, b = found.upto[i], found.upto[i + 1]
        if a == b or not names or not (ascii_letter[at[i + 1]] > ascii_letter[at[i]] or has_letter(texts[i].as_py())):
            yield UNDETERMINED, 0.0, []
        elif whole[i] >= 0:
            yield names[whole[i]], 1.0, [(names[whole[i]], 0, int(point[at[i + 1]] - point[at[i]]))]
        else:
            path = np.array(viterbi(score[a:b]))
            letters = np.bincount(path, found.end[a:b] - found.start[a:b], len(names))
            turns = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
            bounds = [at[i], *found.start[a:b][turns[1:]], at[i + 1]]
            bounds = [int(point[x] - point[at[i]]) for x in bounds]
            yield (names[letters.argmax()], float(letters.max() / letters.sum()),
                   [(names[path[t]], *bounds[j:j + 2]) for j, t in enumerate(turns)])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang, score, spans)`` for every row, in place and without a shuffle.

    ``lang`` has the most letters on the best path and ``score`` is its share
    of them; ties go to the name that sorts first. ``spans`` lists (lang,
    start, end) in code points. A null text, and one without any letter, is
    ``und`` with score 0 and no spans, and so is every text under an empty
    model. Null or repeated keys keep their rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("lang", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in row_slices(batch, "text", 1 << 20):
                lang, score, spans = zip(*labels(part.column("text"), model))
                listed = [[dict(zip(("lang", "start", "end"), s)) for s in row] for row in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(listed, kind)],
                    ["key", "lang", "score", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language of the model."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, text, 1 << 20):
                yield part.filter(pa.array([lang != UNDETERMINED for lang, _, _ in labels(part.column(text), model)]))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str) -> Column:
    """True for the fold that is never learned from; null ids are in neither."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def fold_model(docs: DataFrame) -> Model:
    """Learned from the documents outside the held-out fold."""
    return learn(docs.filter(~held_out("doc_id")), "text", "lang")


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fold_model(docs)).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("lang").alias("lang_pred"), "score")
