"""TF-IDF and multinomial naive Bayes: aggregations to fit, look-ups inside the rows to apply."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalumen.functions import text
from catalumen.operators import classparts, termparts
from catalumen.session import cut_lineage

# Counts that one histogram tells apart.
HISTOGRAM = 4_096


def sparse_rows(docs: DataFrame, key: str, tokens: Column, with_bigrams: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``(key, keep..., terms)``: one row per record with its terms in order and their counts, null without any; no shuffle.

    ``keep`` names further columns of the record to carry along, such as its split.
    """
    own = [key, *(keep or [])]
    base = docs.select(*own, tokens.alias("terms"))
    schema = T.StructType([*[base.schema[c] for c in own], T.StructField("terms", termparts.COUNTS)])
    return base.mapInArrow(counting(with_bigrams), schema)


def counting(with_bigrams: bool):
    """A function on batches: the tokens of each record in ``terms`` become its sparse row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in termparts.gathered(batches, "terms"):
            yield termparts.recoded(counted(batch, with_bigrams), "terms", code=False)

    return run


def counted(batch: pa.RecordBatch, with_bigrams: bool) -> pa.RecordBatch:
    """The tokens of each record of a batch as its sparse row, with coded terms; word pairs are numbers until they are known to be distinct."""
    tokens = batch.column("terms")
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), lengths)
    first = np.flatnonzero(row[:-1] == row[1:]) if with_bigrams else np.zeros(0, np.int64)
    code, words = termparts.coded(tokens.flatten())
    if with_bigrams and pc.any(pc.match_substring_regex(words, r"[\x00-\x20]")).as_py():
        # Pairs of words with a blank can be spelled like others: they are told apart as texts.
        spelled = words.take(pa.array(code))
        pairs = pc.binary_join_element_wise(spelled.take(pa.array(first)), spelled.take(pa.array(first + 1)), " ")
        row, first = np.concatenate([row, row[first]]), first[:0]
        code, words = termparts.coded(pa.concat_arrays([spelled, pairs]))
    place = np.arange(len(words))
    if not pc.all(pc.less(words[:-1], words[1:])).as_py():
        order = pc.array_sort_indices(words).to_numpy()
        place[order], words = np.arange(len(order)), words.take(pa.array(order))
    # A word comes before its pairs, as a blank comes before all letters.
    many = len(words) + 1
    gram = place[code] * many
    row, gram = np.concatenate([row, row[first]]), np.concatenate([gram, gram[first] + gram[first + 1] // many + 1])
    if many * many * max(1, batch.num_rows) >= 2 ** 63:
        known, gram = np.unique(gram, return_inverse=True)
    else:
        known = None
    # One sort of whole numbers by term and record gives the entries, their counts and the distinct terms.
    entry, tf = np.unique(gram * max(1, batch.num_rows) + row, return_counts=True)
    gram, row = np.divmod(entry, max(1, batch.num_rows))
    new = np.diff(gram, prepend=-1) > 0
    at = np.cumsum(new) - 1
    known = gram[new] if known is None else known[gram[new]]
    order = np.argsort(row.astype(np.uint16) if batch.num_rows <= 65_536 else row, kind="stable")
    row, at, tf = row[order], at[order], tf[order]
    word, second = np.divmod(known, many)
    terms = words.take(pa.array(word))
    if len(first):
        terms = pc.binary_join_element_wise(terms, words.take(pa.array(second - 1, mask=second == 0)), " ", null_handling="skip")
    coded = pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), terms)
    entries = pa.StructArray.from_arrays([coded, pa.array(tf.astype(np.int64))], names=["term", "tf"])
    ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(ends), entries, mask=pa.array(np.diff(ends) == 0))
    return termparts.replaced(batch, {"terms": listed})


def term_counts(docs: DataFrame, key: str, tokens: Column, with_bigrams: bool = False,
                keep: list[str] | None = None) -> DataFrame:
    """``(key, keep..., term, tf)`` for a frame with one row per key, without a shuffle."""
    return exploded(sparse_rows(docs, key, tokens, with_bigrams, keep))


def exploded(rows: DataFrame) -> DataFrame:
    """Sparse rows as one row per record and term."""
    own = [c for c in rows.columns if c != "terms"]
    return rows.select(*own, F.explode("terms").alias("t")).select(*own, "t.*")


def vocabulary(counts: DataFrame | termparts.Packs, min_df: int = 1, max_terms: int | None = None) -> DataFrame:
    """``(term, df, total_tf)`` from training counts, or from sparse rows or their packs; the cap keeps the most frequent terms.

    Sparse rows are counted in blocks where they lie, which shuffles far less than a row for each record and term. Terms as frequent as the last one kept go in by their order. The cut is found
    from histograms of the counts, and only terms at the cut are ranked.
    """
    totals = termparts.term_totals(counts) if isinstance(counts, termparts.Packs) or "terms" in counts.columns else counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))
    terms = totals.filter(F.col("df") >= min_df)
    return terms if max_terms is None else most_frequent(cut_lineage(terms, "terms"), "total_tf", "term", max_terms)


def most_frequent(rows: DataFrame, count: str, name: str, most: int) -> DataFrame:
    """The ``most`` rows with the highest whole number ``count``, ties by ``name``, which is unique; no global sort."""
    seen = rows.agg(F.min(count).alias("low"), F.max(count).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if seen["n"] <= most:
        return rows
    low, high, above = seen["low"], seen["high"], 0
    # The number that the last row kept has lies in [low, high]; ``above`` rows have more than ``high``.
    while low < high:
        width = max(1, -(-(high - low + 1) // HISTOGRAM))
        held = rows.filter(F.col(count).between(low, high)).groupBy(F.floor((F.col(count) - low) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(held.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= most:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            above += r["n"]
    ties = rows.filter(F.col(count) == low)
    return rows.filter(F.col(count) > low).unionByName(first_by_name(ties, name, most - above))


def first_by_name(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The first ``most`` rows by a unique name: ranges in order are counted, and only one of them is ranked."""
    ranged = cut_lineage(rows.repartitionByRange(name).withColumn("__range", F.spark_partition_id()), "ranges")
    rest, last = most, -1
    for r in ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect():
        last = r["__range"]
        if r["n"] > rest:
            break
        rest -= r["n"]
        last += 1
    within = F.row_number().over(Window.partitionBy("__range").orderBy(name))
    cut = ranged.filter(F.col("__range") == last).withColumn("__n", within).filter(F.col("__n") <= rest).drop("__n")
    return ranged.filter(F.col("__range") < last).unionByName(cut).drop("__range")


def idf_table(terms: DataFrame, n_docs: Column) -> DataFrame:
    """``(term, idf)``: smoothed inverse document frequency."""
    return terms.select("term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_rows(rows: DataFrame | termparts.Packs, terms: DataFrame, n_docs: Column, sublinear: bool, names: bool = True) -> DataFrame:
    """Sparse rows with their tf-idf weights: optional ``1 + ln(tf)``, unit length; see ``termparts.weigh``, also for ``names``. ``terms`` is written."""
    return termparts.weigh(rows, idf_table(terms, n_docs), "idf", sublinear, names=names)


def tfidf(rows: DataFrame, key: str, terms: DataFrame, n_docs: Column, sublinear: bool) -> DataFrame:
    """``(key, term, weight)`` of sparse rows."""
    return exploded(tfidf_rows(rows, terms, n_docs, sublinear)).select(key, "term", "weight")


def fit_naive_bayes(
    counts: DataFrame, terms: DataFrame, labels: DataFrame, label: str,
) -> tuple[DataFrame, DataFrame]:
    """Per-class constants ``(class, prior, unseen)`` and the gains ``(class, term, weight)`` of pairs that occur.

    ``counts`` are training term counts that carry ``label``; ``labels`` holds
    one row per training record. Unseen pairs all share their class's constant.
    Pairs are written once; the vocabulary grows with the input and is never broadcast.
    """
    pairs = cut_lineage(counts.groupBy("term", F.col(label).alias("class")).agg(F.sum("tf").alias("n")).join(
        terms.select("term").hint("merge"), "term", "left_semi"), "nb-pairs")
    size = terms.agg(F.count(F.lit(1)).alias("v")).scalar()
    totals = pairs.groupBy("class").agg(F.sum("n").alias("mass"))
    priors = labels.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("docs"))
    n_docs = labels.agg(F.count(F.lit(1)).alias("n")).scalar()
    classes = priors.join(totals, "class", "left").select(
        "class",
        F.log(F.col("docs") / n_docs).alias("prior"),
        (-F.log(F.coalesce("mass", F.lit(0)) + size)).alias("unseen"))
    return classes, pairs.select("class", "term", F.log(F.col("n") + 1).alias("weight"))


class NaiveBayes:
    """A fitted model as written tables, applied to sparse rows one part at a time.

    A record needs its number of known tokens, the highest score and the sum of
    all scores below it; all three merge over parts, so there is no limit of classes
    and no row for a record, a term and a class. Scores count with
    nine digits, so that summation order cannot decide, and ties go to the lowest class.
    """

    def __init__(self, terms: DataFrame, classes: DataFrame, weights: DataFrame, per_part: int | None = None):
        self.terms = cut_lineage(terms.select("term"), "nb-terms")
        self.parts = termparts.PairParts(cut_lineage(classes, "nb-classes"), cut_lineage(weights, "nb-weights"), per_part)
        self.per_part = per_part

    def lengths(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``__length``, the tokens that the vocabulary knows."""
        out = rows.withColumn("__length", F.lit(0.0))
        return termparts.looked_up(out, self.terms, _counting, out.schema, "terms", self.per_part)

    def fold(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their lengths and their states over all classes, see ``classparts``."""
        out = self.lengths(rows)
        schema = T.StructType([*out.schema.fields, *classparts._state_type(self.parts.kind)])
        for nth, part in enumerate(self.parts):
            out = self.parts.through(cut_lineage(out, "nb-states") if nth else out, part, partial(_folding, first=nth == 0), schema)
        return out

    def predict(self, rows: DataFrame, key: str) -> DataFrame:
        """``(key, pred, score)``: the best class and its joint log-likelihood."""
        return self.fold(rows.select(key, "terms")).select(key, F.col("__best").alias("pred"), F.col("__top").alias("score"))

    def scores(self, rows: DataFrame, key: str) -> DataFrame:
        """``(key, class, score, probability)`` for every record and every class, one part of the classes after the other."""
        states = cut_lineage(self.fold(rows.select(key, "terms")).select(
            key, "terms", "__length", "__top", F.col("__mass")[0].alias("__mass")), "nb-scores")
        kind, result = self.parts.kind.simpleString(), None
        for part in self.parts:
            found = self.parts.through(states, part, partial(_spelling, key=key), f"{key} {states.schema[key].dataType.simpleString()}, class {kind}, score double, probability double")
            result = found if result is None else result.unionByName(found)
        return result


def _counting(part: pa.Table):
    names = part.column("term").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in termparts.gathered(batches, "terms"):
            row, term, tf = termparts.entries_of(batch.column("terms"), "tf")
            known = termparts.places(term, names) >= 0
            more = np.bincount(row[known], weights=tf[known], minlength=batch.num_rows)
            length = batch.column("__length").to_numpy(zero_copy_only=False) + more
            yield termparts.replaced(batch, {"__length": pa.array(length)}).select(batch.schema.names)

    return run


def _scores(batch: pa.RecordBatch, part: termparts.Part) -> Iterator[tuple[slice, np.ndarray]]:
    prior, unseen = part.constants["prior"], part.constants["unseen"]
    length = batch.column("__length").to_numpy(zero_copy_only=False)
    for some, z in termparts.class_scores(batch, part, "tf", lambda rows: prior + length[rows, None] * unseen):
        yield some, np.round(z, 9)


def _folding(part: termparts.Part, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in termparts.gathered(batches, "terms"):
            n, kind = batch.num_rows, part.names.type
            state = classparts._empty(n, 1, kind) if first else classparts._read(batch, 1)
            done = []
            for some, z in _scores(batch, part):
                now = {k: v[some] if isinstance(v, np.ndarray) else v.slice(some.start, some.stop - some.start) for k, v in state.items()}
                done.append(classparts._merged(now, z, part.names, np.full(len(z), -1), (1.0,)))
            merged = classparts._joined(done, kind, 1)
            own = [c for c in batch.schema.names if c == "__length" or not c.startswith("__")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), *classparts._wire(merged)], [*own, *[f.name for f in classparts._state_type(T.LongType())]])

    return run


def _spelling(part: termparts.Part, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in termparts.gathered(batches, "terms"):
            top, mass = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__top", "__mass"))
            for some, z in _scores(batch, part):
                rows, classes = z.shape
                share = np.exp(z - top[some, None]) / mass[some, None]
                keys = batch.column(key).slice(some.start, rows).take(pa.array(np.repeat(np.arange(rows), classes)))
                names = part.names.take(pa.array(np.tile(np.arange(classes), rows)))
                yield pa.RecordBatch.from_arrays([keys, names, pa.array(z.ravel()), pa.array(share.ravel())], [key, "class", "score", "probability"])

    return run
