"""One-against-the-rest linear classifiers on sparse rows, fitted by accelerated full gradient steps.

Scores start at -1 for every class and the loss is the squared hinge, so a record
pulls at its own class and pushes only at classes that it scores above -1: weights
and gradients stay as sparse as the pairs of a term and a class that occur.
Features are scaled by the root of their own bound on the curvature (rows with few
terms make it small), after which a step of length one is safe in every direction.

Weights are a written table ``(class, term, w, weight)``. Each step brings them to
the records, shipped while they are few and by the terms of a pack beyond that;
packs add up their gradients before one shuffle by class and term.

Several fits can share a table: a class belongs to a setting, and a term that
starts with ``own_term`` of a setting counts for the classes of that setting only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.operators import termparts
from catalumen.session import cut_lineage

ROUNDS = 12
RIDGE = 1e-4
OWN = "\x01"
GRADIENT = "class string, term string, w double, weight double, g double"


def own_term(setting: int, name: Column) -> Column:
    """A term that only the classes of one setting see."""
    return F.concat(F.lit(f"{OWN}{setting:03d}|"), name)


def _settings(terms: pa.Array) -> np.ndarray:
    """The setting of each term, -1 for terms that all settings share."""
    return np.array([int(t[1:4]) if t.startswith(OWN) else -1 for t in terms.to_pylist()], np.int64)


def momentum(rounds: int) -> list[float]:
    """How far each step goes on beyond the new weights."""
    out, t = [], 1.0
    for _ in range(rounds):
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        out.append((t - 1) / after)
        t = after
    return out


class LinearModel:
    """Fitted weights, the scale of each term and the classes, all as written tables."""

    def __init__(self, scales: DataFrame, classes: DataFrame, weights: DataFrame, settings: int, per_part: int | None):
        self.scales, self.classes, self.weights, self.settings, self.per_part = scales, classes, weights, settings, per_part

    def predict(self, rows: DataFrame, key: str) -> DataFrame:
        """``(key, setting, pred, score)``: each setting's best class, by scores of nine digits, lowest class on a tie."""
        scaled = termparts.weigh(rows.select(key, "terms"), self.scales, "scale", unit=False, value="weight")
        out = scaled.withColumns({
            "top": F.array_repeat(F.lit(float("-inf")), self.settings), "best": F.array_repeat(F.lit(None).cast("string"), self.settings)})
        parts = termparts.PairParts(self.classes, self.weights, self.per_part)
        for nth, part in enumerate(parts):
            out = parts.through(cut_lineage(out, "linear-states") if nth else out, part, partial(_best, settings=self.settings), out.schema)
        listed = F.posexplode(F.arrays_zip("best", "top")).alias("setting", "b")
        return out.select(key, listed).select(key, "setting", F.col("b.best").alias("pred"), F.col("b.top").alias("score"))


def fit_linear(rows: DataFrame, label: str, settings: int = 1, rounds: int = ROUNDS, ridge: float = RIDGE,
               per_part: int | None = None) -> LinearModel:
    """Fit on sparse rows ``(label, terms)`` with weighted terms, as ``termparts.weigh`` gives them.

    Rows without a label are not used. ``ridge`` acts on the scaled weights.
    """
    known = rows.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), "terms")
    total = known.count()
    if not total:
        raise ValueError("no record has a label")
    packs = termparts.Packs(known, most=termparts.ENTRIES)
    bounds = _bounds(packs)
    scales = cut_lineage(bounds.filter("b > 0").select("term", (1 / F.sqrt(F.col("b") * F.lit(2.0 / total))).alias("scale")), "linear-scales")
    scaled = termparts.Packs(termparts.weigh(packs, scales, "scale", unit=False, value="weight"), most=termparts.ENTRIES)
    n = termparts.buckets(scaled)
    each = F.explode(F.sequence(F.lit(0), F.lit(settings - 1)))
    classes = cut_lineage(known.select("label").distinct().withColumn("setting", each).select(
        F.format_string("%03d|%s", "setting", "label").alias("class"), "label", "setting"), "linear-classes")
    weights = classes.limit(0).select("class", F.lit("").alias("term"), F.lit(0.0).alias("w"), F.lit(0.0).alias("weight"))
    for beyond in momentum(rounds):
        steps = termparts.dealt(weights.withColumn("g", F.lit(0.0)), n)
        parts = termparts.PairParts(classes, weights, per_part)
        for part in parts:
            steps = steps.unionByName(parts.through(scaled, part, partial(_stepped, share=2.0 / total, n=n), termparts.BLOCKS))
        summed = termparts.summed(steps, ["class", "term"], GRADIENT)
        new = F.col("weight") - (F.col("g") + ridge * F.col("weight")) / (1 + ridge)
        weights = cut_lineage(summed.withColumn("new", new).select(
            "class", "term", F.col("new").alias("w"), (F.col("new") + beyond * (F.col("new") - F.col("w"))).alias("weight")), "linear-weights")
    final = weights.select("class", "term", F.col("w").alias("weight"))
    return LinearModel(scales, classes, final, settings, per_part)


def _bounds(packs: termparts.Packs) -> DataFrame:
    """``(term, b)``: each term's sum of squared weights times the entries of their records."""
    n, made = termparts.buckets(packs), packs.made

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in termparts.opened(batches, made):
            row, term, value = termparts.entries_of(batch.column("terms"), "weight")
            at, names = termparts.coded(term)
            sums = np.bincount(at, weights=np.bincount(row, minlength=batch.num_rows)[row] * value * value, minlength=len(names))
            yield termparts.dealt_rows(pa.table({"term": names, "b": sums}), n)

    return termparts.summed(packs.frame.mapInArrow(bound, termparts.BLOCKS), ["term"], "term string, b double")


def _stepped(part: termparts.Part, share: float, n: int):
    """The gradient as blocks: a row for each class and term of a pack never leaves the worker as such."""
    gradient = _gradient(part, share)
    return lambda batches: (termparts.dealt_rows(b, n) for b in gradient(batches))


def _added(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its sum."""
    pair, place = np.unique(np.concatenate(keys), return_inverse=True)
    return pair, np.bincount(place, weights=np.concatenate(sums), minlength=len(pair))


def _gradient(part: termparts.Part, share: float):
    """Each task's sums of the loss's derivative by the weights of the part's classes."""
    labels = pa.array(part.constants["label"].tolist(), pa.string())
    code = pc.index_in(labels, value_set=labels.unique()).to_numpy()
    setting = part.constants["setting"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in termparts.gathered(batches, "terms"):
            row, term, value = termparts.entries_of(batch.column("terms"), "weight")
            coded = term.dictionary_encode()
            at, theirs = coded.indices.to_numpy().astype(np.int64), _settings(coded.dictionary)
            truth = pc.index_in(batch.column("label"), value_set=labels.unique()).fill_null(-1).to_numpy(zero_copy_only=False)
            keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
            upto = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for some, z in termparts.class_scores(batch, part, "weight", lambda rows: -1.0):
                mine = truth[some, None] == code[None, :]
                pull = share * np.where(mine, -np.maximum(1 - z, 0), np.maximum(1 + z, 0))
                pulled, by = np.nonzero(pull)
                sizes = (upto[some.start + 1:some.stop + 1] - upto[some])[pulled]
                # Runs of pulls with a bounded number of entries, or one pull.
                ends = np.concatenate([[0], np.cumsum(sizes)])
                start = 0
                while start < len(pulled):
                    stop = max(start + 1, int(np.searchsorted(ends, ends[start] + termparts.VALUES, side="right")) - 1)
                    who, of, many = pulled[start:stop], by[start:stop], sizes[start:stop]
                    start = stop
                    each = np.repeat(np.arange(len(who)), many)
                    entry = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + upto[some.start + who][each]
                    of, own = of[each], theirs[at[entry]]
                    seen = (own < 0) | (own == setting[of])
                    keys.append((at[entry] * len(labels) + of)[seen])
                    sums.append((pull[who[each], of] * value[entry])[seen])
                    if sum(map(len, keys)) > 4 * termparts.VALUES:
                        keys, sums = ([x] for x in _added(keys, sums))
            pair, g = _added(keys, sums)
            zeros = pa.array(np.zeros(len(pair)))
            yield pa.RecordBatch.from_arrays(
                [pa.DictionaryArray.from_arrays(pa.array((pair % len(labels)).astype(np.int32)), part.names),
                 pa.DictionaryArray.from_arrays(pa.array((pair // len(labels)).astype(np.int32)), coded.dictionary.cast(pa.string())), zeros, zeros, pa.array(g)],
                ["class", "term", "w", "weight", "g"])

    return run


def _best(part: termparts.Part, settings: int):
    labels, setting = np.array(part.constants["label"].tolist(), object), part.constants["setting"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in termparts.gathered(batches, "terms"):
            top = batch.column("top").flatten().to_numpy(zero_copy_only=False).reshape(-1, settings).copy()
            best = np.array(batch.column("best").flatten().to_pylist(), object).reshape(-1, settings)
            for some, z in termparts.class_scores(batch, part, "weight", lambda rows: -1.0):
                z = np.round(z, 9)
                for s in np.unique(setting):
                    columns = np.flatnonzero(setting == s)
                    at = z[:, columns].argmax(1)
                    value = z[np.arange(len(z)), columns[at]]
                    ahead = value > top[some, s]
                    top[some, s] = np.where(ahead, value, top[some, s])
                    best[some, s] = np.where(ahead, labels[columns[at]], best[some, s])
            ends = pa.array(np.arange(0, top.size + 1, settings, dtype=np.int32))
            yield termparts.replaced(batch, {
                "top": pa.ListArray.from_arrays(ends, pa.array(top.ravel())),
                "best": pa.ListArray.from_arrays(ends, pa.array(best.ravel().tolist(), pa.string()))}).select(batch.schema.names)

    return run
