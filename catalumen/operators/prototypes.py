"""Class prototypes, distances to them, and the scores derived from the distances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from catalumen.functions import vectors

# Largest model shipped to every task: 4000 classes of 2048 doubles are 66 MB.
MAX_CLASSES = 4_000
MAX_WIDTH = 2_048
LOGIT_SCALE = 80.0


SIGNAL_NAMES = ("pred_position", "conf", "second_position", "second", "entropy", "nll", "brier")
SIGNAL_TYPE = ("struct<pred_position:int,conf:double,second_position:int,second:double,"
               "entropy:double,nll:double,brier:double>")
# Values of one intermediate array inside a task: 32 MB of doubles.
CHUNK_VALUES = 4_000_000


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A batch of vectors as a matrix; fails on another width or a value that is not finite."""
    lengths = column.value_lengths()
    if column.null_count or not np.all(lengths.to_numpy(zero_copy_only=False) == width):
        raise ValueError(f"every vector must have {width} values")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    if not np.isfinite(x).all():
        raise ValueError("vector with a value that is not finite")
    return x


def _distances(x: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    dots = x @ centres.T
    x2 = np.einsum("ij,ij->i", x, x)[:, None]
    c2 = np.einsum("ij,ij->i", centres, centres)[None, :]
    if metric == "euclidean":
        return np.sqrt(np.maximum(x2 + c2 - 2.0 * dots, 0.0))
    return 1.0 - dots / np.maximum(np.sqrt(x2) * np.sqrt(c2), 1e-12)


def _signals(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Best and second class, entropy, and the likelihood terms of a batch of logits."""
    row = np.arange(len(z))
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    mass = e.sum(axis=1)
    p = e / mass[:, None]
    best = p.argmax(axis=1)
    conf = p[row, best]
    clipped = np.clip(p, vectors.PROBABILITY_FLOOR, 1.0)
    entropy = -(clipped * np.log(clipped)).sum(axis=1)
    known = np.maximum(y, 0)
    nll = np.log(mass) - z[row, known]
    brier = (p * p).sum(axis=1) - 2.0 * p[row, known] + 1.0
    if p.shape[1] == 1:
        # Without a second class there is no runner-up; it is null.
        return best, conf, np.full(len(z), -1), np.full(len(z), np.nan), entropy, nll, brier
    p[row, best] = -1.0
    runner_up = p.argmax(axis=1)
    return best, conf, runner_up, p[row, runner_up], entropy, nll, brier


def mean_vectors(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector per group as ``centre``; partial sums are merged before the shuffle."""
    as_vector = array_to_vector(F.col(vector).cast("array<double>"))
    return df.groupBy(*by).agg(
        vector_to_array(Summarizer.mean(as_vector)).alias("centre"),
        F.count(F.lit(1)).alias("members"))


def fit_prototypes(train: DataFrame, label: str, vector: str) -> DataFrame:
    return mean_vectors(train.select(F.col(label).alias("class"), F.col(vector).alias(vector)),
                        ["class"], vector)


@dataclass(frozen=True)
class PrototypeModel:
    """A fitted, size-checked set of prototypes; row k of ``matrix`` is ``classes[k]``."""

    classes: tuple
    matrix: np.ndarray

    @classmethod
    def collect(cls, prototypes: DataFrame, required: list | None = None) -> PrototypeModel:
        """Bring the prototypes to the driver after checking that they are few.

        Larger class sets use ``classparts.ModelParts``; this model is for
        streams and for results that are themselves class-wide arrays.
        """
        width_checked = F.when(F.size("centre") <= MAX_WIDTH, F.col("centre")).alias("centre")
        rows = prototypes.select("class", width_checked).limit(MAX_CLASSES + 1).collect()
        if not rows:
            raise ValueError("no class has a training record")
        if len(rows) > MAX_CLASSES or any(row["centre"] is None for row in rows):
            raise ValueError("too many prototypes for one task; use classparts.ModelParts")
        if len({len(row["centre"]) for row in rows}) != 1:
            raise ValueError("prototypes differ in width")
        rows.sort(key=lambda row: row["class"])
        found = [row["class"] for row in rows]
        missing = sorted(set(required or []) - set(found))
        if missing:
            raise ValueError(f"classes without a training record: {missing}")
        return cls(tuple(found), np.array([row["centre"] for row in rows], dtype=np.float64))

    def class_array(self) -> Column:
        return F.array(*[F.lit(c) for c in self.classes])

    def position(self, label: Column) -> Column:
        """0-based class id, null for a class the model does not know."""
        position = F.array_position(self.class_array(), label)
        return F.when(position > 0, (position - 1).cast("int"))

    def label_at(self, position: Column) -> Column:
        return F.element_at(self.class_array(), position.cast("int") + 1)

    def distances(self, vector: Column, metric: str = "euclidean") -> Column:
        """Distance of each row's vector to every prototype, one matrix product per batch."""
        matrix = self.matrix

        @F.arrow_udf("array<double>")
        def measure(column: pa.Array) -> pa.Array:
            out = _distances(_rows(column, matrix.shape[1]), matrix, metric)
            offsets = np.arange(0, (len(column) + 1) * len(matrix), len(matrix), dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

        # Marked so that Spark never evaluates the product a second time for a pushed-down filter.
        return measure.asNondeterministic()(vector)

    def signals(self, vector: Column, label_position: Column, scale: float | None = None) -> Column:
        """Everything the curves and reports need, as one narrow struct per row.

        The class-wide arrays stay inside the task: at 500 classes a row returns
        seven numbers instead of four kilobytes.
        """
        matrix, width = self.matrix, self.matrix.shape[1]
        logit_scale = LOGIT_SCALE if scale is None else scale

        @F.arrow_udf(SIGNAL_TYPE)
        def measure(column: pa.Array, truth: pa.Array) -> pa.Array:
            x = _rows(column, width)
            y = truth.fill_null(-1).to_numpy(zero_copy_only=False)
            step = max(1, CHUNK_VALUES // len(matrix))
            parts = [
                _signals(-logit_scale * _distances(x[i:i + step], matrix, "euclidean"), y[i:i + step])
                for i in range(0, max(len(x), 1), step)]
            merged = [np.concatenate(values) for values in zip(*parts)]
            unknown, alone = y < 0, np.full(len(y), len(matrix) == 1)
            arrays = [
                pa.array(merged[0], pa.int32()), pa.array(merged[1]),
                pa.array(merged[2], pa.int32(), mask=alone), pa.array(merged[3], mask=alone), pa.array(merged[4]),
                pa.array(merged[5], mask=unknown), pa.array(merged[6], mask=unknown)]
            return pa.StructArray.from_arrays(arrays, names=list(SIGNAL_NAMES))

        return measure.asNondeterministic()(vector, label_position)


def logits(distances: Column, scale: float = LOGIT_SCALE) -> Column:
    return F.transform(distances, lambda d: -F.lit(scale) * d)


def score(df: DataFrame, model: PrototypeModel, vector: str, label: str) -> DataFrame:
    """Add ``logits``, ``probabilities``, ``pred``, ``conf``, ``label_position`` and ``correct``."""
    return (
        df.withColumn("logits", logits(model.distances(F.col(vector))))
        .withColumn("probabilities", vectors.softmax(F.col("logits")))
        .withColumn("pred_position", vectors.argmax(F.col("probabilities")))
        .withColumn("label_position", model.position(F.col(label)))
        .withColumn("pred", model.label_at(F.col("pred_position")))
        .withColumn("conf", F.array_max("probabilities"))
        .withColumn("correct", F.col("pred").eqNullSafe(F.col(label)))
    )


def score_narrow(df: DataFrame, model: PrototypeModel, vector: str, label: str) -> DataFrame:
    """Add ``pred``, ``conf``, ``correct``, the second class and the likelihood terms.

    Use this wherever the full probability vector is not needed afterwards.
    """
    scored = df.withColumn("label_position", model.position(F.col(label))).withColumn(
        "__s", model.signals(F.col(vector), F.col("label_position")))
    return scored.select(
        *df.columns, "label_position",
        model.label_at(F.col("__s.pred_position")).alias("pred"),
        model.label_at(F.col("__s.second_position")).alias("second_class"),
        *[F.col(f"__s.{n}").alias(n) for n in ("conf", "second", "entropy", "nll", "brier")],
    ).withColumn("correct", F.col("pred").eqNullSafe(F.col(label)))
