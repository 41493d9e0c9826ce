"""Scores against class sets of any size, one part of the model at a time.

What a record needs to know of all classes is a small state that can be merged:
the highest logit, the sums of exp(z), z exp(z) and exp(2z) below it, the two best
classes and the logit of its own class. A part of the model is a bounded number
of values; each pass over the records folds one part into their states, in place
and without a shuffle. A model of one part takes one pass; between passes the
records are written with their states, so a task never holds more than a part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalumen.operators.prototypes import CHUNK_VALUES, LOGIT_SCALE, _distances, _rows
from catalumen.session import cut_lineage

# Values of one part: 64 MB of doubles, as many as 4,000 classes of 2,048.
PART_VALUES = 8_192_000


class ModelParts:
    """Prototypes ``(class, centre)`` as a written table, handed out in class order, a bounded number at a time."""

    def __init__(self, prototypes: DataFrame, per_part: int | None = None):
        self.table = cut_lineage(prototypes.select("class", "centre"), "class-parts")
        self.kind = self.table.schema["class"].dataType
        seen = self.table.agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("class").alias("classes"), F.min(F.size("centre")).alias("least"),
            F.max(F.size("centre")).alias("most"), F.count_if(F.col("centre").isNull() | F.col("class").isNull()).alias("missing")).first()
        if not seen["n"]:
            raise ValueError("no class has a training record")
        if seen["missing"] or seen["least"] != seen["most"]:
            raise ValueError("prototypes differ in width")
        if seen["n"] != seen["classes"]:
            raise ValueError("a class has two prototypes")
        self.classes, self.width = seen["n"], seen["most"]
        self.per_part = per_part or max(1, PART_VALUES // max(1, self.width))

    def __iter__(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """``(classes, matrix)`` of each part; a part is bounded by construction and the only thing that reaches the driver."""
        rest = self.table
        for _ in range(0, self.classes, self.per_part):
            part = rest.orderBy("class").limit(self.per_part).toArrow().sort_by("class")
            names = part.column("class").combine_chunks()
            yield names, _rows(part.column("centre").combine_chunks(), self.width)
            rest = self.table.filter(F.col("class") > F.lit(names[-1].as_py()))


def _state_type(kind: T.DataType) -> list[T.StructField]:
    many = T.ArrayType(T.DoubleType())
    return [T.StructField(f"__{name}", dtype) for name, dtype in (
        ("top", T.DoubleType()), ("mass", many), ("weighted", many), ("square", T.DoubleType()), ("best", kind),
        ("second_z", T.DoubleType()), ("second", kind), ("own", T.DoubleType()))]


def _empty(n: int, temperatures: int, kind: pa.DataType) -> dict:
    return {"top": np.full(n, -np.inf), "mass": np.zeros((n, temperatures)), "weighted": np.zeros((n, temperatures)),
            "square": np.zeros(n), "best": pa.nulls(n, kind), "second_z": np.full(n, -np.inf), "second": pa.nulls(n, kind),
            "own": np.full(n, np.nan)}


def sums_below(z: np.ndarray, top: np.ndarray, temperatures: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of exp((z - top) / T) and of (z - top) exp((z - top) / T), a column for each temperature."""
    z = z - top[:, None]
    mass, weighted = np.empty((len(z), len(temperatures))), np.empty((len(z), len(temperatures)))
    for i, t in enumerate(temperatures):
        e = np.exp(z / t)
        mass[:, i], weighted[:, i] = e.sum(1), np.einsum("ij,ij->i", z, e)
    return mass, weighted


def _merged(state: dict, z: np.ndarray, names: pa.Array, position: np.ndarray, temperatures: Sequence[float]) -> dict:
    """The state after a further part; on ties the classes that came first stay."""
    row = np.arange(len(z))
    at = z.argmax(1)
    part_top = z[row, at]
    below = z.copy()
    below[row, at] = -np.inf
    runner = below.argmax(1)
    part_second = below[row, runner]
    top = np.maximum(state["top"], part_top)
    down = np.where(np.isfinite(state["top"]), state["top"] - top, 0.0)
    shrink = np.exp(down[:, None] / np.asarray(temperatures))
    mass, weighted = sums_below(z, top, temperatures)
    new = {
        "top": top,
        "mass": state["mass"] * shrink + mass,
        "weighted": (state["weighted"] + down[:, None] * state["mass"]) * shrink + weighted,
        "square": state["square"] * np.exp(2 * down) + np.exp(2 * (z - top[:, None])).sum(1),
        "own": np.where(position >= 0, z[row, np.maximum(position, 0)], state["own"]),
    }
    ahead = part_top > state["top"]
    # Of the two that are left, the runner-up: the old best or the part's best, against the second of the winner's side.
    loser_z, side_z = np.where(ahead, state["top"], part_top), np.where(ahead, part_second, state["second_z"])
    loser = pc.if_else(pa.array(ahead), state["best"], names.take(pa.array(at)))
    side = pc.if_else(pa.array(ahead), names.take(pa.array(runner)), state["second"])
    # An old class wins a tie: the loser's side is old where the part is ahead.
    take_loser = np.where(ahead, loser_z >= side_z, loser_z > side_z)
    new["best"] = pc.if_else(pa.array(ahead), names.take(pa.array(at)), state["best"])
    new["second_z"] = np.where(take_loser, loser_z, side_z)
    new["second"] = pc.if_else(pa.array(np.isfinite(new["second_z"])), pc.if_else(pa.array(take_loser), loser, side), pa.nulls(len(z), names.type))
    return new


def _lists(values: np.ndarray) -> pa.Array:
    at = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel()))


def _wire(state: dict) -> list[pa.Array]:
    return [_lists(v) if isinstance(v, np.ndarray) and v.ndim == 2 else pa.array(v) if isinstance(v, np.ndarray) else v
            for v in (state[f.name[2:]] for f in _state_type(T.LongType()))]


def _read(batch: pa.RecordBatch, temperatures: int) -> dict:
    state = {}
    for f in _state_type(T.LongType()):
        column = batch.column(f.name)
        name = f.name[2:]
        if name in ("mass", "weighted"):
            state[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, temperatures)
        else:
            state[name] = column if name in ("best", "second") else column.to_numpy(zero_copy_only=False)
    return state


def _joined(parts: list[dict], kind: pa.DataType, temperatures: int) -> dict:
    if not parts:
        return _empty(0, temperatures, kind)
    return {name: np.concatenate([p[name] for p in parts]) if isinstance(parts[0][name], np.ndarray) else pa.concat_arrays([p[name] for p in parts])
            for name in parts[0]}


def fold(df: DataFrame, parts: ModelParts, vector: str, label: str, metric: str = "euclidean", scale: float = LOGIT_SCALE,
         temperatures: Sequence[float] = (1.0,)) -> DataFrame:
    """``df`` with the state of each record over all classes, as columns that begin with ``__``."""
    if any(c.startswith("__") for c in df.columns):
        raise ValueError("columns that begin with __ are used for the state")
    state = _state_type(parts.kind)
    schema = T.StructType([*df.schema.fields, *state])
    rows = df
    for nth, (names, matrix) in enumerate(parts):
        if nth:
            rows = cut_lineage(rows, "class-states")
        rows = rows.mapInArrow(_folding(names, matrix, vector, label, metric, scale, tuple(temperatures), nth == 0), schema)
    return rows


def _folding(names: pa.Array, matrix: np.ndarray, vector: str, label: str, metric: str, scale: float, temperatures: tuple, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CHUNK_VALUES // len(matrix))
        for batch in batches:
            kept = batch.select([c for c in batch.schema.names if not c.startswith("__")])
            x = _rows(batch.column(vector), matrix.shape[1])
            position = pc.index_in(batch.column(label).cast(names.type), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
            state = _empty(len(x), len(temperatures), names.type) if first else _read(batch, len(temperatures))
            done = []
            for at in range(0, len(x), step):
                some = slice(at, at + step)
                now = {k: v[some] if isinstance(v, np.ndarray) else v.slice(at, step) for k, v in state.items()}
                done.append(_merged(now, -scale * _distances(x[some], matrix, metric), names, position[some], temperatures))
            merged = _joined(done, names.type, len(temperatures))
            yield pa.RecordBatch.from_arrays([*kept.columns, *_wire(merged)], [*kept.schema.names, *[f.name for f in _state_type(T.LongType())]])

    return run


def _nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def score_any(df: DataFrame, parts: ModelParts, vector: str, label: str, metric: str = "euclidean", scale: float = LOGIT_SCALE) -> DataFrame:
    """``df`` with ``pred``, ``conf``, ``second_class``, ``second``, ``entropy``, ``nll``, ``brier``, distances and ``correct``.

    ``distance`` is that of the nearest class, ``true_distance`` that of the
    record's own class and ``competitor_distance`` that of the nearest other one.
    A null label, or one that no class has, gives null likelihood terms, and a model
    of one class has no second. Entropy is taken without a floor under the probabilities,
    which would add less than 3e-11 for each class.
    """
    own, top = F.col("__own"), F.col("__top")
    own = _nan_to_null(own)
    mass = F.col("__mass")[0]
    conf = 1.0 / mass
    mine = F.exp(own - top) / mass
    second_z = F.when(F.col("__second").isNotNull(), F.col("__second_z"))
    right = F.col("__best").eqNullSafe(F.col(label))
    out = fold(df, parts, vector, label, metric, scale)
    return out.select(
        *df.columns, F.col("__best").alias("pred"), conf.alias("conf"), F.col("__second").alias("second_class"),
        (F.exp(second_z - top) / mass).alias("second"), (F.log(mass) - F.col("__weighted")[0] / mass).alias("entropy"),
        (F.log(mass) - (own - top)).alias("nll"), (F.col("__square") / (mass * mass) - 2.0 * mine + 1.0).alias("brier"),
        (-top / scale).alias("distance"), (-own / scale).alias("true_distance"),
        (-F.when(right, second_z).otherwise(top) / scale).alias("competitor_distance"), right.alias("correct"))


def curve(df: DataFrame, parts: ModelParts, vector: str, label: str, temperatures: Sequence[float], scale: float = LOGIT_SCALE) -> DataFrame:
    """One row ``(records, nll, gap)`` over records of known classes: sums for each temperature, see ``calibration.fit_temperature``."""
    grid = np.asarray(temperatures, np.float64)
    states = fold(df.select(vector, label), parts, vector, label, "euclidean", scale, tuple(float(t) for t in grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, nll, gap = 0, np.zeros(len(grid)), np.zeros(len(grid))
        for batch in batches:
            s = _read(batch, len(grid))
            known = ~np.isnan(s["own"])
            below = (s["own"] - s["top"])[known, None]
            mass, weighted = s["mass"][known], s["weighted"][known]
            n += int(known.sum())
            nll += (np.log(mass) - below / grid).sum(0)
            gap += (weighted / mass - below).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([nll.tolist()]), pa.array([gap.tolist()])], ["records", "nll", "gap"])

    return added_up(states.mapInArrow(run, "records long, nll array<double>, gap array<double>"), len(grid))


def added_up(sums: DataFrame, size: int) -> DataFrame:
    """The sums of all tasks, element by element."""
    return sums.agg(F.sum("records").alias("records"), *[
        F.array(*[F.sum(F.col(c)[i]) for i in range(size)]).alias(c) for c in ("nll", "gap")])
