"""Calibration error, likelihood scores and a one-parameter temperature fit."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.functions import bins, vectors
from catalumen.operators import classparts

HIGH_CONFIDENCE = 0.90
# Temperatures are whole multiples of 1/20000, so every engine sees the same doubles.
TEMPERATURE_UNIT = 20_000
# The first grid reaches from a hundredth to two hundred thousand.
LEAST_UNIT, MOST_UNIT, GRID = 200, 4_000_000_000, 64
NEAR_UNITS = 24


def bin_table(spark, n_bins: int) -> DataFrame:
    """``(bin, lower, upper)``; the upper end of the last bin is exactly one."""
    width = 1.0 / n_bins
    return spark.range(n_bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.col("id") * F.lit(width)).alias("lower"),
        F.when(F.col("id") == n_bins - 1, F.lit(1.0)).otherwise((F.col("id") + 1) * F.lit(width)).alias("upper"))


def reliability_counts(scored: DataFrame, confidence: str, correct: str, n_bins: int = bins.CALIBRATION_BINS) -> DataFrame:
    return scored.groupBy(bins.equal_width_bin(F.col(confidence), n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(correct)).alias("n_correct"),
        F.avg(confidence).alias("mean_confidence"))


def reliability_table(scored: DataFrame, confidence: str, correct: str, n_bins: int = bins.CALIBRATION_BINS) -> DataFrame:
    """One row per bin, empty bins kept with null statistics."""
    counts = reliability_counts(scored, confidence, correct, n_bins)
    return bin_table(scored.sparkSession, n_bins).join(F.broadcast(counts), "bin", "left").select(
        (F.col("bin") + 1).alias("bin"), "lower", "upper",
        F.coalesce("n", F.lit(0)).alias("count"), "mean_confidence",
        (F.col("n_correct") / F.col("n")).alias("accuracy"),
        F.abs(F.col("mean_confidence") - F.col("n_correct") / F.col("n")).alias("gap"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    return table.agg(F.try_divide(F.sum(F.col("count") * F.col("gap")), F.sum("count")).alias("ece"))


def brier_term(probabilities: Column, label_position: Column) -> Column:
    """Squared distance between a probability vector and the one-hot truth."""
    squares = F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc + p * p)
    return squares - 2.0 * probabilities[label_position] + 1.0


def nll_term(logits: Column, label_position: Column, temperature: Column | float = 1.0) -> Column:
    scale = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return vectors.log_sum_exp(logits, scale) - logits[label_position] / scale


def likelihood_scores(scored: DataFrame, logits: str, label_position: str, temperature: float = 1.0) -> DataFrame:
    """One row: records, accuracy, NLL, Brier score and a confidence summary."""
    base = scored.select(
        F.col(label_position).alias("y"), F.col(logits).alias("z"),
        vectors.softmax(F.col(logits), temperature).alias("p"))
    rows = base.select(
        nll_term(F.col("z"), F.col("y"), temperature).alias("nll"),
        brier_term(F.col("p"), F.col("y")).alias("brier"),
        F.array_max("p").alias("conf"),
        (vectors.argmax(F.col("p")) == F.col("y")).alias("correct"))
    high = F.col("conf") >= HIGH_CONFIDENCE
    return rows.agg(
        F.count(F.lit(1)).alias("records"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
        F.avg("nll").alias("nll"),
        F.avg("brier").alias("brier"),
        F.avg("conf").alias("mean_confidence"),
        F.min("conf").alias("min_confidence"),
        F.max("conf").alias("max_confidence"),
        F.count_if(high).alias("high_confidence_count"),
        F.avg(F.when(high, F.col("correct").cast("int"))).alias("high_confidence_accuracy"),
        (1.0 - F.avg(F.when(high, F.col("correct").cast("int")))).alias("high_confidence_error_rate"))


class Temperature(NamedTuple):
    """A fitted temperature, the mean NLL there, and whether a minimum was found."""

    value: float
    nll: float | None
    converged: bool


def array_curve(scored: DataFrame, logits: str, label_position: str, temperatures: Sequence[float]) -> DataFrame:
    """One row ``(records, nll, gap)``: for each temperature the sums over records with a known class.

    ``gap`` adds up the expected logit minus the logit of the true class: the
    derivative of NLL by one over the temperature. Each task adds up its records
    and returns one row.
    """
    grid = np.asarray(temperatures, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, nll, gap = 0, np.zeros(len(grid)), np.zeros(len(grid))
        for batch in batches:
            lengths = batch.column("z").value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(lengths):
                part = batch.filter(pa.array(lengths == width))
                z = part.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                y = part.column("y").to_numpy(zero_copy_only=False)
                top = z.max(1)
                below = (z[np.arange(len(z)), y] - top)[:, None]
                mass, weighted = classparts.sums_below(z, top, grid)
                n += len(z)
                nll += (np.log(mass) - below / grid).sum(0)
                gap += (weighted / mass - below).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([nll.tolist()]), pa.array([gap.tolist()])], ["records", "nll", "gap"])

    known = scored.filter(F.col(label_position).isNotNull()).select(
        F.col(logits).cast("array<double>").alias("z"), F.col(label_position).cast("int").alias("y"))
    return classparts.added_up(known.mapInArrow(run, "records long, nll array<double>, gap array<double>"), len(grid))


def nll_by_temperature(scored: DataFrame, logits: str, label_position: str, units: Sequence[int]) -> DataFrame:
    """Mean NLL for each temperature ``unit / 20000``, in one pass over the records."""
    sums = array_curve(scored, logits, label_position, [u / TEMPERATURE_UNIT for u in units])
    listed = F.arrays_zip(F.array(*[F.lit(int(u)) for u in units]).alias("unit"), "nll")
    return sums.select("records", F.explode(listed).alias("s")).select(
        F.col("s.unit").alias("unit"), F.try_divide("s.nll", "records").alias("nll"))


def fit_temperature(curve: Callable[[Sequence[float]], DataFrame]) -> Temperature:
    """Temperature with the lowest mean NLL, in three passes of ``curve``, which gives the sums for any list of temperatures.

    NLL is convex in one over the temperature, so its derivative changes sign
    once. The first pass brackets that on a wide grid, the second on a fine one
    within the bracket, and a cubic through the points around the change gives
    the place to a billionth; the third pass compares the whole units around
    it. If the derivative never changes sign (classes that are always or
    never right, no records) the end of the grid is returned, not converged.
    """
    grid = np.geomspace(LEAST_UNIT, MOST_UNIT, GRID)
    for _ in range(2):
        row = curve([u / TEMPERATURE_UNIT for u in grid]).first()
        if not row["records"]:
            return Temperature(1.0, None, False)
        gap, nll = np.array(row["gap"]), np.array(row["nll"]) / row["records"]
        change = int((gap > 0).sum())
        if change in (0, len(grid)):
            end = min(change, len(grid) - 1)
            return Temperature(float(grid[end]) / TEMPERATURE_UNIT, float(nll[end]), False)
        last, grid = grid, np.geomspace(grid[change - 1], grid[change], GRID)
    near = slice(max(0, change - 2), change + 2)
    middle = _crossing(np.log(last[near]), gap[near], np.log(last[change - 1]), np.log(last[change]))
    centre = round(math.exp(middle))
    units = [u for u in range(centre - NEAR_UNITS, centre + NEAR_UNITS + 1) if u > 0]
    row = curve([u / TEMPERATURE_UNIT for u in units]).first()
    nll, unit = min(zip((v / row["records"] for v in row["nll"]), units))
    return Temperature(unit / TEMPERATURE_UNIT, nll, True)


def _crossing(x: np.ndarray, y: np.ndarray, low: float, high: float) -> float:
    """Where the polynomial through the points crosses zero between ``low`` and ``high``; it is falling there."""
    middle, width = (low + high) / 2, (high - low) / 2
    line = np.polyfit((x - middle) / width, y / np.abs(y).max(), len(x) - 1)
    a, b = -1.0, 1.0
    for _ in range(60):
        c = (a + b) / 2
        a, b = (c, b) if np.polyval(line, c) > 0 else (a, c)
    return middle + width * (a + b) / 2
