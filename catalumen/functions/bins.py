"""Exact binning against fixed grids, without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
THRESHOLD_STEPS = 100
CALIBRATION_BINS = 15
MARGIN_EDGES = (0.00, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 1.00)
CONFIDENCE_EDGES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
SHARE_EDGES = (0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.000001)


def threshold_index(x: Column, steps: int = THRESHOLD_STEPS) -> Column:
    """Largest ``i`` with ``i/steps <= x``.

    ``floor(x * steps)`` alone is off by one for values such as 0.29, so the
    guess is corrected against the grid value itself.
    """
    guess = F.floor(x * steps).cast("int")
    return (
        guess
        + F.when((guess + 1) / F.lit(float(steps)) <= x, 1).otherwise(0)
        - F.when(guess / F.lit(float(steps)) > x, 1).otherwise(0)
    )


def equal_width_bin(x: Column, n_bins: int = CALIBRATION_BINS) -> Column:
    """0-based bin of ``[0,1]`` cut into ``n_bins``; the last bin is closed."""
    width = 1.0 / n_bins
    guess = F.floor(x * n_bins).cast("int")
    index = (
        guess
        + F.when((guess + 1) * F.lit(width) <= x, 1).otherwise(0)
        - F.when(guess * F.lit(width) > x, 1).otherwise(0)
    )
    return F.least(F.greatest(index, F.lit(0)), F.lit(n_bins - 1))


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """0-based bin for arbitrary edges, last bin closed, null outside."""
    index = F.lit(-1)
    for edge in edges[:-1]:
        index = index + F.when(x >= F.lit(float(edge)), 1).otherwise(0)
    return F.when((x >= F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1]))), index)
