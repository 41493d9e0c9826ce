"""Expressions over probability, logit and feature arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PROBABILITY_FLOOR = 1e-12
ROW_SUM_TOLERANCE = 1e-5


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def normalise(weights: Column) -> Column:
    return let(weights, lambda w: let(total(w), lambda s: F.transform(w, lambda x: x / s)))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Shifted by the maximum before the exponential, so nothing overflows."""
    scale = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return normalise(let(
        F.array_max(logits), lambda top: F.transform(logits, lambda z: F.exp((z - top) / scale))))


def log_sum_exp(logits: Column, temperature: Column) -> Column:
    """``log(sum(exp(z / T)))`` with the maximum taken out."""
    return let(F.array_max(logits), lambda top: F.log(F.aggregate(
        logits, F.lit(0.0), lambda acc, z: acc + F.exp((z - top) / temperature))) + top / temperature)


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_two(values: Column) -> Column:
    """Largest two entries with their positions; ties go to the lower position, a missing second one is null."""
    ranked = F.sort_array(
        F.transform(values, lambda p, i: F.struct((-p).alias("neg"), i.alias("pos")))
    )
    return F.struct(
        (-ranked[0]["neg"]).alias("p1"), ranked[0]["pos"].alias("c1"),
        (-F.try_element_at(ranked, F.lit(2))["neg"]).alias("p2"), F.try_element_at(ranked, F.lit(2))["pos"].alias("c2"),
    )


def entropy(probabilities: Column) -> Column:
    """In nats; entries are clipped to [1e-12, 1] first."""
    clipped = F.transform(
        probabilities, lambda p: F.least(F.greatest(p, F.lit(PROBABILITY_FLOOR)), F.lit(1.0)))
    return -F.aggregate(clipped, F.lit(0.0), lambda acc, p: acc + p * F.log(p))


def kl_divergence(full: Column, reduced: Column) -> Column:
    def term(p: Column, q: Column) -> Column:
        p = F.greatest(p, F.lit(PROBABILITY_FLOOR))
        q = F.greatest(q, F.lit(PROBABILITY_FLOOR))
        return p * (F.log(p) - F.log(q))

    return total(F.zip_with(full, reduced, term))


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def share(a: Column, b: Column) -> Column:
    return a / F.greatest(a + b, F.lit(PROBABILITY_FLOOR))


def vector_problem(values: Column, width: int) -> Column:
    """First reason a probability vector is not usable, null when it is."""
    infinite = F.lit(float("inf"))
    return (
        F.when(values.isNull() | F.exists(values, lambda x: x.isNull()), "missing")
        .when(F.size(values) != width, "wrong_width")
        .when(F.exists(values, lambda x: F.isnan(x) | (F.abs(x) == infinite)), "not_finite")
        .when(F.exists(values, lambda x: x < 0), "negative")
        .when(F.exists(values, lambda x: x > 1), "above_one")
        .when(F.abs(total(values) - 1.0) > ROW_SUM_TOLERANCE, "row_sum")
    )


def project_classes(probabilities: Column, positions: Sequence[int]) -> Column:
    """Keep the given class positions and renormalise; fails on a row without mass."""
    kept = F.transform(F.array(*[F.lit(int(i)) for i in positions]), lambda i: probabilities[i])
    checked = F.when(total(kept) > 0, kept).otherwise(
        F.raise_error(F.lit("no probability mass on the common classes")).cast("array<double>"))
    return normalise(checked)


def blend(first: Column, second: Column, alpha: float | Column) -> Column:
    """``alpha * first + (1 - alpha) * second``."""
    weight = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.zip_with(first, second, lambda a, b: weight * a + (F.lit(1.0) - weight) * b)
