"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 1_000
SMALL_ROWS = 100_000


def hot_keys(left: DataFrame, keys: list[str], max_hot: int = MAX_HOT_KEYS) -> DataFrame:
    """Keys holding more than ``1/max_hot`` of the rows, with a salt count.

    There can be at most ``max_hot`` of them, whatever the size of the data.
    """
    counts = left.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total")).scalar()
    return counts.filter(F.col("__n") * F.lit(max_hot) > total).select(
        *keys, F.ceil(F.col("__n") * F.lit(max_hot) / total).cast("int").alias("__salts"))


def join_spread(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    max_hot: int = MAX_HOT_KEYS,
    hot: DataFrame | None = None,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Equi-join in which ``right`` has few rows per key and ``left`` may be skewed.

    A hot key is cut into as many salted shares as its size asks for and only
    the matching right rows are repeated, so no task receives more than about
    ``1/max_hot`` of the left side and no left row is dropped. ``spread_by``
    names hashable columns that tell left rows apart (all of them by default).
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    hot = hot if hot is not None else hot_keys(left, keys, max_hot)
    # Proven bound: hot_keys never returns more than max_hot rows.
    hot = F.broadcast(hot)
    # A hash of the row, not a random number: a task that runs again after a lost
    # executor must send each row to the same share.
    spread = F.xxhash64(*(spread_by or [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]))
    unmatched = F.lit(False)
    for key in keys:
        unmatched = unmatched | F.col(key).isNull()
    salted_left = left.join(hot, keys, "left").withColumn(
        "__salt",
        F.when(unmatched, F.pmod(spread, F.lit(max_hot)))
        .when(F.col("__salts") > 1, F.pmod(spread, F.col("__salts")))
        .otherwise(0).cast("int"),
    ).drop("__salts")
    salted_right = right.join(hot, keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    ).drop("__salts")
    return salted_left.join(salted_right, [*keys, "__salt"], how).drop("__salt")


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint only after counting; otherwise Spark shuffles the join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def lookup(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", max_rows: int = SMALL_ROWS
) -> DataFrame:
    """Join to a narrow table with one row per key: broadcast while it is small, spread beyond that."""
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), keys, how)
    return join_spread(left, right, keys, how)


def assert_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` that fails at run time on a repeated, unmatched or null key.

    Both sides are grouped by the key in one shuffle, and a key that is not
    there exactly once on each side stops the job where it is found.
    """
    sides = [(left, "__l"), (right, "__r")]
    rows = [df.select(F.col(key), F.struct(F.lit(1).alias("__one"), *[F.col(c) for c in df.columns if c != key]).alias(name)) for df, name in sides]
    grouped = rows[0].unionByName(rows[1], allowMissingColumns=True).groupBy(key).agg(
        *[F.count(n).alias(f"{n}_n") for _, n in sides], *[F.first(n, ignorenulls=True).alias(n) for _, n in sides])
    fits = F.col(key).isNotNull() & (F.col("__l_n") == 1) & (F.col("__r_n") == 1)
    told = F.concat(F.lit("keys that do not match one to one, such as "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return grouped.filter(F.when(fits, F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))).select(
        key, *[F.col(f"{name}.`{c}`").alias(c) for df, name in sides for c in df.columns if c != key])
