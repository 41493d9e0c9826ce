"""Row numbers, permutations and exact percentiles without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalumen.operators.joins import lookup
from catalumen.session import cut_lineage

MIN_RANGES, MAX_RANGES = 64, 10_000


def range_count(df: DataFrame) -> int:
    """A few ranges per core of the cluster, within fixed bounds."""
    return min(MAX_RANGES, max(MIN_RANGES, 4 * df.sparkSession.sparkContext.defaultParallelism))


def _range_limits(value: str, ranges: int) -> Column:
    """Aggregate: sketched quantiles that cut the values into about equal ranges."""
    return F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10 * ranges))


def _range_of(limits: Column, value: Column, ranges: int) -> Column:
    """Number of limits below a value, in two steps of about sqrt(ranges) comparisons."""
    step = max(1, int(math.sqrt(ranges)))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1), F.lit(step)), lambda i: F.get(limits, i - 1))
    block = F.greatest(F.size(F.filter(coarse, lambda x: x < value)) - 1, F.lit(0)) * step
    return block + F.size(F.filter(F.slice(limits, block + 1, F.lit(step)), lambda x: x < value))


def _numbered(df: DataFrame, bucket: str, order: Sequence[Column | str], name: str) -> DataFrame:
    """0-based rank: rank inside the bucket plus the rows of all earlier buckets."""
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("__n"))
    # At most one row per bucket, and the callers bound the number of buckets (65536).
    before = counts.select(
        bucket,
        (F.sum("__n").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0))
         - F.col("__n")).alias("__before"),
    )
    within = F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) - 1
    return (
        df.withColumn("__within", within)
        .join(F.broadcast(before), bucket)
        .withColumn(name, (F.col("__before") + F.col("__within")).cast("long"))
        .drop("__before", "__within", bucket)
    )


def rank_by_number(df: DataFrame, key: str, name: str = "row_index") -> DataFrame:
    """Dense 0-based row number in the order of a unique numeric key.

    Range limits come from a quantile sketch; every row is then ranked inside
    its own range, so the work is spread over the ranges.
    """
    ranges = range_count(df)
    limits = df.agg(_range_limits(key, ranges).alias("__limits")).scalar()
    ranged = df.withColumn("__limits", limits).withColumn(
        "__range", _range_of(F.col("__limits"), F.col(key), ranges)).drop("__limits")
    return _numbered(ranged, "__range", [key], name)


def rank_by_order(df: DataFrame, key: str, name: str = "row_index") -> DataFrame:
    """Dense 0-based row number in the order of a unique key of any type: ranges are cut by Spark's sampler and written."""
    ranged = cut_lineage(df.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "ranges")
    return _numbered(ranged, "__range", [key], name)


def rank_by_hash(df: DataFrame, key: str, seed: str, name: str = "row_index") -> DataFrame:
    """Dense 0-based row number in the order of SHA-256 over ``seed|key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    hashed = df.withColumn("__digest", digest).withColumn(
        "__head", F.conv(F.substring("__digest", 1, 4), 16, 10).cast("int"))
    return _numbered(hashed, "__head", ["__digest", key], name).drop("__digest")


def permute_column(df: DataFrame, key: str, column: str, seed: str) -> DataFrame:
    """Give each record the ``column`` of another one, by a seeded permutation.

    The i-th record in key order receives the value of the i-th record in hash
    order: a complete permutation that any rerun repeats.
    """
    targets = rank_by_number(df.drop(column), key, "__rank")
    donors = rank_by_hash(df.select(key, column), key, seed, "__rank").select(
        "__rank", F.col(key).alias(f"{column}_from"), column)
    # Both sides have a row for each record: never broadcast.
    return targets.join(donors.hint("merge"), "__rank").drop("__rank")


def permutation_report(permuted: DataFrame, key: str, donor: str) -> DataFrame:
    """``(records, distinct_sources, complete, unmoved)``: a control must use every record once and leave few in place."""
    used = permuted.groupBy(donor).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key) == F.col(donor)).alias("own"))
    return used.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("distinct_sources"),
                    (F.coalesce(F.max("n"), F.lit(1)) == 1).alias("complete"), F.coalesce(F.sum("own"), F.lit(0)).alias("unmoved"))


def file_order_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Dense row number in file order, counting the rows that are in ``df`` and no others.

    ``df`` comes straight from ``sources.delimited.read_lines(..., ordered=True)``
    or has had rows filtered since, but was not shuffled. Rows are counted where
    they are read; one row per file split, and no line, is shuffled.
    """
    counted = df.drop("__mono").withColumn("__place", F.monotonically_increasing_id())
    splits = counted.groupBy("__file", "__start").agg(
        F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = splits.select(
        "__file", "__start",
        (F.sum("__n").over(
            Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("__n") - F.col("__first")).alias("__shift"))
    return lookup(counted, before, ["__file", "__start"], "inner").withColumn(
        name, F.col("__shift") + F.col("__place")).drop("__file", "__start", "__place", "__shift")


def exact_percentiles(
    counted: DataFrame, group: str, value: str, n: str, fractions: Sequence[float]
) -> DataFrame:
    """Linear-interpolated percentiles per group, as one array column ``percentiles``.

    ``counted`` holds each value of a group once with its count ``n``, so a value
    that fills a third of all rows is one row here. The values are ranked in
    sketch-chosen ranges and only those at the wanted ranks are kept. ``group``
    must have few distinct values (a signal name, a split).
    """
    ranges = range_count(counted)
    limits = counted.groupBy(group).agg(
        _range_limits(value, ranges).alias("__limits"), F.sum(n).alias("__total"))
    # One row per group, and groups are few by contract.
    ranged = counted.join(F.broadcast(limits), group).withColumn(
        "__range", _range_of(F.col("__limits"), F.col(value), ranges)).drop("__limits")
    per_range = ranged.groupBy(group, "__range").agg(F.sum(n).alias("__m"))
    before = per_range.select(
        group, "__range",
        (F.sum("__m").over(
            Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("__m")).alias("__before"))
    last = F.sum(n).over(
        Window.partitionBy(group, "__range").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before") - 1
    # One row per group and range on the right.
    ranked = ranged.join(F.broadcast(before), [group, "__range"]).withColumn("__last", last).withColumn(
        "__first", F.col("__last") - F.col(n) + 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__first") <= rank) & (rank <= F.col("__last")), F.col(value)))

    picks = []
    for i, fraction in enumerate(fractions):
        position = (F.col("__total") - 1) * F.lit(float(fraction))
        picks += [at(F.floor(position)).alias(f"__lo{i}"), at(F.ceil(position)).alias(f"__hi{i}")]
    picked = ranked.groupBy(group).agg(F.max("__total").alias("__total"), *picks)
    result = []
    for i, fraction in enumerate(fractions):
        position = (F.col("__total") - 1) * F.lit(float(fraction))
        weight = position - F.floor(position)
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        result.append(low + (high - low) * weight)
    return picked.select(group, F.array(*result).alias("percentiles"))


def first_examples(df: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    """First ``k`` rows per group; pre-trimmed per input partition by Spark's group limit."""
    return df.withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    ).filter(F.col("__rn") <= k).drop("__rn")
