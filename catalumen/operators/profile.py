"""Length and chunk profiles, signal statistics and population fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalumen.functions import bins, identity, text
from catalumen.operators.ranking import exact_percentiles
from catalumen.session import cut_lineage


def describe(values: DataFrame, group: str, value: str, fractions: Sequence[float]) -> DataFrame:
    """Count, range, mean, population deviation and exact percentiles per group.

    The input is read once: equal values are counted, the counts are written,
    and every statistic comes from them. ``group`` has few distinct values.
    """
    counted = cut_lineage(values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(
        F.count(F.lit(1)).alias("n")), "value-counts")
    n, v = F.col("n"), F.col(value)
    plain = counted.groupBy(group).agg(
        F.sum(n).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.sum(v * n) / F.sum(n)).alias("mean"))
    # One row per group on the small side of each join.
    spread = counted.join(F.broadcast(plain.select(group, "mean")), group).groupBy(group).agg(
        F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / F.sum(n)).alias("std"))
    return plain.join(spread, group).join(exact_percentiles(counted, group, value, "n", fractions), group)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, null when either side does not vary.

    Not ``corr``, which stops the job on a constant column under ANSI rules.
    """
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(
        F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def unpivot_signals(df: DataFrame, keep: list[str], signals: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals])).alias("s")
    ).select(*keep, "s.*")


def binned_accuracy(df: DataFrame, value: str, correct: str, edges: Sequence[float]) -> DataFrame:
    """Accuracy per fixed bin, last bin closed, empty bins kept with null accuracy."""
    counts = df.groupBy(bins.edge_bin(F.col(value), edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("c"))
    table = df.sparkSession.range(len(edges) - 1).select(
        F.col("id").cast("int").alias("bin"),
        F.array(*[F.lit(float(e)) for e in edges])[F.col("id").cast("int")].alias("lower_bound"),
        F.array(*[F.lit(float(e)) for e in edges])[F.col("id").cast("int") + 1].alias("upper_bound"))
    # One row per bin on both sides.
    return table.join(F.broadcast(counts), "bin", "left").select(
        "bin", "lower_bound", "upper_bound",
        F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("c", F.lit(0)).alias("correct"),
        (F.coalesce("n", F.lit(0)) - F.coalesce("c", F.lit(0))).alias("incorrect"),
        F.try_divide(F.col("c"), F.col("n")).alias("accuracy"))


def length_limits(lengths: DataFrame, length: str, limits: Sequence[int] = text.LENGTH_LIMITS) -> DataFrame:
    """Records within each limit, and tokens beyond the window."""
    one = lengths.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(length) <= k).alias(f"__w{k}") for k in limits])
    return one.select("__n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("limit"), F.col(f"__w{k}").alias("within")) for k in limits])).alias("l")).select(
        "l.limit", "l.within", (F.col("__n") - F.col("l.within")).alias("over"),
        (F.col("l.within") * 100.0 / F.col("__n")).alias("percent_within"))


def chunk_distribution(lengths: DataFrame, length: str) -> DataFrame:
    """Records per exact chunk count, and the share needing at most that many.

    The window runs over one row per distinct chunk count.
    """
    counts = lengths.groupBy(text.chunk_count(F.col(length)).alias("chunks")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("chunks").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("chunks").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(
        "chunks", "n", F.sum("n").over(upto).alias("records_up_to"),
        (F.sum("n").over(upto) * 100.0 / F.sum("n").over(everything)).alias("percent_up_to"))


def nearest_to_targets(lengths: DataFrame, key: str, length: str, targets: Sequence[int]) -> DataFrame:
    """For each target length the record closest to it, lowest key on a tie."""
    picks = lengths.agg(*[
        F.min(F.struct(F.abs(F.col(length) - t).alias("gap"), F.col(key).alias("key"),
                       F.col(length).alias("length"))).alias(f"t{t}") for t in targets])
    return picks.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"t{t}.key").alias(key),
                 F.col(f"t{t}.length").alias("length")) for t in targets])).alias("p")).select("p.*")


def population_fingerprints(df: DataFrame, views: dict[str, list[str]]) -> DataFrame:
    """``(view, records, fingerprint)``: order-free identity of ids, labels or full rows."""
    columns = [
        identity.set_fingerprint(F.sha2(F.concat_ws("|", *[
            F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]), 256)).alias(view)
        for view, names in views.items()]
    one = df.agg(F.count(F.lit(1)).alias("__n"), *columns)
    return one.select("__n", F.explode(F.array(*[
        F.struct(F.lit(v).alias("view"), F.col(v).alias("fingerprint")) for v in views])).alias("f")).select(
        "f.view", F.col("__n").alias("records"), "f.fingerprint")
