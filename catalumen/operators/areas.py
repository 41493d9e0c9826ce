"""Areas under ranking and risk-coverage curves, exact and with ties, from counted scores.

Equal scores are one row with their counts. Counts are added up inside
sketch-chosen ranges of the score, and each range starts from the sums of the ranges above it,
so no window runs over all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalumen.operators.ranking import _range_limits, _range_of, range_count


def counted_scores(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """``(score, pos, neg)``: records with and without the property at each distinct score; null scores and labels are left out."""
    known = rows.filter(F.col(score).isNotNull() & F.col(positive).isNotNull())
    return known.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))


def running_counts(counted: DataFrame) -> DataFrame:
    """``(score, pos, neg, pos_above, neg_above)``: how many records have a higher score."""
    ranges = range_count(counted)
    limits = counted.agg(_range_limits("score", ranges).alias("__limits")).scalar()
    ranged = counted.withColumn("__limits", limits).withColumn(
        "__range", _range_of(F.col("__limits"), F.col("score"), ranges)).drop("__limits")
    per_range = ranged.groupBy("__range").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    # One row a range; their number is bounded.
    higher = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    above = per_range.select("__range", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_above") for c in ("__p", "__n")])
    inside = Window.partitionBy("__range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(above), "__range")
    return joined.select("score", "pos", "neg", *[
        (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{s}_above")).alias(f"{c}_above") for c, s in (("pos", "__p"), ("neg", "__n"))])


def ranking_areas(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: records, positives, ``auroc``, ``auprc`` (average precision) and ``aurc``.

    Ties count half for AUROC; precision and risk at a score take in all records that
    share it. ``aurc`` weighs the share of records without the property among all
    scored at least as high by the records at that score. Null where a class, or everything, is missing.
    """
    r = running_counts(counted_scores(rows, score, positive))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pos_to, neg_to = F.col("pos_above") + pos, F.col("neg_above") + neg
    sums = r.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n"),
        F.sum(neg * (F.col("pos_above") + pos / 2)).alias("won"),
        F.sum(pos * pos_to / (pos_to + neg_to)).alias("precision"),
        F.sum((pos + neg) * neg_to / (pos_to + neg_to)).alias("risk"))
    return sums.select(
        (F.col("p") + F.col("n")).alias("records"), F.col("p").alias("positives"),
        F.try_divide("won", F.col("p").cast("double") * F.col("n")).alias("auroc"),
        F.try_divide("precision", F.col("p")).alias("auprc"), F.try_divide("risk", F.col("p") + F.col("n")).alias("aurc"))
