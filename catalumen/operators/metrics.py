"""Classification quality from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalumen.functions import labels

METRICS = ("accuracy", "macro_f1", "weighted_f1")


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """``(by..., truth, predicted, n)``; all later metrics work on these counts."""
    return df.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def class_report(counts: DataFrame, by: list[str] | None = None, classes: DataFrame | None = None) -> DataFrame:
    """Per class: support, predicted, correct, precision, recall, F1.

    The classes seen on either side get a row. With ``classes`` (one column
    ``class``, no ``by``) exactly the listed ones do, also those that never occur.
    """
    by = by or []
    if by and classes is not None:
        raise ValueError("list the classes either for all rows together or not at all")
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).cast("long").alias("correct")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("correct")))
    report = counts.select(*by, F.explode(sides).alias("s")).select(*by, "s.*").groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])
    if classes is not None:
        report = classes.select("class").join(report, "class", "left").na.fill(
            0, ["support", "predicted", "correct"])
    support, predicted, correct = F.col("support"), F.col("predicted"), F.col("correct")
    return report.select(
        *by, "class", "support", "predicted", "correct",
        (support - correct).alias("incorrect"),
        F.when(predicted > 0, correct / predicted).otherwise(0.0).alias("precision"),
        F.when(support > 0, correct / support).otherwise(0.0).alias("recall"),
        F.when(support + predicted > 0, 2 * correct / (support + predicted)).otherwise(0.0).alias("f1"),
    )


def summary(report: DataFrame, by: list[str] | None = None, n_classes: Column | int | None = None) -> DataFrame:
    """Accuracy, macro-F1 and support-weighted F1 of a class report.

    Macro-F1 averages over the classes of the report, or over a fixed class
    list of ``n_classes`` when that is given (absent classes count as zero).
    """
    total = F.sum("support")
    macro = F.avg("f1") if n_classes is None else F.sum("f1") / (
        n_classes if isinstance(n_classes, Column) else F.lit(n_classes))
    aggregates = [
        total.alias("records"),
        F.try_divide(F.sum("correct"), total).alias("accuracy"),
        macro.alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
    ]
    return report.groupBy(*by).agg(*aggregates) if by else report.agg(*aggregates)


def evaluate(
    df: DataFrame, truth: str, predicted: str,
    by: list[str] | None = None, n_classes: Column | int | None = None,
) -> DataFrame:
    return summary(class_report(confusion(df, truth, predicted, by), by), by, n_classes)


def confusion_pairs(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return counts.filter(F.col("truth") != F.col("predicted"))


def accuracy_by_support(report: DataFrame) -> DataFrame:
    bucket = labels.support_bucket(F.col("support"))
    return report.groupBy(bucket.alias("support_bucket")).agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("support").alias("records"),
        F.sum("correct").alias("correct"),
        F.count_if(F.col("predicted") == 0).alias("never_predicted"),
    ).withColumn("accuracy", F.when(F.col("records") > 0, F.col("correct") / F.col("records")))


def long_metrics(summaries: DataFrame, model: str) -> DataFrame:
    """``(model, metric, value)`` rows."""
    return summaries.select(
        model, F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m")
    ).select(model, "m.metric", "m.value")


def rank_models(long: DataFrame, model: str = "model") -> DataFrame:
    """Best first per metric, equal values in name order."""
    order = Window.partitionBy("metric").orderBy(F.col("value").desc(), F.col(model))
    return long.withColumn("rank", F.row_number().over(order))


def best_setting(summaries: DataFrame, setting: str, first: tuple[str, ...]) -> DataFrame:
    """One row: the setting with the best metrics, compared in the given order.

    The lowest setting wins a full tie. Metrics are compared to twelve digits, so
    that two settings with the same counts do tie whatever the order of summation.
    """
    return summaries.orderBy(*[F.round(m, 12).desc() for m in first], F.col(setting)).limit(1)


def metric_deltas(long: DataFrame, model: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Difference and relative change of each metric for each ``(model, base)`` pair.

    The relative change is null when the base value is zero.
    """
    values = long.groupBy("metric").pivot(model, sorted({m for p in pairs for m in p})).agg(F.first("value"))
    rows = [
        F.struct(F.lit(a).alias("model"), F.lit(b).alias("base"),
                 (F.col(a) - F.col(b)).alias("delta"),
                 F.try_divide(F.col(a) - F.col(b), F.col(b)).alias("relative_change"))
        for a, b in pairs]
    return values.select("metric", F.explode(F.array(*rows)).alias("r")).select("metric", "r.*")


def fusion_outcome(fused: Column, text: Column, image: Column) -> Column:
    return (
        F.when((fused > text) & (fused > image), "better_than_both")
        .when(fused > text, "better_than_text_only")
        .when(fused > image, "better_than_image_only")
        .when((fused == text) & (fused == image), "equal_to_both")
        .otherwise("not_better_than_either")
    )
