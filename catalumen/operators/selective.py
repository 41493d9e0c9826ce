"""Coverage-risk and routing curves, confidence bins and class errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalumen.functions import bins
from catalumen.operators.calibration import bin_table, reliability_counts

LOW_CONFIDENCE_AUDIT = 0.50
LOW_CONFIDENCE_ANALYSIS = 0.60
HIGH_CONFIDENCE = 0.90


def threshold_counts(scored: DataFrame, confidence: str, correct: str, steps: int = bins.THRESHOLD_STEPS) -> DataFrame:
    """``(step, accepted, accepted_correct, total, total_correct)`` for all thresholds.

    One histogram over the records, then running sums over its few rows, instead
    of one pass per threshold.
    """
    histogram = scored.groupBy(bins.threshold_index(F.col(confidence), steps).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("c"))
    grid = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    # The histogram and the grid have steps + 1 rows at most.
    filled = grid.join(F.broadcast(histogram), "step", "left").na.fill(0, ["n", "c"])
    down = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.col("step").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    return filled.select(
        "step",
        (F.col("step") / F.lit(float(steps))).alias("threshold"),
        F.sum("n").over(down).alias("accepted"),
        F.sum("c").over(down).alias("accepted_correct"),
        F.sum("n").over(everything).alias("total"),
        F.sum("c").over(everything).alias("total_correct"))


def coverage_risk(counts: DataFrame) -> DataFrame:
    """Coverage, selective accuracy and risk; null where nothing is accepted."""
    accepted, correct, total = F.col("accepted"), F.col("accepted_correct"), F.col("total")
    return counts.select(
        "step", "threshold",
        accepted.alias("accepted_count"),
        (total - accepted).alias("abstained_count"),
        F.try_divide(accepted, total).alias("coverage"),
        F.try_divide(total - accepted, total).alias("abstention_rate"),
        correct.alias("accepted_correct_count"),
        (accepted - correct).alias("accepted_error_count"),
        F.try_divide(correct, accepted).alias("selective_accuracy"),
        F.try_divide(accepted - correct, accepted).alias("selective_risk"))


def routing(counts: DataFrame) -> DataFrame:
    """What goes to review at each threshold, and the share of errors caught there."""
    accepted, correct, total = F.col("accepted"), F.col("accepted_correct"), F.col("total")
    errors = total - F.col("total_correct")
    return counts.select(
        "step", "threshold",
        total.alias("total_records"),
        accepted.alias("accepted_count"),
        (total - accepted).alias("review_count"),
        F.try_divide(accepted, total).alias("coverage"),
        F.try_divide(total - accepted, total).alias("review_rate"),
        correct.alias("accepted_correct"),
        (accepted - correct).alias("accepted_errors"),
        (F.col("total_correct") - correct).alias("reviewed_correct"),
        (errors - (accepted - correct)).alias("reviewed_errors"),
        F.try_divide(correct, accepted).alias("machine_accepted_accuracy"),
        F.try_divide(accepted - correct, accepted).alias("machine_accepted_risk"),
        F.try_divide(errors - (accepted - correct), errors).alias("model_error_capture_rate"))


def route(confidence: Column, threshold: float) -> Column:
    return F.when(confidence >= F.lit(float(threshold)), "accept").otherwise("review")


def curve_checks(curve: DataFrame, steps: int = bins.THRESHOLD_STEPS) -> DataFrame:
    """``(check, passed)``: full grid, everything accepted at zero, coverage never rises."""
    before = F.lag("coverage").over(Window.orderBy("step"))
    marked = curve.withColumn("__rise", F.coalesce(F.col("coverage") > before + 1e-12, F.lit(False)))
    one = marked.agg(
        ((F.count(F.lit(1)) == steps + 1) & (F.min("step") == 0) & (F.max("step") == steps)).alias("grid_complete"),
        (F.max(F.when(F.col("step") == 0, F.col("abstained_count"))) == 0).alias("threshold_zero_accepts_all"),
        (F.count_if("__rise") == 0).alias("coverage_never_rises"),
        (F.count_if((F.col("accepted_count") > 0) & (
            F.col("accepted_correct_count") + F.col("accepted_error_count") != F.col("accepted_count"))) == 0
         ).alias("accepted_adds_up"))
    names = ["grid_complete", "threshold_zero_accepts_all", "coverage_never_rises", "accepted_adds_up"]
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).alias("passed")) for n in names])).alias("r")).select("r.*")


def confidence_bin_errors(scored: DataFrame, confidence: str, correct: str, n_bins: int = bins.CALIBRATION_BINS) -> DataFrame:
    """Per bin: counts, share of all records, accuracy and signed gap; zero when empty."""
    counts = reliability_counts(scored, confidence, correct, n_bins)
    # Runs over the few rows of the bin table.
    total = F.sum("n").over(Window.partitionBy())
    joined = bin_table(scored.sparkSession, n_bins).join(F.broadcast(counts), "bin", "left").na.fill(
        0, ["n", "n_correct", "mean_confidence"])
    n, correct_n = F.col("n"), F.col("n_correct")
    accuracy = F.coalesce(F.try_divide(correct_n, n), F.lit(0.0))
    return joined.select(
        F.col("bin").alias("bin_index"), F.col("lower").alias("lower_bound"), F.col("upper").alias("upper_bound"),
        n.alias("count"), correct_n.alias("correct"), (n - correct_n).alias("errors"),
        F.try_divide(n, total).alias("coverage_fraction"),
        F.col("mean_confidence"),
        accuracy.alias("empirical_accuracy"),
        F.coalesce(F.try_divide(n - correct_n, n), F.lit(0.0)).alias("empirical_error_rate"),
        (F.col("mean_confidence") - accuracy).alias("confidence_correctness_gap"))


def class_errors(scored: DataFrame, label: str, confidence: str, correct: str) -> DataFrame:
    sure_error = ~F.col(correct) & (F.col(confidence) >= HIGH_CONFIDENCE)
    return scored.groupBy(F.col(label).alias("class_id")).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(F.col(correct)).alias("correct"),
        F.count_if(~F.col(correct)).alias("errors"),
        F.avg(F.col(correct).cast("int")).alias("accuracy"),
        F.avg((~F.col(correct)).cast("int")).alias("error_rate"),
        F.avg(confidence).alias("mean_confidence"),
        F.count_if(sure_error).alias("high_confidence_errors"),
    ).withColumn("high_confidence_error_rate",
                 F.coalesce(F.try_divide(F.col("high_confidence_errors"), F.col("errors")), F.lit(0.0)))


def top_error_classes(per_class: DataFrame, k: int = 20) -> DataFrame:
    return per_class.orderBy(F.col("errors").desc(), F.col("support").desc(), "class_id").limit(k)


def confidence_outliers(scored: DataFrame, confidence: str, correct: str, low: float) -> DataFrame:
    """Wrong but sure, and right but unsure records, marked by ``kind``."""
    kind = F.when(~F.col(correct) & (F.col(confidence) >= HIGH_CONFIDENCE), "high_confidence_error").when(
        F.col(correct) & (F.col(confidence) < low), "low_confidence_correct")
    return scored.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def join_curves(coverage: DataFrame, routes: DataFrame) -> DataFrame:
    """Both curves side by side, matched on the integer grid step.

    Both have one row per step, so the broadcast side is bounded by the grid.
    """
    right = routes.select(
        "step", "total_records", "review_count", "review_rate", "reviewed_errors",
        F.col("accepted_errors"), "model_error_capture_rate")
    return coverage.select("step", "threshold", "accepted_count", "coverage", "selective_risk").join(
        F.broadcast(right), "step")
