"""Late fusion of two probability vectors and comparison of the three predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.functions import vectors
from catalumen.operators import metrics

ALPHA_STEPS = 10
# Selection orders of the two sweeps.
ALPHA_ORDER = ("macro_f1", "accuracy", "weighted_f1")
GAMMA_ORDER = ("macro_f1", "weighted_f1", "accuracy")
GAMMAS = (0.1, 0.5, 1.0)


def fused_predictions(first: Column, second: Column, steps: int = ALPHA_STEPS) -> Column:
    """``array<{step, pred}>``: the fused argmax for every weight ``step / steps``."""
    grid = F.sequence(F.lit(0), F.lit(steps))
    return F.transform(grid, lambda i: F.struct(
        i.alias("step"),
        vectors.let(vectors.blend(first, second, i / F.lit(float(steps))), vectors.argmax).alias("pred")))


def sweep(df: DataFrame, first: str, second: str, truth: str, n_classes: int) -> DataFrame:
    """Metrics per fusion weight; only class positions are unfolded, never the vectors."""
    predictions = df.select(
        truth, F.explode(fused_predictions(F.col(first), F.col(second))).alias("f")
    ).select(truth, "f.*")
    return metrics.evaluate(predictions, truth, "pred", ["step"], n_classes).withColumn(
        "alpha", F.col("step") / F.lit(float(ALPHA_STEPS)))


def agreement_cases(df: DataFrame, text: str, image: str, fused: str) -> DataFrame:
    """Counts and shares of the eight right/wrong patterns and six complementarity rates."""
    t, i, f = F.col(text), F.col(image), F.col(fused)
    cases = {
        "all_three_correct": t & i & f,
        "text_correct_image_wrong_fusion_correct": t & ~i & f,
        "text_wrong_image_correct_fusion_correct": ~t & i & f,
        "both_wrong_fusion_correct": ~t & ~i & f,
        "both_correct_fusion_wrong": t & i & ~f,
        "text_correct_image_wrong_fusion_wrong": t & ~i & ~f,
        "text_wrong_image_correct_fusion_wrong": ~t & i & ~f,
        "both_wrong_fusion_wrong": ~t & ~i & ~f,
        "fusion_correct": f,
        "fusion_correct_when_text_wrong": ~t & f,
        "fusion_correct_when_image_wrong": ~i & f,
        "fusion_correct_when_both_wrong": ~t & ~i & f,
        "fusion_regression_when_both_correct": t & i & ~f,
        "fusion_correct_when_at_least_one_baseline_correct": (t | i) & f,
    }
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(c).alias(k) for k, c in cases.items()])
    return one.select("__n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("case"), F.col(k).alias("count")) for k in cases])).alias("c")).select(
        "c.case", "c.count", (F.col("c.count") / F.col("__n")).alias("rate"))


def ablation_rates(df: DataFrame, text_changed: str, image_changed: str, correct: str,
                   text_kl: str, image_kl: str) -> DataFrame:
    """How often keeping one view alone changes the prediction, overall and by correctness."""
    t, i, ok = F.col(text_changed), F.col(image_changed), F.col(correct)

    def rate(condition: Column, population: Column | None = None) -> Column:
        value = condition.cast("int")
        return F.avg(value if population is None else F.when(population, value))

    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(t).alias("text_only_changed"),
        F.count_if(i).alias("image_only_changed"),
        F.count_if(t & i).alias("both_changed"),
        F.count_if(~t & ~i).alias("neither_changed"),
        rate(t).alias("text_only_change_rate"),
        rate(i).alias("image_only_change_rate"),
        rate(t, ok).alias("text_only_change_rate_correct"),
        rate(t, ~ok).alias("text_only_change_rate_incorrect"),
        rate(i, ok).alias("image_only_change_rate_correct"),
        rate(i, ~ok).alias("image_only_change_rate_incorrect"),
        F.avg(text_kl).alias("mean_kl_text_only"),
        F.avg(image_kl).alias("mean_kl_image_only"))


def interpretation(delta_to_control: list[Column], delta_to_text: list[Column]) -> Column:
    """Label for a transfer experiment, from its gains over the control and over text alone."""
    def all_positive(columns: list[Column]) -> Column:
        result = columns[0] > 0
        for c in columns[1:]:
            result = result & (c > 0)
        return result

    over_control, over_text = all_positive(delta_to_control), all_positive(delta_to_text)
    return (
        F.when(over_control & over_text, "SMALL_WEAK_POSITIVE_TRANSFER")
        .when(over_control | over_text, "MIXED_RESULT")
        .otherwise("NO_POSITIVE_TRANSFER"))
