"""Counters, stage comparison, tracing, funnels and check tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.functions.jsontext import object_keys
from catalumen.operators.joins import broadcast_if_small, lookup
from catalumen.operators.ranking import rank_by_order


def counters(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """``(counter, value)``: the row count and every conditional count in one pass."""
    names = ["records", *conditions]
    one = df.agg(F.count(F.lit(1)).alias("records"), *[
        F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("counter"), F.col(k).alias("value")) for k in names])).alias("c")).select("c.*")


def check_table(observed: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """``(check, observed, expected, passed)`` for counters with a required value."""
    wanted = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return observed.filter(F.col("counter").isin(list(expected))).select(
        F.col("counter").alias("check"), F.col("value").alias("observed"),
        F.try_element_at(wanted, F.col("counter")).alias("expected"),
        (F.col("value") == F.try_element_at(wanted, F.col("counter"))).alias("passed"))


def overall_verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"),
        F.every("passed").alias("passed"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first per key, and keys that repeat: two different counts.

    Nulls form one key, as they do in grouping.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.sum("n").alias("records"),
        F.sum(F.col("n") - 1).alias("duplicate_occurrences"),
        F.count_if(F.col("n") > 1).alias("duplicated_keys"))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def most_common(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; equal counts in key order."""
    return histogram(df, key).orderBy(F.col("n").desc(), key).limit(k)


def field_presence(df: DataFrame, raw: str) -> DataFrame:
    """How many JSON objects carry each top-level key."""
    return df.select(F.explode(object_keys(F.col(raw))).alias("field")).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"))


def stage_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key: ``status`` (equal, changed, missing, extra, repeated) and the names of changed columns.

    Null and absent compare as equal to themselves and different from any value.
    A key that a side has more than once is ``repeated`` and gives one row, however
    often it occurs; a null key is a key like any other. Both sides are
    grouped together, so each record moves once and copies of a key meet map-side.
    """
    record = F.struct(*[F.col(c) for c in columns])
    a = before.select(F.col(key).alias("__key"), record.alias("__a"))
    b = after.select(F.col(key).alias("__key"), record.alias("__b"))
    sides = a.unionByName(b, allowMissingColumns=True).groupBy("__key").agg(
        F.count("__a").alias("__na"), F.count("__b").alias("__nb"),
        F.first("__a", ignorenulls=True).alias("__a"), F.first("__b", ignorenulls=True).alias("__b"))
    changed = F.array_compact(F.array(*[
        F.when(~F.col("__a")[c].eqNullSafe(F.col("__b")[c]), F.lit(c)) for c in columns]))
    status = (F.when((F.col("__na") > 1) | (F.col("__nb") > 1), "repeated").when(F.col("__nb") == 0, "missing")
              .when(F.col("__na") == 0, "extra").when(F.size(changed) > 0, "changed").otherwise("equal"))
    return sides.select(
        F.col("__key").alias(key), status.alias("status"),
        F.when((F.col("__na") == 1) & (F.col("__nb") == 1), changed).alias("changed_columns"))


def metric_drift(stored: DataFrame, recomputed: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``(metric, stored, recomputed, passed)``, also for metrics only one side has."""
    a = stored.select("metric", F.col("value").cast("double").alias("stored"))
    b = recomputed.select("metric", F.col("value").cast("double").alias("recomputed"))
    close = F.abs(F.col("stored") - F.col("recomputed")) <= F.lit(tolerance)
    return a.join(b, "metric", "full_outer").withColumn(
        "passed", F.coalesce(close, F.col("stored").isNull() & F.col("recomputed").isNull()))


def funnel(df: DataFrame, reasons: Mapping[str, Column], by: list[str], accepted: str = "eligible") -> DataFrame:
    """Records per first failing reason (in the given order) with their share of the group."""
    stage = None
    for name, condition in reasons.items():
        failed = F.coalesce(condition, F.lit(False))
        stage = F.when(failed, name) if stage is None else stage.when(failed, name)
    counted = df.groupBy(*by, stage.otherwise(accepted).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    # Few rows by now: one per group and reason.
    totals = counted.groupBy(*by).agg(F.sum("n").alias("__total"))
    return counted.join(totals, by).select(
        *by, "reason", "n", (F.col("n") * 100.0 / F.col("__total")).alias("percent"))


def trace(targets: DataFrame, key: str, stages: Mapping[str, DataFrame]) -> DataFrame:
    """Targets joined to what each earlier stage holds for the same key.

    ``stages`` maps a name to a frame ``(key, ...)``; its columns arrive as
    ``<name>_<column>`` plus ``in_<name>``. Each stage is first cut down to the
    wanted keys, so the big side is filtered before it is shuffled for the join.
    """
    wanted = broadcast_if_small(targets.select(key).distinct())
    result = targets
    for name, stage in stages.items():
        reduced = stage.join(wanted, key, "left_semi").select(
            key, F.lit(True).alias(f"in_{name}"),
            *[F.col(c).alias(f"{name}_{c}") for c in stage.columns if c != key])
        result = result.join(reduced, key, "left").withColumn(
            f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    return result


def trace_class(
    in_canonical: Column, in_processed: Column, same_split: Column, expected_source: Column,
    canonical_text: Column, processed_text: Column, usable_text: Column,
    fallback: str = "LABEL_NOT_FROM_EXPECTED_FALLBACK_SOURCE",
    no_text: str = "LABEL_WITHOUT_CANONICAL_APPROVED_TEXT",
) -> Column:
    """Where on its way a labelled record lost its input."""
    return (
        F.when(~in_canonical, "MISSING_FROM_CANONICAL")
        .when(~in_processed, "MISSING_FROM_B2")
        .when(~same_split, "SPLIT_MISMATCH")
        .when(~expected_source, fallback)
        .when(~canonical_text, no_text)
        .when(~processed_text, "INPUT_LOST_OR_ABSENT_AT_B2")
        .when(~usable_text, "INPUT_LOST_AT_B3")
        .otherwise("LABEL_AND_INPUT_ALIGNED"))


def text_loss_class(in_canonical: Column, in_processed: Column, canonical_text: Column, processed_text: Column) -> Column:
    return (
        F.when(~in_canonical, "MISSING_CANONICAL_RECORD")
        .when(~in_processed, "MISSING_B2_RECORD")
        .when(~canonical_text & ~processed_text, "SOURCE_AND_B2_NO_APPROVED_TEXT")
        .when(canonical_text & ~processed_text, "TEXT_LOST_DURING_B2_PROCESSING")
        .when(~canonical_text & processed_text, "B2_TEXT_NOT_PRESENT_CANONICALLY")
        .otherwise("TEXT_AVAILABLE_FOR_FURTHER_INTERFACE_REVIEW"))


def target_status(candidates: Column, with_text: Column, categories: Column, attributes: Column) -> Column:
    """Whether one training target follows from the totals."""
    return (
        F.when(candidates == 0, "BLOCKED_NO_EXPLICIT_SUPERVISION")
        .when(with_text == 0, "BLOCKED_NO_USABLE_B3_INPUT")
        .when((categories > 0) & (attributes > 0), "BLOCKED_TARGET_AMBIGUITY")
        .otherwise("ELIGIBLE_FOR_TARGET_CONFIRMATION"))


def availability_matrix(df: DataFrame, flags: list[str]) -> DataFrame:
    """Flag counts per dataset and split, with totals per dataset and overall (null keys)."""
    return df.rollup("dataset", "split").agg(
        F.count(F.lit(1)).alias("records"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def class_universe(df: DataFrame, label: str, split: str, splits: tuple[str, ...]) -> DataFrame:
    """Per class: records in each split, total, and whether training never saw it."""
    counts = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(split) == s).alias(f"{s}_count") for s in splits])
    return counts.withColumn("unseen_in_train", F.col(f"{splits[0]}_count") == 0)


def admissibility(
    candidates: DataFrame, train_count: Column, overlaps: list[Column], test_overlap: Column,
    downstream_clear: Column, sealed_test_absent: Column,
) -> DataFrame:
    """PASS/FAIL columns per unseen-class candidate and the resulting decision."""
    unseen = train_count == 0

    def verdict(condition: Column) -> Column:
        return F.when(condition, "PASS").otherwise("FAIL")

    clean = test_overlap == 0
    for overlap in overlaps:
        clean = clean & (overlap == 0)
    downstream = F.when(~unseen, "FAIL").when(downstream_clear, "PASS").otherwise("NOT_ESTABLISHED")
    decided = candidates.select(
        "*",
        verdict(unseen).alias("training_exclusion"),
        F.when(~unseen, "FAIL").otherwise(verdict(clean)).alias("model_selection_exclusion"),
        downstream.alias("downstream_exclusion"),
        verdict(test_overlap == 0).alias("test_isolation"))
    return decided.withColumn(
        "admissibility",
        F.when(~unseen, "INADMISSIBLE")
        .when((F.col("model_selection_exclusion") == "PASS") & (F.col("downstream_exclusion") == "PASS")
              & (F.col("test_isolation") == "PASS") & sealed_test_absent, "ADMISSIBLE")
        .otherwise("NOT_ESTABLISHED"))


def class_table(train: DataFrame, label: str) -> DataFrame:
    """``(class_id, label)``: class id is the 0-based rank of the sorted training label, counted range by range."""
    seen = train.select(F.col(label).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return rank_by_order(seen, "label", "class_id").select("label", F.col("class_id").cast("int").alias("class_id"))


def encode_labels(records: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """Add ``class_id`` (null when unseen) and the ``known`` mask."""
    found = lookup(records, classes.withColumnRenamed("label", label), [label])
    return found.withColumn("known", F.col("class_id").isNotNull())
