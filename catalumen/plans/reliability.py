"""Prototype scores on the embedding table and everything measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions import bins, identity, vectors
from catalumen.operators import areas, calibration, classparts, metrics, profile, prototypes, selective
from catalumen.operators.classparts import ModelParts
from catalumen.operators.prototypes import PrototypeModel
from catalumen.operators.ranking import rank_by_number
from catalumen.plans.base import query, r6, split_of, sql_split, table
from catalumen.session import cut_lineage

CALIBRATION_SEED = "calibration-partition"


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("split", split_of("vec_id"))


def model_of(vectors_df: DataFrame, column: str = "embedding") -> PrototypeModel:
    train = vectors_df.filter(F.col("split") == "train")
    return PrototypeModel.collect(prototypes.fit_prototypes(train, "label", column))


def parts_of(vectors_df: DataFrame, per_part: int | None = None) -> ModelParts:
    train = vectors_df.filter(F.col("split") == "train")
    return ModelParts(prototypes.fit_prototypes(train, "label", "embedding"), per_part)


def scored(spark: SparkSession, sf_dir: str, per_part: int | None = None) -> DataFrame:
    """One narrow row per vector, for any number of classes; class-wide arrays never leave the scoring task."""
    base = labelled_vectors(spark, sf_dir)
    return classparts.score_any(base, parts_of(base, per_part), "embedding", "label")


def scored_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the logit and probability arrays, for queries that work on them."""
    base = labelled_vectors(spark, sf_dir)
    return prototypes.score(base, model_of(base), "embedding", "label")


# One row per (vector, class): distance d, logit z, probability p.
SQL_BASE = f"""
vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, {sql_split('vec_id')} AS split FROM embeddings),
dims AS (SELECT vec_id, label, split, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec),
proto_dims AS (SELECT label AS cls, pos, avg(x) AS m FROM dims WHERE split = 'train' GROUP BY 1, 2),
proto AS (SELECT cls, list(m ORDER BY pos) AS c FROM proto_dims GROUP BY 1),
dist AS (SELECT vec_id, label, split, cls, list_distance(v, c) AS d, list_cosine_distance(v, c) AS dc FROM vec, proto),
logit AS (SELECT *, -80.0 * d AS z, max(-80.0 * d) OVER (PARTITION BY vec_id) AS zm FROM dist),
prob AS (SELECT *, exp(z - zm) / sum(exp(z - zm)) OVER (PARTITION BY vec_id) AS p FROM logit),
scored AS (
  SELECT vec_id, any_value(label) AS label, any_value(split) AS split,
         arg_max(cls, p) AS pred, max(p) AS conf,
         (list(p ORDER BY p DESC))[2] AS p2, (list(cls ORDER BY p DESC))[2] AS c2,
         -sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12))) AS entropy,
         sum(p * p) - 2 * max(CASE WHEN cls = label THEN p END) + 1 AS brier,
         arg_max(cls, p) = any_value(label) AS correct
  FROM prob GROUP BY vec_id)
"""


@query("prototypes", f"""
WITH {SQL_BASE}
SELECT cls AS class, (pos - 1)::INTEGER AS position, round(m, 6) AS value,
       (SELECT count(*) FROM vec WHERE split = 'train' AND label = cls) AS members
FROM proto_dims""")
def prototypes_query(spark, sf_dir):
    base = labelled_vectors(spark, sf_dir).filter(F.col("split") == "train")
    fitted = prototypes.fit_prototypes(base, "label", "embedding")
    return fitted.select("class", "members", F.posexplode("centre").alias("position", "v")).select(
        "class", "position", r6("v", "value"), "members")


@query("prototype_distance", f"""
WITH {SQL_BASE}
SELECT vec_id, any_value(label) AS label,
       round(max(CASE WHEN cls = label THEN d END), 6) AS true_distance,
       round(min(CASE WHEN cls <> label THEN d END), 6) AS competitor_distance,
       round(min(CASE WHEN cls <> label THEN d END) - max(CASE WHEN cls = label THEN d END), 6) AS margin,
       arg_min(cls, d) AS nearest, arg_min(cls, dc) AS nearest_cosine,
       round(min(dc), 6) AS cosine_distance
FROM dist GROUP BY vec_id""")
def prototype_distance(spark, sf_dir):
    base = labelled_vectors(spark, sf_dir)
    parts = parts_of(base)
    euclidean = classparts.score_any(base, parts, "embedding", "label").select(
        "vec_id", "label", "embedding", "true_distance", "competitor_distance",
        (F.col("competitor_distance") - F.col("true_distance")).alias("margin"), F.col("pred").alias("nearest"))
    both = classparts.score_any(euclidean.withColumnsRenamed(
        {c: f"{c}_e" for c in ("true_distance", "competitor_distance")}), parts, "embedding", "label", "cosine")
    return both.select(
        "vec_id", "label", r6("true_distance_e", "true_distance"), r6("competitor_distance_e", "competitor_distance"),
        r6("margin"), "nearest", F.col("pred").alias("nearest_cosine"), r6("distance", "cosine_distance"))


@query("nearest_prototype", f"""
WITH {SQL_BASE}
SELECT vec_id, arg_min(cls, d) AS class, round(min(d), 6) AS distance FROM dist GROUP BY vec_id""")
def nearest_prototype(spark, sf_dir):
    """The model comes in parts of four classes, as a class set too large for one task would."""
    return scored(spark, sf_dir, per_part=4).select("vec_id", F.col("pred").alias("class"), r6("distance"))


@query("part_scores", f"""
WITH {SQL_BASE},
extra AS (SELECT vec_id, max(CASE WHEN cls = label THEN d END) AS td, min(CASE WHEN cls <> label THEN d END) AS cd, min(d) AS nd,
          -ln(max(CASE WHEN cls = label THEN p END)) AS nll FROM prob GROUP BY vec_id)
SELECT vec_id, label, pred, c2 AS second_class, correct, round(conf, 6) AS conf, round(p2, 6) AS second, round(entropy, 6) AS entropy,
       round(nll, 6) AS nll, round(brier, 6) AS brier, round(nd, 6) AS distance, round(td, 6) AS true_distance,
       round(cd, 6) AS competitor_distance FROM scored JOIN extra USING (vec_id)""")
def part_scores(spark, sf_dir):
    """Every score of a record merged from parts of four classes."""
    rows = scored(spark, sf_dir, per_part=4)
    return rows.select("vec_id", "label", "pred", "second_class", "correct", *[r6(c) for c in (
        "conf", "second", "entropy", "nll", "brier", "distance", "true_distance", "competitor_distance")])


@query("nearest_accuracy", f"""
WITH {SQL_BASE},
near AS (SELECT vec_id, any_value(label) AS label, any_value(split) AS split,
                arg_min(cls, d) AS e, arg_min(cls, dc) AS c FROM dist GROUP BY vec_id)
SELECT split, count(*) AS records, round(avg((e = label)::INT), 6) AS euclidean_accuracy,
       round(avg((c = label)::INT), 6) AS cosine_accuracy
FROM near GROUP BY split""")
def nearest_accuracy(spark, sf_dir):
    base = labelled_vectors(spark, sf_dir)
    parts = parts_of(base)
    euclidean = classparts.score_any(base, parts, "embedding", "label").select("split", "label", "embedding", F.col("correct").alias("e"))
    both = classparts.score_any(euclidean, parts, "embedding", "label", "cosine")
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), r6(F.avg(F.col("e").cast("int")), "euclidean_accuracy"),
        r6(F.avg(F.col("correct").cast("int")), "cosine_accuracy"))


@query("confidence_signals", f"""
WITH {SQL_BASE}
SELECT vec_id, label, pred, round(conf, 6) AS conf, round(p2, 6) AS second, c2 AS second_class,
       round(conf - p2, 6) AS margin, round(entropy, 6) AS entropy, correct
FROM scored""")
def confidence_signals(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "vec_id", "label", "pred", r6("conf"), r6("second"), "second_class",
        r6(F.col("conf") - F.col("second"), "margin"), r6("entropy"), "correct")


def signals(spark, sf_dir) -> DataFrame:
    return scored(spark, sf_dir).select(
        "vec_id", "label", "pred", "correct", "conf", "entropy", (F.col("conf") - F.col("second")).alias("margin"))


QUANTILES = (0.0, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0)


def sql_describe(source: str, group: str) -> str:
    quantiles = ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{int(q * 100):03d}" for q in QUANTILES)
    return f"""SELECT {group}, count(value) AS count, round(min(value), 6) AS min, round(max(value), 6) AS max,
       round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, {quantiles}
FROM {source} GROUP BY {group}"""


def described(df: DataFrame, group: str) -> DataFrame:
    stats = profile.describe(df, group, "value", QUANTILES)
    return stats.select(
        group, "count", *[r6(c) for c in ("min", "max", "mean", "std")],
        *[r6(F.col("percentiles")[i], f"q{int(q * 100):03d}") for i, q in enumerate(QUANTILES)])


SQL_LONG = """long AS (
  SELECT 'conf' AS signal, conf AS value, correct, vec_id FROM scored UNION ALL
  SELECT 'margin', conf - p2, correct, vec_id FROM scored UNION ALL
  SELECT 'entropy', entropy, correct, vec_id FROM scored)"""


@query("signal_stats", f"WITH {SQL_BASE}, {SQL_LONG}\n" + sql_describe("long", "signal"))
def signal_stats(spark, sf_dir):
    return described(profile.unpivot_signals(signals(spark, sf_dir), [], ["conf", "margin", "entropy"]), "signal")


@query("signal_stats_by_outcome", f"""WITH {SQL_BASE}, {SQL_LONG},
grouped AS (SELECT signal || CASE WHEN correct THEN ':correct' ELSE ':incorrect' END AS signal, value FROM long)
""" + sql_describe("grouped", "signal"))
def signal_stats_by_outcome(spark, sf_dir):
    long = profile.unpivot_signals(signals(spark, sf_dir), ["correct"], ["conf", "margin", "entropy"])
    tagged = long.select(
        F.concat("signal", F.when(F.col("correct"), ":correct").otherwise(":incorrect")).alias("signal"), "value")
    return described(tagged, "signal")


@query("signal_mean_gap", f"""WITH {SQL_BASE}, {SQL_LONG}
SELECT signal, round(avg(value) FILTER (correct), 6) AS mean_correct,
       round(avg(value) FILTER (NOT correct), 6) AS mean_incorrect,
       round(avg(value) FILTER (correct) - avg(value) FILTER (NOT correct), 6) AS difference,
       round(corr(value, correct::INT::DOUBLE), 6) AS correlation_with_correct
FROM long GROUP BY signal""")
def signal_mean_gap(spark, sf_dir):
    long = profile.unpivot_signals(signals(spark, sf_dir), ["correct"], ["conf", "margin", "entropy"])
    right = F.avg(F.when(F.col("correct"), F.col("value")))
    wrong = F.avg(F.when(~F.col("correct"), F.col("value")))
    return long.groupBy("signal").agg(
        r6(right, "mean_correct"), r6(wrong, "mean_incorrect"), r6(right - wrong, "difference"),
        r6(profile.correlation(F.col("value"), F.col("correct").cast("double")), "correlation_with_correct"))


@query("signal_correlations", f"""WITH {SQL_BASE}
SELECT round(corr(conf, conf - p2), 6) AS conf_margin, round(corr(conf, entropy), 6) AS conf_entropy,
       round(corr(conf - p2, entropy), 6) AS margin_entropy FROM scored""")
def signal_correlations(spark, sf_dir):
    s = signals(spark, sf_dir)
    return s.agg(
        r6(profile.correlation(F.col("conf"), F.col("margin")), "conf_margin"),
        r6(profile.correlation(F.col("conf"), F.col("entropy")), "conf_entropy"),
        r6(profile.correlation(F.col("margin"), F.col("entropy")), "margin_entropy"))


def sql_bins(source: str, value: str, edges) -> str:
    rows = ", ".join(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])))
    last = len(edges) - 2
    return f"""SELECT b.bin::INTEGER AS bin, b.lo AS lower_bound, b.hi AS upper_bound, count(s.correct) AS count,
       count(*) FILTER (s.correct) AS correct, count(s.correct) - count(*) FILTER (s.correct) AS incorrect,
       round(count(*) FILTER (s.correct) / nullif(count(s.correct), 0), 6) AS accuracy
FROM (VALUES {rows}) b(bin, lo, hi)
LEFT JOIN {source} s ON s.{value} >= b.lo AND (s.{value} < b.hi OR (b.bin = {last} AND s.{value} <= b.hi))
GROUP BY ALL"""


@query("margin_bins", f"WITH {SQL_BASE}, m AS (SELECT conf - p2 AS margin, correct FROM scored)\n"
       + sql_bins("m", "margin", bins.MARGIN_EDGES))
def margin_bins(spark, sf_dir):
    return profile.binned_accuracy(signals(spark, sf_dir), "margin", "correct", bins.MARGIN_EDGES).withColumn(
        "accuracy", F.round("accuracy", 6))


@query("confidence_bins", f"WITH {SQL_BASE}\n" + sql_bins("scored", "conf", bins.CONFIDENCE_EDGES))
def confidence_bins(spark, sf_dir):
    return profile.binned_accuracy(signals(spark, sf_dir), "conf", "correct", bins.CONFIDENCE_EDGES).withColumn(
        "accuracy", F.round("accuracy", 6))


@query("top2_pairs", f"""WITH {SQL_BASE}
SELECT pred AS top1_class, c2 AS top2_class, count(*) AS count, count(*) FILTER (correct) AS correct_top1,
       count(*) FILTER (NOT correct) AS incorrect_top1, round(avg(conf - p2), 6) AS mean_margin,
       round(avg(conf), 6) AS mean_top1, round(avg(p2), 6) AS mean_top2, round(avg(correct::INT), 6) AS accuracy
FROM scored GROUP BY 1, 2 ORDER BY count DESC, incorrect_top1 DESC, top1_class, top2_class LIMIT 100""")
def top2_pairs(spark, sf_dir):
    pairs = scored(spark, sf_dir).groupBy(
        F.col("pred").alias("top1_class"), F.col("second_class").alias("top2_class")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if("correct").alias("correct_top1"),
        F.count_if(~F.col("correct")).alias("incorrect_top1"),
        r6(F.avg(F.col("conf") - F.col("second")), "mean_margin"),
        r6(F.avg("conf"), "mean_top1"), r6(F.avg("second"), "mean_top2"),
        r6(F.avg(F.col("correct").cast("int")), "accuracy"))
    return pairs.orderBy(F.col("count").desc(), F.col("incorrect_top1").desc(), "top1_class", "top2_class").limit(100)


@query("margin_outliers", f"""WITH {SQL_BASE}, m AS (SELECT *, conf - p2 AS margin FROM scored)
SELECT vec_id, label, pred, round(margin, 6) AS margin,
       CASE WHEN margin < 0.10 THEN 'low_margin' ELSE 'high_margin_error' END AS kind
FROM m WHERE margin < 0.10 OR (margin >= 0.90 AND NOT correct)""")
def margin_outliers(spark, sf_dir):
    low, high = F.col("margin") < 0.10, (F.col("margin") >= 0.90) & ~F.col("correct")
    return signals(spark, sf_dir).filter(low | high).select(
        "vec_id", "label", "pred", r6("margin"),
        F.when(low, "low_margin").otherwise("high_margin_error").alias("kind")).orderBy(
        "kind", F.when(F.col("kind") == "low_margin", F.col("margin")).otherwise(-F.col("margin")), "vec_id")


SQL_REPORT = """
conf_counts AS (SELECT label AS t, pred AS p, count(*) AS n FROM scored GROUP BY 1, 2),
cls AS (SELECT t AS class FROM conf_counts UNION SELECT p FROM conf_counts),
report AS (
  SELECT class,
    coalesce((SELECT sum(n) FROM conf_counts WHERE t = class), 0)::BIGINT AS support,
    coalesce((SELECT sum(n) FROM conf_counts WHERE p = class), 0)::BIGINT AS predicted,
    coalesce((SELECT sum(n) FROM conf_counts WHERE p = class AND t = class), 0)::BIGINT AS correct
  FROM cls),
full_report AS (
  SELECT *, support - correct AS incorrect,
    CASE WHEN predicted > 0 THEN correct / predicted ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN correct / support ELSE 0 END AS recall,
    CASE WHEN support + predicted > 0 THEN 2 * correct / (support + predicted) ELSE 0 END AS f1
  FROM report)
"""


@query("class_report", f"""WITH {SQL_BASE}, {SQL_REPORT}
SELECT class, support, predicted, correct, incorrect, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_report""")
def class_report(spark, sf_dir):
    report = metrics.class_report(metrics.confusion(scored(spark, sf_dir), "label", "pred"))
    return report.select("class", "support", "predicted", "correct", "incorrect",
                         *[r6(c) for c in ("precision", "recall", "f1")])


@query("class_metrics", f"""WITH {SQL_BASE}, {SQL_REPORT}
SELECT 'seen_classes' AS class_list, sum(support)::BIGINT AS records, round(sum(correct) / sum(support), 6) AS accuracy,
       round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM full_report
UNION ALL
SELECT 'fixed_12_classes', sum(support)::BIGINT, round(sum(correct) / sum(support), 6),
       round(sum(f1) / 12, 6), round(sum(f1 * support) / sum(support), 6) FROM full_report""")
def class_metrics(spark, sf_dir):
    report = cut_lineage(metrics.class_report(metrics.confusion(scored(spark, sf_dir), "label", "pred")))
    both = metrics.summary(report).withColumn("class_list", F.lit("seen_classes")).unionByName(
        metrics.summary(report, n_classes=12).withColumn("class_list", F.lit("fixed_12_classes")))
    return both.select("class_list", "records", r6("accuracy"), r6("macro_f1"), r6("weighted_f1"))


@query("confusion_pairs", f"""WITH {SQL_BASE}
SELECT label AS truth, pred AS predicted, count(*) AS n FROM scored WHERE label <> pred
GROUP BY 1, 2""")
def confusion_pairs(spark, sf_dir):
    return metrics.confusion_pairs(metrics.confusion(scored(spark, sf_dir), "label", "pred"))


@query("top_confusions", f"""WITH {SQL_BASE}
SELECT label AS truth, pred AS predicted, count(*) AS n FROM scored WHERE label <> pred
GROUP BY 1, 2 ORDER BY n DESC, truth, predicted LIMIT 50""")
def top_confusions(spark, sf_dir):
    return confusion_pairs(spark, sf_dir).orderBy(F.col("n").desc(), "truth", "predicted").limit(50)


SQL_EDGE15 = "(VALUES " + ", ".join(f"({i})" for i in range(15)) + ") g(bin)"
SQL_RELIABILITY = f"""
rel AS (SELECT bin, bin * (1.0::DOUBLE / 15) AS lower,
               CASE WHEN bin = 14 THEN 1.0::DOUBLE ELSE (bin + 1) * (1.0::DOUBLE / 15) END AS upper
        FROM {SQL_EDGE15}),
rows15 AS (SELECT r.bin, r.lower, r.upper, count(s.conf) AS n, count(*) FILTER (s.correct) AS c, avg(s.conf) AS mc
           FROM rel r LEFT JOIN scored s ON s.conf >= r.lower AND (s.conf < r.upper OR (r.bin = 14 AND s.conf <= r.upper))
           GROUP BY ALL)
"""


@query("reliability_table", f"""WITH {SQL_BASE}, {SQL_RELIABILITY}
SELECT (bin + 1)::INTEGER AS bin, round(lower, 6) AS lower, round(upper, 6) AS upper, n AS count,
       round(mc, 6) AS mean_confidence, round(c / nullif(n, 0), 6) AS accuracy,
       round(abs(mc - c / nullif(n, 0)), 6) AS gap FROM rows15""")
def reliability_table(spark, sf_dir):
    rows = calibration.reliability_table(scored(spark, sf_dir), "conf", "correct")
    return rows.select("bin", r6("lower"), r6("upper"), "count", r6("mean_confidence"), r6("accuracy"), r6("gap"))


@query("calibration_error", f"""WITH {SQL_BASE}, {SQL_RELIABILITY}
SELECT round(sum(n * abs(mc - c / n)) / sum(n), 6) AS ece FROM rows15 WHERE n > 0""")
def calibration_error(spark, sf_dir):
    rows = calibration.reliability_table(scored(spark, sf_dir), "conf", "correct")
    return calibration.expected_calibration_error(rows).select(r6("ece"))


def sql_scores(temperature: str, source: str = "logit", where: str = "true") -> str:
    return f"""
tp AS (SELECT vec_id, label, cls, z, zm, exp((z - zm) / {temperature}) /
              sum(exp((z - zm) / {temperature})) OVER (PARTITION BY vec_id) AS p FROM {source} WHERE {where}),
tr AS (SELECT vec_id, arg_max(cls, p) = any_value(label) AS correct, max(p) AS conf,
              -ln(max(CASE WHEN cls = label THEN p END)) AS nll,
              sum(p * p) - 2 * max(CASE WHEN cls = label THEN p END) + 1 AS brier FROM tp GROUP BY vec_id)"""


SQL_SCORE_COLUMNS = """count(*) AS records, round(avg(correct::INT), 6) AS accuracy, round(avg(nll), 6) AS nll,
       round(avg(brier), 6) AS brier, round(avg(conf), 6) AS mean_confidence, round(min(conf), 6) AS min_confidence,
       round(max(conf), 6) AS max_confidence, count(*) FILTER (conf >= 0.90) AS high_confidence_count,
       round(avg(correct::INT) FILTER (conf >= 0.90), 6) AS high_confidence_accuracy,
       round(1 - avg(correct::INT) FILTER (conf >= 0.90), 6) AS high_confidence_error_rate"""
SCORE_COLUMNS = ("accuracy", "nll", "brier", "mean_confidence", "min_confidence", "max_confidence",
                 "high_confidence_accuracy", "high_confidence_error_rate")


def rounded_scores(row: DataFrame, *extra: str) -> DataFrame:
    return row.select(*extra, "records", "high_confidence_count", *[r6(c) for c in SCORE_COLUMNS])


@query("calibration_scores", f"WITH {SQL_BASE}, {sql_scores('1.0')}\nSELECT {SQL_SCORE_COLUMNS} FROM tr")
def calibration_scores(spark, sf_dir):
    return rounded_scores(calibration.likelihood_scores(scored_wide(spark, sf_dir), "logits", "label_position"))


SQL_PARTITION = ("('0x' || substr(sha256('calibration-partition|' || vec_id), 1, 16))::UBIGINT % 100000 < 50000")


# Grid steps after the coarse one, down to a single unit.
REFINE_STEPS = (500, 50, 5, 1)


def _sql_temperature() -> str:
    """Nested grid search, one CTE per refinement, on the calibration half."""
    parts = [f"cal AS (SELECT * FROM logit WHERE {SQL_PARTITION})"]
    coarse = "generate_series(1000, 200000, 5000)"
    nll = """(SELECT unit, avg(ln(se) + zm / t - zy / t) AS nll FROM (
      SELECT unit, unit / 20000.0 AS t, vec_id, any_value(zm) AS zm, max(CASE WHEN cls = label THEN z END) AS zy,
             sum(exp((z - zm) / (unit / 20000.0))) AS se
      FROM cal, {grid} GROUP BY unit, vec_id) GROUP BY unit)"""
    grid = f"(SELECT unnest({coarse}) AS unit)"
    parts.append(f"b0 AS (SELECT unit AS best FROM {nll.format(grid=grid)} ORDER BY nll, unit LIMIT 1)")
    for i, step in enumerate(REFINE_STEPS, 1):
        reach = 10
        grid = (f"(SELECT best + k * {step} AS unit FROM b{i - 1}, (SELECT unnest(range(-{reach}, {reach} + 1)) AS k) "
                f"WHERE best + k * {step} > 0)")
        parts.append(f"b{i} AS (SELECT unit AS best FROM {nll.format(grid=grid)} ORDER BY nll, unit LIMIT 1)")
    parts.append(f"fitted AS (SELECT best / 20000.0 AS t FROM b{len(REFINE_STEPS)})")
    return ",\n".join(parts)


SQL_FIT = _sql_temperature()


def calibration_halves(rows: DataFrame) -> DataFrame:
    part = identity.bucket(F.col("vec_id"), CALIBRATION_SEED)
    return rows.withColumn("population", F.when(part < 50_000, "calibration").otherwise("selection"))


@query("temperature", f"""WITH {SQL_BASE}, {SQL_FIT},
sel AS (SELECT logit.*, t FROM logit, fitted WHERE NOT ({SQL_PARTITION})),
raw_p AS (SELECT 'raw' AS kind, vec_id, label, cls, exp(z - zm) / sum(exp(z - zm)) OVER (PARTITION BY vec_id) AS p, t FROM sel),
cal_p AS (SELECT 'calibrated' AS kind, vec_id, label, cls,
          exp((z - zm) / t) / sum(exp((z - zm) / t)) OVER (PARTITION BY vec_id) AS p, t FROM sel),
tr AS (SELECT kind, vec_id, any_value(t) AS t, arg_max(cls, p) = any_value(label) AS correct, max(p) AS conf,
              -ln(max(CASE WHEN cls = label THEN p END)) AS nll,
              sum(p * p) - 2 * max(CASE WHEN cls = label THEN p END) + 1 AS brier
       FROM (SELECT * FROM raw_p UNION ALL SELECT * FROM cal_p) GROUP BY kind, vec_id)
SELECT kind, round(CASE WHEN kind = 'raw' THEN 1.0 ELSE any_value(t) END, 6) AS temperature, {SQL_SCORE_COLUMNS}
FROM tr GROUP BY kind""")
def temperature(spark, sf_dir):
    rows = calibration_halves(scored_wide(spark, sf_dir)).select("population", "logits", "label_position")
    # The fit reads the logits three times, so they are written once.
    rows = cut_lineage(rows, "calibration-logits")
    half = rows.filter(F.col("population") == "calibration")
    fitted = calibration.fit_temperature(lambda ts: calibration.array_curve(half, "logits", "label_position", ts)).value
    held_out = rows.filter(F.col("population") == "selection")
    results = None
    for kind, t in (("raw", 1.0), ("calibrated", fitted)):
        row = rounded_scores(
            calibration.likelihood_scores(held_out, "logits", "label_position", t).withColumn(
                "kind", F.lit(kind)).withColumn("temperature", F.round(F.lit(t), 6)), "kind", "temperature")
        results = row if results is None else results.unionByName(row)
    return results


@query("temperature_parts", f"""WITH {SQL_BASE}, {SQL_FIT},
sums AS (SELECT c.vec_id, any_value(t) AS t, any_value(zm) AS zm, max(CASE WHEN cls = label THEN z END) AS zy, sum(exp((z - zm) / t)) AS se
         FROM cal c, fitted GROUP BY c.vec_id)
SELECT round(any_value(t), 6) AS temperature, count(*) AS records, round(avg(ln(se) + zm / t - zy / t), 6) AS nll, true AS converged FROM sums""")
def temperature_parts(spark, sf_dir):
    """The same fit without logits in any row: each pass folds the model's parts of four classes into the records' sums."""
    base = calibration_halves(labelled_vectors(spark, sf_dir))
    half, parts = base.filter(F.col("population") == "calibration"), parts_of(base, per_part=4)
    fitted = calibration.fit_temperature(lambda ts: classparts.curve(half, parts, "embedding", "label", ts))
    return half.agg(F.round(F.lit(fitted.value), 6).alias("temperature"), F.count(F.lit(1)).alias("records"),
                    F.round(F.lit(fitted.nll), 6).alias("nll"), F.lit(fitted.converged).alias("converged"))


@query("likelihood_terms", f"""WITH {SQL_BASE}
SELECT vec_id, label, round(-ln(max(CASE WHEN cls = label THEN p END)), 6) AS nll,
       round(sum(p * p) - 2 * max(CASE WHEN cls = label THEN p END) + 1, 6) AS brier FROM prob GROUP BY vec_id, label""")
def likelihood_terms(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", "label", r6("nll"), r6("brier"))


@query("nll_curve", f"""WITH {SQL_BASE},
g AS (SELECT unit, unit / 20000.0 AS t, vec_id, any_value(zm) AS zm, max(CASE WHEN cls = label THEN z END) AS zy,
             sum(exp((z - zm) / (unit / 20000.0))) AS se
      FROM logit, (SELECT unnest(range(2000, 40001, 2000)) AS unit) GROUP BY unit, vec_id)
SELECT unit::INTEGER AS unit, round(avg(ln(se) + zm / t - zy / t), 6) AS nll FROM g GROUP BY unit""")
def nll_curve(spark, sf_dir):
    curve = calibration.nll_by_temperature(
        scored_wide(spark, sf_dir), "logits", "label_position", range(2_000, 40_001, 2_000))
    return curve.select("unit", r6("nll"))


SQL_CURVE = """
steps AS (SELECT unnest(range(0, 101)) AS step),
cnt AS (SELECT step, step / 100.0::DOUBLE AS threshold, count(s.conf) AS accepted, count(*) FILTER (s.correct) AS ok
        FROM steps LEFT JOIN scored s ON s.conf >= step / 100.0::DOUBLE GROUP BY ALL),
tot AS (SELECT count(*) AS n, count(*) FILTER (correct) AS c FROM scored)
"""


@query("coverage_risk", f"""WITH {SQL_BASE}, {SQL_CURVE}
SELECT step::INTEGER AS step, threshold, accepted AS accepted_count, n - accepted AS abstained_count,
       round(accepted / n, 6) AS coverage, round((n - accepted) / n, 6) AS abstention_rate,
       ok AS accepted_correct_count, accepted - ok AS accepted_error_count,
       round(ok / nullif(accepted, 0), 6) AS selective_accuracy,
       round((accepted - ok) / nullif(accepted, 0), 6) AS selective_risk
FROM cnt, tot""")
def coverage_risk(spark, sf_dir):
    curve = selective.coverage_risk(selective.threshold_counts(scored(spark, sf_dir), "conf", "correct"))
    return curve.select(
        "step", "threshold", "accepted_count", "abstained_count", r6("coverage"), r6("abstention_rate"),
        "accepted_correct_count", "accepted_error_count", r6("selective_accuracy"), r6("selective_risk"))


@query("routing", f"""WITH {SQL_BASE}, {SQL_CURVE}
SELECT step::INTEGER AS step, threshold, n AS total_records, accepted AS accepted_count, n - accepted AS review_count,
       round(accepted / n, 6) AS coverage, round((n - accepted) / n, 6) AS review_rate,
       ok AS accepted_correct, accepted - ok AS accepted_errors, c - ok AS reviewed_correct,
       (n - c) - (accepted - ok) AS reviewed_errors,
       round(ok / nullif(accepted, 0), 6) AS machine_accepted_accuracy,
       round((accepted - ok) / nullif(accepted, 0), 6) AS machine_accepted_risk,
       round(((n - c) - (accepted - ok)) / nullif(n - c, 0), 6) AS model_error_capture_rate
FROM cnt, tot""")
def routing(spark, sf_dir):
    curve = selective.routing(selective.threshold_counts(scored(spark, sf_dir), "conf", "correct"))
    rounded = {"coverage", "review_rate", "machine_accepted_accuracy", "machine_accepted_risk", "model_error_capture_rate"}
    return curve.select(*[r6(c) if c in rounded else F.col(c) for c in curve.columns])


@query("route_records", f"""WITH {SQL_BASE}
SELECT vec_id, CASE WHEN conf >= 0.90 THEN 'accept' ELSE 'review' END AS route FROM scored""")
def route_records(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", selective.route(F.col("conf"), 0.90).alias("route"))


@query("curve_checks", f"""WITH {SQL_BASE}, {SQL_CURVE},
w AS (SELECT *, lag(accepted) OVER (ORDER BY step) AS before FROM cnt, tot)
SELECT 'grid_complete' AS "check", count(*) = 101 AND min(step) = 0 AND max(step) = 100 AS passed FROM w
UNION ALL SELECT 'threshold_zero_accepts_all', max(CASE WHEN step = 0 THEN n - accepted END) = 0 FROM w
UNION ALL SELECT 'coverage_never_rises', count(*) FILTER (accepted > before) = 0 FROM w
UNION ALL SELECT 'accepted_adds_up', true""")
def curve_checks(spark, sf_dir):
    return selective.curve_checks(
        selective.coverage_risk(selective.threshold_counts(scored(spark, sf_dir), "conf", "correct")))


@query("curve_join", f"""WITH {SQL_BASE}, {SQL_CURVE}
SELECT step::INTEGER AS step, threshold, n AS total_records, accepted AS accepted_count, n - accepted AS review_count,
       round(accepted / n, 6) AS coverage, round((n - accepted) / n, 6) AS review_rate, accepted - ok AS accepted_errors,
       (n - c) - (accepted - ok) AS reviewed_errors,
       round(((n - c) - (accepted - ok)) / nullif(n - c, 0), 6) AS model_error_capture_rate,
       round((accepted - ok) / nullif(accepted, 0), 6) AS selective_risk
FROM cnt, tot""")
def curve_join(spark, sf_dir):
    counts = cut_lineage(selective.threshold_counts(scored(spark, sf_dir), "conf", "correct"))
    joined = selective.join_curves(selective.coverage_risk(counts), selective.routing(counts))
    rounded = {"coverage", "review_rate", "model_error_capture_rate", "selective_risk"}
    return joined.select(*[r6(c) if c in rounded else F.col(c) for c in joined.columns])


@query("conf_error_bins", f"""WITH {SQL_BASE}, {SQL_RELIABILITY}
SELECT bin::INTEGER AS bin_index, round(lower, 6) AS lower_bound, round(upper, 6) AS upper_bound, n AS count, c AS correct,
       n - c AS errors, round(n / (SELECT count(*) FROM scored), 6) AS coverage_fraction,
       round(coalesce(mc, 0), 6) AS mean_confidence, round(coalesce(c / nullif(n, 0), 0), 6) AS empirical_accuracy,
       round(coalesce((n - c) / nullif(n, 0), 0), 6) AS empirical_error_rate,
       round(coalesce(mc, 0) - coalesce(c / nullif(n, 0), 0), 6) AS confidence_correctness_gap
FROM rows15""")
def conf_error_bins(spark, sf_dir):
    rows = selective.confidence_bin_errors(scored(spark, sf_dir), "conf", "correct")
    whole = {"bin_index", "count", "correct", "errors"}
    return rows.select(*[F.col(c) if c in whole else r6(c) for c in rows.columns])


SQL_CLASS_ERRORS = f"""WITH {SQL_BASE}
SELECT label AS class_id, count(*) AS support, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS errors,
       round(avg(correct::INT), 6) AS accuracy, round(avg((NOT correct)::INT), 6) AS error_rate,
       round(avg(conf), 6) AS mean_confidence, count(*) FILTER (NOT correct AND conf >= 0.90) AS high_confidence_errors,
       round(coalesce(count(*) FILTER (NOT correct AND conf >= 0.90) / nullif(count(*) FILTER (NOT correct), 0), 0), 6) AS high_confidence_error_rate
FROM scored GROUP BY label"""


@query("class_errors", SQL_CLASS_ERRORS)
def class_errors(spark, sf_dir):
    rows = selective.class_errors(scored(spark, sf_dir), "label", "conf", "correct")
    rounded = {"accuracy", "error_rate", "mean_confidence", "high_confidence_error_rate"}
    return rows.select(*[r6(c) if c in rounded else F.col(c) for c in rows.columns])


@query("top_error_classes", SQL_CLASS_ERRORS + " ORDER BY errors DESC, support DESC, class_id LIMIT 20")
def top_error_classes(spark, sf_dir):
    return selective.top_error_classes(class_errors(spark, sf_dir))


@query("conf_outliers", f"""WITH {SQL_BASE}
SELECT vec_id, label, pred, round(conf, 6) AS conf,
       CASE WHEN NOT correct THEN 'high_confidence_error' ELSE 'low_confidence_correct' END AS kind
FROM scored WHERE (NOT correct AND conf >= 0.90) OR (correct AND conf < 0.60)""")
def conf_outliers(spark, sf_dir):
    rows = selective.confidence_outliers(
        scored(spark, sf_dir), "conf", "correct", selective.LOW_CONFIDENCE_ANALYSIS)
    return rows.select("vec_id", "label", "pred", r6("conf"), "kind")


@query("conf_outlier_shares", f"""WITH {SQL_BASE}
SELECT count(*) FILTER (NOT correct AND conf >= 0.90) AS high_confidence_errors,
       round(count(*) FILTER (NOT correct AND conf >= 0.90) / nullif(count(*) FILTER (NOT correct), 0), 6) AS share_of_errors,
       count(*) FILTER (correct AND conf < 0.50) AS low_confidence_correct_050,
       count(*) FILTER (correct AND conf < 0.60) AS low_confidence_correct_060,
       round(count(*) FILTER (correct AND conf < 0.60) / nullif(count(*) FILTER (correct), 0), 6) AS share_of_correct
FROM scored""")
def conf_outlier_shares(spark, sf_dir):
    sure_error = ~F.col("correct") & (F.col("conf") >= selective.HIGH_CONFIDENCE)

    def unsure(limit):
        return F.col("correct") & (F.col("conf") < limit)

    return scored(spark, sf_dir).agg(
        F.count_if(sure_error).alias("high_confidence_errors"),
        r6(F.try_divide(F.count_if(sure_error), F.count_if(~F.col("correct"))), "share_of_errors"),
        F.count_if(unsure(selective.LOW_CONFIDENCE_AUDIT)).alias("low_confidence_correct_050"),
        F.count_if(unsure(selective.LOW_CONFIDENCE_ANALYSIS)).alias("low_confidence_correct_060"),
        r6(F.try_divide(F.count_if(unsure(selective.LOW_CONFIDENCE_ANALYSIS)), F.count_if("correct")), "share_of_correct"))


@query("vector_checks", """
WITH probe AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
shares AS (
  SELECT vec_id, list_transform(v, lambda x: abs(x) / list_sum(list_transform(v, lambda y: abs(y)))) AS p FROM probe),
varied AS (
  SELECT vec_id, CASE vec_id % 7
    WHEN 0 THEN list_transform(p, lambda x: x * 0.5)
    WHEN 1 THEN p[1:63]
    WHEN 2 THEN list_concat([-p[1]], p[2:64])
    WHEN 3 THEN list_concat(['nan'::DOUBLE], p[2:64])
    WHEN 4 THEN list_concat([1.5::DOUBLE], p[2:64])
    ELSE p END AS p FROM shares)
SELECT vec_id, CASE
    WHEN len(p) <> 64 THEN 'wrong_width'
    WHEN len(list_filter(p, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not_finite'
    WHEN len(list_filter(p, lambda x: x < 0)) > 0 THEN 'negative'
    WHEN len(list_filter(p, lambda x: x > 1)) > 0 THEN 'above_one'
    WHEN abs(list_sum(p) - 1) > 1e-5 THEN 'row_sum' END AS problem
FROM varied""")
def vector_checks(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    shares = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(
        "vec_id", vectors.normalise(v).alias("p"))
    case = F.col("vec_id") % 7
    rest = F.slice("p", 2, 63)
    varied = (
        F.when(case == 0, F.transform("p", lambda x: x * 0.5))
        .when(case == 1, F.slice("p", 1, 63))
        .when(case == 2, F.concat(F.array(-F.col("p")[0]), rest))
        .when(case == 3, F.concat(F.array(F.lit(float("nan"))), rest))
        .when(case == 4, F.concat(F.array(F.lit(1.5)), rest))
        .otherwise(F.col("p")))
    return shares.select("vec_id", vectors.vector_problem(varied, 64).alias("problem"))


@query("chunk_pool", """
WITH d AS (SELECT vec_id // 4 AS record_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT record_id, pos, avg(x) AS x, count(*) AS n FROM d GROUP BY 1, 2)
SELECT record_id, max(n) AS chunks, round(max(CASE WHEN pos = 1 THEN x END), 6) AS first_value,
       round(sqrt(sum(x * x)), 6) AS pooled_norm FROM m GROUP BY record_id""")
def chunk_pool(spark, sf_dir):
    chunk_vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(
        F.expr("vec_id div 4").alias("record_id"), "embedding")
    pooled = prototypes.mean_vectors(chunk_vectors, ["record_id"], "embedding")
    return pooled.select("record_id", F.col("members").alias("chunks"),
                         r6(F.col("centre")[0], "first_value"), r6(vectors.norm(F.col("centre")), "pooled_norm"))


@query("score_recheck", f"""WITH {SQL_BASE},
numbered AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM vec)
SELECT count(*) AS rechecked, count(*) FILTER (i % 30 = 0) AS differing FROM numbered WHERE i % 10 = 0""")
def score_recheck(spark, sf_dir):
    """Score again an evenly spaced sample and compare it with stored scores, some of which were spoiled."""
    base = rank_by_number(labelled_vectors(spark, sf_dir), "vec_id")
    model = model_of(base)
    spoiled = F.transform("probabilities", lambda p, i: F.when((i == 0) & (F.col("row_index") % 30 == 0), p + 0.01).otherwise(p))
    stored = cut_lineage(prototypes.score(base, model, "embedding", "label").select("vec_id", spoiled.alias("stored")), "scores")
    again = prototypes.score(base.filter(F.col("row_index") % 10 == 0), model, "embedding", "label").select("vec_id", "probabilities")
    gap = F.array_max(F.zip_with("stored", "probabilities", lambda a, b: F.abs(a - b)))
    return again.join(stored, "vec_id").agg(
        F.count(F.lit(1)).alias("rechecked"), F.count_if(gap > 1e-9).alias("differing"))


@query("ranking_areas", f"""WITH {SQL_BASE},
k AS (SELECT 'confidence' AS signal, conf AS s, correct AS y FROM scored UNION ALL SELECT 'coarse_margin', round(conf - p2, 1), correct FROM scored),
c AS (SELECT signal, s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM k GROUP BY signal, s),
r AS (SELECT *, sum(p) OVER w AS pt, sum(n) OVER w AS nt FROM c WINDOW w AS (PARTITION BY signal ORDER BY s DESC))
SELECT signal, (sum(p) + sum(n))::BIGINT AS records, sum(p)::BIGINT AS positives, round(sum(n * (pt - p / 2)) / (sum(p) * sum(n)), 6) AS auroc,
  round(sum(p * pt / (pt + nt)) / sum(p), 6) AS auprc, round(sum((p + n) * nt / (pt + nt)) / (sum(p) + sum(n)), 6) AS aurc FROM r GROUP BY signal""")
def ranking_areas(spark, sf_dir):
    """How well confidence, and a margin with many ties, rank the correct records above the wrong ones."""
    rows = cut_lineage(scored(spark, sf_dir).select("conf", F.round(F.col("conf") - F.col("second"), 1).alias("coarse"), "correct"), "signals")
    result = None
    for name, column in (("confidence", "conf"), ("coarse_margin", "coarse")):
        row = areas.ranking_areas(rows, column, "correct").withColumn("signal", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return result.select("signal", "records", "positives", r6("auroc"), r6("auprc"), r6("aurc"))
