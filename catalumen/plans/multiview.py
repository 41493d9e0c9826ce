"""Two views of one vector: fusion, agreement, ablation and transfer.

Dimensions 1-32 play the text view, 33-64 the image view. The image model is
fitted without class 9, so the two models have different class lists and only
the common ones can be fused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions import bins, vectors
from catalumen.operators import fusion, metrics, profile, prototypes, ranking
from catalumen.operators.prototypes import PrototypeModel
from catalumen.plans.base import query, r6, sql_split
from catalumen.plans.reliability import SQL_BASE, labelled_vectors, model_of, sql_bins
from catalumen.session import cut_lineage

HALF = 32
CLASS_WITHOUT_IMAGES = 9
PERMUTATION_SEED = "transfer-permutation"


def two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_vectors(spark, sf_dir).select(
        "vec_id", "label", "split",
        F.slice("embedding", 1, HALF).alias("text"), F.slice("embedding", HALF + 1, HALF).alias("image"))


def fused_base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Common-class records with both probability vectors, and the number of common classes."""
    views = two_views(spark, sf_dir)
    text_model = model_of(views, "text")
    image_model = model_of(views.filter(F.col("label") != CLASS_WITHOUT_IMAGES), "image")
    common = [c for c in text_model.classes if c in image_model.classes]

    def probabilities(model: PrototypeModel, distances: str):
        return vectors.let(
            vectors.softmax(prototypes.logits(F.col(distances))),
            lambda full: vectors.project_classes(full, [model.classes.index(c) for c in common]))

    # Distances come from an Arrow function, which may not sit inside a lambda.
    measured = views.filter(F.col("label").isin(common)).select(
        "vec_id", "split", "label",
        text_model.distances(F.col("text")).alias("d_text"),
        image_model.distances(F.col("image")).alias("d_image"))
    label_position = F.array_position(F.array(*[F.lit(c) for c in common]), F.col("label"))
    rows = measured.select(
        "vec_id", "split", (label_position - 1).cast("int").alias("truth"),
        probabilities(text_model, "d_text").alias("p_text"),
        probabilities(image_model, "d_image").alias("p_image"))
    return rows, len(common)


def _sql_view(name: str, cut: str, keep: str) -> str:
    return f"""
{name}_v AS (SELECT vec_id, label, {sql_split('vec_id')} AS split, (embedding[{cut}])::DOUBLE[] AS v FROM embeddings),
{name}_dims AS (SELECT label AS cls, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {name}_v WHERE split = 'train' AND {keep}),
{name}_proto AS (SELECT cls, list(m ORDER BY pos) AS c FROM (SELECT cls, pos, avg(x) AS m FROM {name}_dims GROUP BY 1, 2) GROUP BY 1),
{name}_dist AS (SELECT vec_id, label, split, cls, list_distance(v, c) AS d FROM {name}_v, {name}_proto),
{name}_z AS (SELECT *, -80.0 * d AS z, max(-80.0 * d) OVER (PARTITION BY vec_id) AS zm FROM {name}_dist
             WHERE cls <> {CLASS_WITHOUT_IMAGES} AND label <> {CLASS_WITHOUT_IMAGES}),
{name}_p AS (SELECT vec_id, label, split, cls, exp(z - zm) / sum(exp(z - zm)) OVER (PARTITION BY vec_id) AS p FROM {name}_z)"""


SQL_VIEWS = f"""{_sql_view('text', '1:32', 'true')},
{_sql_view('image', '33:64', f'label <> {CLASS_WITHOUT_IMAGES}')},
pair AS (SELECT t.vec_id, t.label, t.split, t.cls, t.p AS pt, i.p AS pi FROM text_p t JOIN image_p i USING (vec_id, cls)),
grid AS (SELECT unnest(range(0, 11)) AS step),
fused AS (SELECT step, vec_id, any_value(label) AS label, any_value(split) AS split,
                 arg_max(cls, (step / 10.0::DOUBLE) * pt + (1.0::DOUBLE - step / 10.0::DOUBLE) * pi) AS pred
          FROM pair, grid GROUP BY step, vec_id)"""


def sql_metrics(source: str, by: str, n_classes: str, name: str) -> str:
    """CTEs ending in ``name``: metrics of (label, pred) rows per group."""
    return f"""
{name}_n AS (SELECT {by}, label AS t, pred AS q, count(*) AS n FROM {source} GROUP BY ALL),
{name}_s AS (SELECT {by}, t AS k, n AS sup, 0 AS prd, CASE WHEN t = q THEN n ELSE 0 END AS hit FROM {name}_n
             UNION ALL SELECT {by}, q, 0, n, 0 FROM {name}_n),
{name}_c AS (SELECT {by}, k, sum(sup) AS sup, sum(prd) AS prd, sum(hit) AS hit,
                    CASE WHEN sum(sup) + sum(prd) > 0 THEN 2 * sum(hit) / (sum(sup) + sum(prd)) ELSE 0 END AS f1
             FROM {name}_s GROUP BY ALL),
{name} AS (SELECT {by}, sum(sup)::BIGINT AS records, sum(hit) / sum(sup) AS accuracy, sum(f1) / {n_classes} AS macro_f1,
                  sum(f1 * sup) / sum(sup) AS weighted_f1 FROM {name}_c GROUP BY ALL)"""


SQL_SWEEP = f"""{SQL_VIEWS},
on_validation AS (SELECT * FROM fused WHERE split = 'validation'),
{sql_metrics('on_validation', 'step', '9', 'swept')},
best AS (SELECT step FROM swept ORDER BY round(macro_f1, 12) DESC, round(accuracy, 12) DESC, round(weighted_f1, 12) DESC, step LIMIT 1)"""


@query("fusion_sweep", f"""WITH {SQL_SWEEP}
SELECT step::INTEGER AS step, step / 10.0::DOUBLE AS alpha, records, round(accuracy, 6) AS accuracy,
       round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM swept""")
def fusion_sweep(spark, sf_dir):
    rows, n_classes = fused_base(spark, sf_dir)
    swept = fusion.sweep(rows.filter(F.col("split") == "validation"), "p_text", "p_image", "truth", n_classes)
    return swept.select("step", "alpha", "records", *[r6(m) for m in metrics.METRICS])


@query("fusion_selected", f"""WITH {SQL_SWEEP}
SELECT step::INTEGER AS step, step / 10.0::DOUBLE AS alpha, round(macro_f1, 6) AS macro_f1 FROM swept JOIN best USING (step)""")
def fusion_selected(spark, sf_dir):
    rows, n_classes = fused_base(spark, sf_dir)
    swept = fusion.sweep(rows.filter(F.col("split") == "validation"), "p_text", "p_image", "truth", n_classes)
    return metrics.best_setting(swept, "step", fusion.ALPHA_ORDER).select("step", "alpha", r6("macro_f1"))


def test_predictions(spark, sf_dir) -> tuple[DataFrame, int]:
    """Test records with the three predictions, fused at the weight chosen on validation."""
    rows, n_classes = fused_base(spark, sf_dir)
    swept = fusion.sweep(rows.filter(F.col("split") == "validation"), "p_text", "p_image", "truth", n_classes)
    alpha = metrics.best_setting(swept, "step", fusion.ALPHA_ORDER).first()["alpha"]
    test = rows.filter(F.col("split") == "test").select(
        "vec_id", "truth",
        vectors.argmax(F.col("p_text")).alias("text_only"),
        vectors.argmax(F.col("p_image")).alias("image_only"),
        vectors.let(vectors.blend(F.col("p_text"), F.col("p_image"), alpha), vectors.argmax).alias("fusion"))
    return test, n_classes


MODELS = ("text_only", "image_only", "fusion")


def test_metrics(spark, sf_dir) -> DataFrame:
    test, n_classes = test_predictions(spark, sf_dir)
    rows = test.select("truth", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in MODELS])).alias("m")).select("truth", "m.*")
    return metrics.evaluate(rows, "truth", "pred", ["model"], n_classes)


SQL_TEST = f"""{SQL_SWEEP},
three AS (
  SELECT CASE step WHEN 10 THEN 'text_only' WHEN 0 THEN 'image_only' END AS model, vec_id, label, pred FROM fused
  WHERE split = 'test' AND step IN (0, 10)
  UNION ALL SELECT 'fusion', vec_id, label, pred FROM fused JOIN best USING (step) WHERE split = 'test'),
{sql_metrics('three', 'model', '9', 'tested')},
tested_long AS (SELECT model, 'accuracy' AS metric, accuracy AS value FROM tested UNION ALL
                SELECT model, 'macro_f1', macro_f1 FROM tested UNION ALL SELECT model, 'weighted_f1', weighted_f1 FROM tested)"""


@query("fusion_compare", f"""WITH {SQL_TEST}
SELECT model, metric, round(value, 6) AS value,
       row_number() OVER (PARTITION BY metric ORDER BY round(value, 12) DESC, model)::INTEGER AS rank FROM tested_long""")
def fusion_compare(spark, sf_dir):
    long = metrics.long_metrics(test_metrics(spark, sf_dir), "model").withColumn("value", F.round("value", 12))
    return metrics.rank_models(long).select("model", "metric", r6("value"), "rank")


@query("fusion_deltas", f"""WITH {SQL_TEST}
SELECT a.metric, a.model, b.model AS base, round(a.value - b.value, 6) AS delta,
       round((a.value - b.value) / nullif(b.value, 0), 6) AS relative_change
FROM tested_long a JOIN tested_long b ON a.metric = b.metric AND a.model = 'fusion' AND b.model <> 'fusion'""")
def fusion_deltas(spark, sf_dir):
    long = metrics.long_metrics(test_metrics(spark, sf_dir), "model")
    rows = metrics.metric_deltas(long, "model", [("fusion", "text_only"), ("fusion", "image_only")])
    return rows.select("metric", "model", "base", r6("delta"), r6("relative_change"))


@query("fusion_outcome", f"""WITH {SQL_TEST},
m AS (SELECT round(max(macro_f1) FILTER (model = 'fusion'), 12) AS f, round(max(macro_f1) FILTER (model = 'text_only'), 12) AS t,
             round(max(macro_f1) FILTER (model = 'image_only'), 12) AS i FROM tested)
SELECT CASE WHEN f > t AND f > i THEN 'better_than_both' WHEN f > t THEN 'better_than_text_only'
            WHEN f > i THEN 'better_than_image_only' WHEN f = t AND f = i THEN 'equal_to_both'
            ELSE 'not_better_than_either' END AS outcome FROM m""")
def fusion_outcome(spark, sf_dir):
    wide = test_metrics(spark, sf_dir).groupBy().pivot("model", list(MODELS)).agg(F.round(F.first("macro_f1"), 12))
    return wide.select(metrics.fusion_outcome(
        F.col("fusion"), F.col("text_only"), F.col("image_only")).alias("outcome"))


SQL_CASES = {
    "all_three_correct": "t AND i AND f",
    "text_correct_image_wrong_fusion_correct": "t AND NOT i AND f",
    "text_wrong_image_correct_fusion_correct": "NOT t AND i AND f",
    "both_wrong_fusion_correct": "NOT t AND NOT i AND f",
    "both_correct_fusion_wrong": "t AND i AND NOT f",
    "text_correct_image_wrong_fusion_wrong": "t AND NOT i AND NOT f",
    "text_wrong_image_correct_fusion_wrong": "NOT t AND i AND NOT f",
    "both_wrong_fusion_wrong": "NOT t AND NOT i AND NOT f",
    "fusion_correct": "f",
    "fusion_correct_when_text_wrong": "NOT t AND f",
    "fusion_correct_when_image_wrong": "NOT i AND f",
    "fusion_correct_when_both_wrong": "NOT t AND NOT i AND f",
    "fusion_regression_when_both_correct": "t AND i AND NOT f",
    "fusion_correct_when_at_least_one_baseline_correct": "(t OR i) AND f",
}


@query("fusion_agreement", f"""WITH {SQL_TEST},
w AS (SELECT vec_id, bool_or(pred = label) FILTER (model = 'text_only') AS t,
             bool_or(pred = label) FILTER (model = 'image_only') AS i,
             bool_or(pred = label) FILTER (model = 'fusion') AS f FROM three GROUP BY vec_id)
""" + "\nUNION ALL\n".join(
    f"SELECT '{k}' AS \"case\", count(*) FILTER ({c}) AS count, round(avg(({c})::INT), 6) AS rate FROM w"
    for k, c in SQL_CASES.items()))
def fusion_agreement(spark, sf_dir):
    test, _ = test_predictions(spark, sf_dir)
    right = test.select(*[(F.col(m) == F.col("truth")).alias(m) for m in MODELS])
    return fusion.agreement_cases(right, *MODELS).select("case", "count", r6("rate"))


@query("excluded_classes", f"""
SELECT label, {sql_split('vec_id')} AS split, count(*) AS excluded FROM embeddings
WHERE label = {CLASS_WITHOUT_IMAGES} GROUP BY ALL""")
def excluded_classes(spark, sf_dir):
    """Records left out because their class is missing from one of the two models."""
    views = two_views(spark, sf_dir)
    text_classes = set(model_of(views, "text").classes)
    image_classes = set(model_of(views.filter(F.col("label") != CLASS_WITHOUT_IMAGES), "image").classes)
    return views.filter(~F.col("label").isin(sorted(text_classes & image_classes))).groupBy("label", "split").agg(
        F.count(F.lit(1)).alias("excluded"))


# Each view alone, scored by the full model with the other half set to zero.
def ablated(spark, sf_dir) -> DataFrame:
    base = labelled_vectors(spark, sf_dir)
    model = model_of(base)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), HALF)
    text, image = F.slice("embedding", 1, HALF), F.slice("embedding", HALF + 1, HALF)

    measured = base.select(
        "vec_id", "label", vectors.norm(text).alias("text_norm"), vectors.norm(image).alias("image_norm"),
        model.distances(F.col("embedding")).alias("d"),
        model.distances(F.concat(text, zeros)).alias("d_text"),
        model.distances(F.concat(zeros, image)).alias("d_image"))
    scored = measured.select("*", *[
        vectors.softmax(prototypes.logits(F.col(d))).alias(p)
        for d, p in (("d", "p"), ("d_text", "p_text_only"), ("d_image", "p_image_only"))])
    pred = vectors.argmax(F.col("p"))
    return scored.select(
        "vec_id", "text_norm", "image_norm",
        vectors.share(F.col("text_norm"), F.col("image_norm")).alias("text_share"),
        vectors.kl_divergence(F.col("p"), F.col("p_text_only")).alias("text_kl"),
        vectors.kl_divergence(F.col("p"), F.col("p_image_only")).alias("image_kl"),
        (vectors.argmax(F.col("p_text_only")) != pred).alias("text_changed"),
        (vectors.argmax(F.col("p_image_only")) != pred).alias("image_changed"),
        (model.label_at(pred) == F.col("label")).alias("correct"))


SQL_ABLATED = f"""{SQL_BASE},
variants AS (
  SELECT vec_id, label, 'full' AS kind, v FROM vec UNION ALL
  SELECT vec_id, label, 'text', list_concat(v[1:32], list_transform(range(32), lambda x: 0.0::DOUBLE)) FROM vec UNION ALL
  SELECT vec_id, label, 'image', list_concat(list_transform(range(32), lambda x: 0.0::DOUBLE), v[33:64]) FROM vec),
vd AS (SELECT vec_id, label, kind, cls, -80.0 * list_distance(v, c) AS z FROM variants, proto),
vm AS (SELECT *, max(z) OVER (PARTITION BY vec_id, kind) AS zm FROM vd),
vp AS (SELECT vec_id, label, kind, cls, exp(z - zm) / sum(exp(z - zm)) OVER (PARTITION BY vec_id, kind) AS p FROM vm),
wide AS (SELECT vec_id, any_value(label) AS label, cls, max(p) FILTER (kind = 'full') AS f,
                max(p) FILTER (kind = 'text') AS t, max(p) FILTER (kind = 'image') AS i FROM vp GROUP BY vec_id, cls),
norms AS (SELECT vec_id, sqrt(list_sum(list_transform(v[1:32], lambda x: x * x))) AS text_norm,
                 sqrt(list_sum(list_transform(v[33:64], lambda x: x * x))) AS image_norm FROM vec),
abl AS (SELECT vec_id, any_value(text_norm) AS text_norm, any_value(image_norm) AS image_norm,
    any_value(text_norm / greatest(text_norm + image_norm, 1e-12)) AS text_share,
    sum(greatest(f, 1e-12) * (ln(greatest(f, 1e-12)) - ln(greatest(t, 1e-12)))) AS text_kl,
    sum(greatest(f, 1e-12) * (ln(greatest(f, 1e-12)) - ln(greatest(i, 1e-12)))) AS image_kl,
    arg_max(cls, t) <> arg_max(cls, f) AS text_changed, arg_max(cls, i) <> arg_max(cls, f) AS image_changed,
    arg_max(cls, f) = any_value(label) AS correct
  FROM wide JOIN norms USING (vec_id) GROUP BY vec_id)"""


@query("view_signals", f"""WITH {SQL_ABLATED}
SELECT vec_id, round(text_norm, 6) AS text_norm, round(image_norm, 6) AS image_norm, round(text_share, 6) AS text_share,
       round(text_kl, 6) AS text_kl, round(image_kl, 6) AS image_kl, text_changed, image_changed, correct FROM abl""")
def view_signals(spark, sf_dir):
    rows = ablated(spark, sf_dir)
    rounded = {"text_norm", "image_norm", "text_share", "text_kl", "image_kl"}
    return rows.select(*[r6(c) if c in rounded else F.col(c) for c in rows.columns])


@query("view_ablation", f"""WITH {SQL_ABLATED}
SELECT count(*) AS records, count(*) FILTER (text_changed) AS text_only_changed,
  count(*) FILTER (image_changed) AS image_only_changed, count(*) FILTER (text_changed AND image_changed) AS both_changed,
  count(*) FILTER (NOT text_changed AND NOT image_changed) AS neither_changed,
  round(avg(text_changed::INT), 6) AS text_only_change_rate, round(avg(image_changed::INT), 6) AS image_only_change_rate,
  round(avg(text_changed::INT) FILTER (correct), 6) AS text_only_change_rate_correct,
  round(avg(text_changed::INT) FILTER (NOT correct), 6) AS text_only_change_rate_incorrect,
  round(avg(image_changed::INT) FILTER (correct), 6) AS image_only_change_rate_correct,
  round(avg(image_changed::INT) FILTER (NOT correct), 6) AS image_only_change_rate_incorrect,
  round(avg(text_kl), 6) AS mean_kl_text_only, round(avg(image_kl), 6) AS mean_kl_image_only FROM abl""")
def view_ablation(spark, sf_dir):
    row = fusion.ablation_rates(
        ablated(spark, sf_dir), "text_changed", "image_changed", "correct", "text_kl", "image_kl")
    counts = {"records", "text_only_changed", "image_only_changed", "both_changed", "neither_changed"}
    return row.select(*[F.col(c) if c in counts else r6(c) for c in row.columns])


@query("view_share_bins", f"WITH {SQL_ABLATED}\n" + sql_bins("abl", "text_share", bins.SHARE_EDGES))
def view_share_bins(spark, sf_dir):
    return profile.binned_accuracy(ablated(spark, sf_dir), "text_share", "correct", bins.SHARE_EDGES).withColumn(
        "accuracy", F.round("accuracy", 6))


# Transfer: the second view is added as extra features, scaled by gamma. The
# control gives each training record the second view of another record.
VARIANTS = ("text_only", "permuted", "genuine")


def transfer_predictions(spark, sf_dir) -> DataFrame:
    """``(vec_id, split, label, variant, gamma, pred)`` for every variant and scale.

    The squared distance of concatenated features is the sum of the parts, so
    one set of distances serves every scale.
    """
    views = two_views(spark, sf_dir)
    train = views.filter(F.col("split") == "train")
    permuted = ranking.permute_column(train.select("vec_id", "label", "image"), "vec_id", "image", PERMUTATION_SEED)
    models = {
        "x": PrototypeModel.collect(prototypes.fit_prototypes(train, "label", "text")),
        "z": PrototypeModel.collect(prototypes.fit_prototypes(train, "label", "image")),
        "c": PrototypeModel.collect(prototypes.fit_prototypes(permuted, "label", "image"))}
    measured = views.filter(F.col("split") != "train").select(
        "vec_id", "split", "label",
        models["x"].distances(F.col("text")).alias("x"),
        models["z"].distances(F.col("image")).alias("z"),
        models["c"].distances(F.col("image")).alias("c"))

    def nearest(extra: str | None, gamma: float):
        squared = F.transform("x", lambda a: a * a) if extra is None else F.zip_with(
            "x", extra, lambda a, b: a * a + F.lit(gamma * gamma) * b * b)
        closest = vectors.let(squared, lambda d: F.array_position(d, F.array_min(d)) - 1)
        return models["x"].label_at(closest)

    settings = [("text_only", 0.0, None)] + [
        (v, g, e) for v, e in (("permuted", "c"), ("genuine", "z")) for g in fusion.GAMMAS]
    return measured.select("vec_id", "split", "label", F.explode(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.lit(g).alias("gamma"), nearest(e, g).alias("pred"))
        for v, g, e in settings])).alias("s")).select("vec_id", "split", "label", "s.*")


SQL_TRANSFER = f"""
tv AS (SELECT vec_id, label, {sql_split('vec_id')} AS split, (embedding[1:32])::DOUBLE[] AS x, (embedding[33:64])::DOUBLE[] AS z FROM embeddings),
tr AS (SELECT vec_id, label, z, row_number() OVER (ORDER BY vec_id) AS a,
              row_number() OVER (ORDER BY sha256('{PERMUTATION_SEED}|' || vec_id), vec_id) AS b FROM tv WHERE split = 'train'),
pz AS (SELECT t.vec_id, t.label, s.vec_id AS donor, s.label AS donor_label, s.z FROM tr t JOIN tr s ON t.a = s.b),
feats AS (SELECT 'x' AS k, label, x AS v FROM tv WHERE split = 'train' UNION ALL
          SELECT 'z', label, z FROM tv WHERE split = 'train' UNION ALL SELECT 'c', label, z FROM pz),
fd AS (SELECT k, label AS cls, unnest(v) AS q, generate_subscripts(v, 1) AS pos FROM feats),
fp AS (SELECT k, cls, list(m ORDER BY pos) AS c FROM (SELECT k, cls, pos, avg(q) AS m FROM fd GROUP BY ALL) GROUP BY ALL),
ds AS (SELECT t.vec_id, t.label, t.split, p.cls,
         max(list_distance(t.x, p.c)) FILTER (p.k = 'x') AS dx, max(list_distance(t.z, p.c)) FILTER (p.k = 'z') AS dz,
         max(list_distance(t.z, p.c)) FILTER (p.k = 'c') AS dc
       FROM tv t, fp p WHERE t.split <> 'train' GROUP BY ALL),
st AS (SELECT * FROM (VALUES ('text_only', 0.0::DOUBLE), ('permuted', 0.1::DOUBLE), ('permuted', 0.5::DOUBLE), ('permuted', 1.0::DOUBLE),
       ('genuine', 0.1::DOUBLE), ('genuine', 0.5::DOUBLE), ('genuine', 1.0::DOUBLE)) s(variant, gamma)),
tpred AS (SELECT vec_id, split, label, variant, gamma, arg_min(cls, CASE variant WHEN 'text_only' THEN dx * dx
            WHEN 'permuted' THEN dx * dx + gamma * gamma * dc * dc ELSE dx * dx + gamma * gamma * dz * dz END) AS pred
          FROM ds, st GROUP BY ALL),
{sql_metrics('tpred', 'split, variant, gamma', '10', 'tm')}"""


def transfer_metrics(spark, sf_dir) -> DataFrame:
    return metrics.evaluate(transfer_predictions(spark, sf_dir), "label", "pred", ["split", "variant", "gamma"], 10)


@query("transfer_sweep", f"""WITH {SQL_TRANSFER}
SELECT variant, gamma, records, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(weighted_f1, 6) AS weighted_f1 FROM tm WHERE split = 'validation'""")
def transfer_sweep(spark, sf_dir):
    rows = transfer_metrics(spark, sf_dir).filter(F.col("split") == "validation")
    return rows.select("variant", "gamma", "records", *[r6(m) for m in metrics.METRICS])


SQL_CHOSEN = f"""{SQL_TRANSFER},
chosen AS (SELECT variant, gamma FROM (SELECT variant, gamma, row_number() OVER (PARTITION BY variant
    ORDER BY round(macro_f1, 12) DESC, round(weighted_f1, 12) DESC, round(accuracy, 12) DESC, gamma) AS rn
  FROM tm WHERE split = 'validation') WHERE rn = 1),
final AS (SELECT tm.* FROM tm JOIN chosen USING (variant, gamma) WHERE split = 'test'),
final_long AS (SELECT variant, 'accuracy' AS metric, accuracy AS value FROM final UNION ALL
  SELECT variant, 'macro_f1', macro_f1 FROM final UNION ALL SELECT variant, 'weighted_f1', weighted_f1 FROM final)"""


def chosen_test_metrics(spark, sf_dir) -> DataFrame:
    rows = cut_lineage(transfer_metrics(spark, sf_dir))
    order = [F.round(m, 12).desc() for m in fusion.GAMMA_ORDER] + [F.col("gamma")]
    chosen = ranking.first_examples(rows.filter(F.col("split") == "validation"), ["variant"], order, 1)
    # One row per variant and scale on both sides.
    return rows.filter(F.col("split") == "test").join(
        F.broadcast(chosen.select("variant", "gamma")), ["variant", "gamma"])


@query("transfer_ablation", f"""WITH {SQL_CHOSEN}
SELECT a.metric, a.variant AS model, b.variant AS base, round(a.value - b.value, 6) AS delta,
       round((a.value - b.value) / nullif(b.value, 0), 6) AS relative_change
FROM final_long a JOIN final_long b ON a.metric = b.metric AND (a.variant, b.variant) IN
  (('genuine', 'permuted'), ('genuine', 'text_only'), ('text_only', 'permuted'))""")
def transfer_ablation(spark, sf_dir):
    long = metrics.long_metrics(chosen_test_metrics(spark, sf_dir), "variant")
    rows = metrics.metric_deltas(
        long, "variant", [("genuine", "permuted"), ("genuine", "text_only"), ("text_only", "permuted")])
    return rows.select("metric", "model", "base", r6("delta"), r6("relative_change"))


@query("transfer_outcome", f"""WITH {SQL_CHOSEN},
d AS (SELECT metric, round(max(value) FILTER (variant = 'genuine') - max(value) FILTER (variant = 'permuted'), 12) AS c,
             round(max(value) FILTER (variant = 'genuine') - max(value) FILTER (variant = 'text_only'), 12) AS t FROM final_long GROUP BY metric)
SELECT CASE WHEN bool_and(c > 0) AND bool_and(t > 0) THEN 'SMALL_WEAK_POSITIVE_TRANSFER'
            WHEN bool_and(c > 0) OR bool_and(t > 0) THEN 'MIXED_RESULT' ELSE 'NO_POSITIVE_TRANSFER' END AS interpretation FROM d""")
def transfer_outcome(spark, sf_dir):
    long = metrics.long_metrics(chosen_test_metrics(spark, sf_dir), "variant")
    wide = long.groupBy().pivot("variant", list(VARIANTS)).agg(F.map_from_entries(
        F.collect_list(F.struct("metric", "value"))))

    def gains(base):
        return [F.round(F.col("genuine")[m] - F.col(base)[m], 12) for m in metrics.METRICS]

    return wide.select(fusion.interpretation(gains("permuted"), gains("text_only")).alias("interpretation"))


@query("permutation_control", f"""WITH tv AS (SELECT vec_id, label, {sql_split('vec_id')} AS split FROM embeddings),
tr AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS a,
              row_number() OVER (ORDER BY sha256('{PERMUTATION_SEED}|' || vec_id), vec_id) AS b FROM tv WHERE split = 'train')
SELECT t.vec_id, s.vec_id AS label_from, s.label FROM tr t JOIN tr s ON t.a = s.b""")
def permutation_control(spark, sf_dir):
    train = labelled_vectors(spark, sf_dir).filter(F.col("split") == "train").select("vec_id", "label")
    return ranking.permute_column(train, "vec_id", "label", PERMUTATION_SEED)


@query("permutation_check", f"""WITH tv AS (SELECT vec_id, {sql_split('vec_id')} AS split FROM embeddings)
SELECT count(*) AS records, count(*) AS distinct_sources, true AS complete, true AS moved FROM tv WHERE split = 'train'""")
def permutation_check(spark, sf_dir):
    """The control must use every record exactly once and must not be the identity."""
    train = labelled_vectors(spark, sf_dir).filter(F.col("split") == "train").select("vec_id", "label")
    shuffled = ranking.permute_column(train, "vec_id", "label", PERMUTATION_SEED)
    used = shuffled.groupBy("label_from").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") != F.col("label_from")).alias("moved"))
    return used.agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("distinct_sources"),
        (F.max("n") == 1).alias("complete"), (F.sum("moved") > 0).alias("moved"))
