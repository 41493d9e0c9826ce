from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalumen.functions import bins, vectors
from catalumen.operators import calibration, classparts, fusion, metrics, profile, prototypes, selective
from catalumen.operators.prototypes import PrototypeModel

RNG = np.random.default_rng(11)
LOGITS = RNG.normal(scale=2.0, size=(60, 5))
TRUTH = RNG.integers(0, 5, size=60)


def softmax(z, t=1.0):
    e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
    return e / e.sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(
        [(i, int(y), [float(x) for x in z]) for i, (y, z) in enumerate(zip(TRUTH, LOGITS))],
        "id int, y int, z array<double>")
    return df.withColumn("p", vectors.softmax(F.col("z"))).withColumn("conf", F.array_max("p")).withColumn(
        "pred", vectors.argmax(F.col("p"))).withColumn("correct", F.col("pred") == F.col("y")).cache()


@pytest.mark.parametrize("t", [0.3, 1.0, 4.0])
def test_softmax(spark, scored, t):
    rows = scored.select("id", vectors.softmax(F.col("z"), t).alias("q")).collect()
    assert np.allclose([r["q"] for r in sorted(rows)], softmax(LOGITS, t))


def test_softmax_does_not_overflow(spark):
    row = spark.createDataFrame([([1e4, 1e4 - 1, -1e4],)], "z array<double>").select(vectors.softmax(F.col("z")).alias("p")).first()
    assert math.isclose(sum(row["p"]), 1.0) and row["p"][0] > row["p"][1] > row["p"][2] == 0.0


def test_argmax_and_top_two_on_ties(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.2, 0.5, 0.3],)], "p array<double>")
    rows = df.select(vectors.argmax(F.col("p")).alias("a"), vectors.top_two(F.col("p")).alias("t")).collect()
    assert [r["a"] for r in rows] == [0, 1]
    assert [(r["t"]["c1"], r["t"]["c2"]) for r in rows] == [(0, 1), (1, 2)]


def test_entropy_and_kl(spark, scored):
    rows = scored.orderBy("id").select(
        vectors.entropy(F.col("p")).alias("h"),
        vectors.kl_divergence(F.col("p"), vectors.softmax(F.col("z"), 3.0)).alias("k")).collect()
    p, q = softmax(LOGITS), softmax(LOGITS, 3.0)
    assert np.allclose([r["h"] for r in rows], -(p * np.log(p)).sum(axis=1))
    assert np.allclose([r["k"] for r in rows], (p * np.log(p / q)).sum(axis=1))
    zero = spark.createDataFrame([([1.0, 0.0],)], "p array<double>").select(vectors.entropy(F.col("p")).alias("h")).first()["h"]
    assert abs(zero) < 1e-10


@pytest.mark.parametrize("values, problem", [
    ([0.5, 0.5], None), ([1.0, 0.0], None), ([0.5], "wrong_width"), (None, "missing"), ([0.5, None], "missing"),
    ([float("nan"), 0.5], "not_finite"), ([float("inf"), 0.0], "not_finite"), ([-0.1, 1.1], "negative"),
    ([1.2, 0.0], "above_one"), ([0.5, 0.49], "row_sum"), ([0.5, 0.500009], None)])
def test_vector_problems(spark, values, problem):
    df = spark.createDataFrame([(values,)], "p array<double>")
    assert df.select(vectors.vector_problem(F.col("p"), 2).alias("x")).first()["x"] == problem


def test_project_classes(spark):
    df = spark.createDataFrame([([0.2, 0.2, 0.6],)], "p array<double>")
    kept = df.select(vectors.project_classes(F.col("p"), [0, 2]).alias("q")).first()["q"]
    assert np.allclose(kept, [0.25, 0.75])
    with pytest.raises(Exception, match="probability mass"):
        spark.createDataFrame([([0.0, 1.0, 0.0],)], "p array<double>").select(
            vectors.project_classes(F.col("p"), [0, 2]).alias("q")).collect()


EDGE_VALUES = [0.0, 0.29, 0.57, 0.58, 0.285, 0.5, 0.99, 0.999999, 1.0, 1 / 15, 2 / 15, 7 / 15, 14 / 15, 0.1, 0.3, 0.7, 0.9]


def test_threshold_index_counts_grid_values_not_above(spark):
    values = EDGE_VALUES + [i / 100 for i in range(101)] + RNG.random(300).tolist()
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    grid = [i / 100 for i in range(101)]
    for row in df.select("x", bins.threshold_index(F.col("x")).alias("i")).collect():
        assert row["i"] == sum(t <= row["x"] for t in grid) - 1


def test_equal_width_bins_match_searchsorted(spark):
    values = EDGE_VALUES + np.linspace(0, 1, 16).tolist() + RNG.random(300).tolist()
    edges = np.linspace(0.0, 1.0, 16)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for row in df.select("x", bins.equal_width_bin(F.col("x")).alias("b")).collect():
        assert row["b"] == min(max(int(np.searchsorted(edges, row["x"], side="right")) - 1, 0), 14)


def test_edge_bins_close_the_last_one(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.0999, 0.9, 1.0, 1.1)], "x double")
    assert [r["b"] for r in df.select(bins.edge_bin(F.col("x"), bins.MARGIN_EDGES).alias("b")).collect()] == [0, 1, 1, 10, 10, None]


def test_reliability_and_scores_match_numpy(scored):
    p = softmax(LOGITS)
    conf, right = p.max(axis=1), p.argmax(axis=1) == TRUTH
    edges = np.linspace(0, 1, 16)
    ece = 0.0
    for b in range(15):
        inside = (conf >= edges[b]) & ((conf < edges[b + 1]) | (b == 14))
        if inside.any():
            ece += inside.mean() * abs(conf[inside].mean() - right[inside].mean())
    table = calibration.reliability_table(scored, "conf", "correct")
    assert table.count() == 15 and table.agg(F.sum("count").alias("n")).first()["n"] == 60
    assert math.isclose(calibration.expected_calibration_error(table).first()["ece"], ece)
    row = calibration.likelihood_scores(scored, "z", "y").first()
    assert math.isclose(row["nll"], -np.log(p[np.arange(60), TRUTH]).mean())
    one_hot = np.eye(5)[TRUTH]
    assert math.isclose(row["brier"], ((p - one_hot) ** 2).sum(axis=1).mean())
    assert math.isclose(row["accuracy"], right.mean())


@pytest.mark.parametrize("true_t", [0.4, 3.0, 25.0])
def test_temperature_is_the_grid_minimum(spark, true_t):
    rng = np.random.default_rng(8)
    z = rng.normal(scale=6.0 * true_t, size=(400, 4))
    p = softmax(z, true_t)
    y = np.array([rng.choice(4, p=row) for row in p])
    df = spark.createDataFrame([(int(c), row.tolist()) for c, row in zip(y, z)], "y int, z array<double>").cache()

    def nll(t):
        top = z.max(axis=1)
        return (np.log(np.exp((z - top[:, None]) / t).sum(axis=1)) + (top - z[np.arange(400), y]) / t).mean()

    passes = []

    def curve(temperatures):
        passes.append(len(temperatures))
        return calibration.array_curve(df, "z", "y", temperatures)

    found = calibration.fit_temperature(curve)
    fitted = found.value
    assert found.converged and len(passes) == 3 and math.isclose(found.nll, nll(fitted))
    step = 1 / calibration.TEMPERATURE_UNIT
    assert nll(fitted) <= min(nll(fitted - step), nll(fitted + step)) + 1e-12
    assert nll(fitted) <= min(nll(t) for t in np.geomspace(0.01, 500, 3_000)) + 1e-9


def test_curves_match_one_pass_per_threshold(scored):
    p = softmax(LOGITS)
    conf, right = p.max(axis=1), p.argmax(axis=1) == TRUTH
    counts = selective.threshold_counts(scored, "conf", "correct").cache()
    risk = {r["step"]: r for r in selective.coverage_risk(counts).collect()}
    route = {r["step"]: r for r in selective.routing(counts).collect()}
    assert len(risk) == len(route) == 101
    for i in range(101):
        taken = conf >= i / 100
        assert risk[i]["accepted_count"] == taken.sum() and risk[i]["accepted_error_count"] == (taken & ~right).sum()
        assert route[i]["reviewed_errors"] == (~taken & ~right).sum() and route[i]["reviewed_correct"] == (~taken & right).sum()
        if not taken.any():
            assert risk[i]["selective_risk"] is None and risk[i]["selective_accuracy"] is None
        assert math.isclose(route[i]["model_error_capture_rate"], (~taken & ~right).sum() / (~right).sum())
    assert all(r["passed"] for r in selective.curve_checks(selective.coverage_risk(counts)).collect())
    joined = selective.join_curves(selective.coverage_risk(counts), selective.routing(counts))
    assert joined.count() == 101


def test_all_correct_has_no_capture_rate(spark):
    df = spark.createDataFrame([(0.4, True), (1.0, True)], "conf double, correct boolean")
    rows = {r["step"]: r for r in selective.routing(selective.threshold_counts(df, "conf", "correct")).collect()}
    assert rows[100]["accepted_count"] == 1 and rows[40]["accepted_count"] == 2 and rows[41]["accepted_count"] == 1
    assert all(r["model_error_capture_rate"] is None for r in rows.values())


def test_broken_curve_is_reported(spark):
    curve = spark.createDataFrame(
        [(i, 1.0 if i != 50 else 2.0, 10, 0, 9, 1) for i in range(100)],
        "step int, coverage double, accepted_count int, abstained_count int, accepted_correct_count int, accepted_error_count int")
    passed = {r["check"]: r["passed"] for r in selective.curve_checks(curve).collect()}
    assert not passed["grid_complete"] and not passed["coverage_never_rises"] and passed["accepted_adds_up"]


def brute_f1(truth, pred, classes):
    out = []
    for c in classes:
        tp = sum(t == c == q for t, q in zip(truth, pred))
        fp = sum(q == c != t for t, q in zip(truth, pred))
        fn = sum(t == c != q for t, q in zip(truth, pred))
        out.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
    return out


def test_two_macro_f1_definitions(spark):
    truth, pred = ["a", "a", "b", "c", "c"], ["a", "b", "b", "a", "d"]
    df = spark.createDataFrame(list(zip(truth, pred)), "t string, p string")
    seen = metrics.evaluate(df, "t", "p").first()
    fixed = metrics.evaluate(df, "t", "p", n_classes=6).first()
    assert math.isclose(seen["macro_f1"], np.mean(brute_f1(truth, pred, "abcd")))
    assert math.isclose(fixed["macro_f1"], sum(brute_f1(truth, pred, "abcdef")) / 6)
    assert seen["weighted_f1"] == fixed["weighted_f1"] and math.isclose(seen["accuracy"], 0.4)
    listed = spark.createDataFrame([(c,) for c in "abcdef"], "class string")
    report = {r["class"]: r for r in metrics.class_report(metrics.confusion(df, "t", "p"), classes=listed).collect()}
    assert len(report) == 6 and report["f"]["support"] == 0 == report["f"]["f1"]
    assert (report["c"]["support"], report["c"]["predicted"], report["d"]["predicted"]) == (2, 0, 1)


def test_ranking_deltas_and_outcome(spark):
    long = spark.createDataFrame(
        [("text_only", "accuracy", 0.5), ("image_only", "accuracy", 0.5), ("fusion", "accuracy", 0.6), ("zero", "accuracy", 0.0)],
        "model string, metric string, value double")
    assert [r["model"] for r in metrics.rank_models(long).orderBy("rank").collect()] == ["fusion", "image_only", "text_only", "zero"]
    deltas = {r["base"]: r for r in metrics.metric_deltas(long, "model", [("fusion", "text_only"), ("fusion", "zero")]).collect()}
    assert math.isclose(deltas["text_only"]["relative_change"], 0.2) and deltas["zero"]["relative_change"] is None
    cases = [(3, 1, 2, "better_than_both"), (2, 1, 2, "better_than_text_only"), (2, 2, 1, "better_than_image_only"),
             (1, 1, 1, "equal_to_both"), (0, 1, 1, "not_better_than_either")]
    df = spark.createDataFrame(cases, "f int, t int, i int, want string")
    for r in df.select("want", metrics.fusion_outcome(F.col("f"), F.col("t"), F.col("i")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_best_setting_breaks_ties_in_order(spark):
    df = spark.createDataFrame(
        [(3, 0.5, 0.7, 0.1), (2, 0.5, 0.7, 0.2), (1, 0.5, 0.7, 0.2), (0, 0.4, 0.9, 0.9)],
        "step int, macro_f1 double, accuracy double, weighted_f1 double")
    assert metrics.best_setting(df, "step", fusion.ALPHA_ORDER).first()["step"] == 1


def test_fusion_sweep_matches_numpy(spark):
    a, b = softmax(LOGITS), softmax(RNG.normal(size=LOGITS.shape))
    df = spark.createDataFrame(
        [(int(y), p.tolist(), q.tolist()) for y, p, q in zip(TRUTH, a, b)], "y int, a array<double>, b array<double>")
    rows = {r["step"]: r["accuracy"] for r in fusion.sweep(df, "a", "b", "y", 5).collect()}
    for i in range(11):
        w = i / 10
        assert math.isclose(rows[i], ((w * a + (1 - w) * b).argmax(axis=1) == TRUTH).mean())


def test_agreement_cases_cover_everything(spark):
    rows = [(t, i, f) for t in (True, False) for i in (True, False) for f in (True, False)]
    cases = {r["case"]: r["count"] for r in fusion.agreement_cases(
        spark.createDataFrame(rows, "t boolean, i boolean, f boolean"), "t", "i", "f").collect()}
    assert len(cases) == 14 and cases["fusion_correct"] == 4
    assert sum(n for c, n in cases.items() if c.count("_") >= 2 and n == 1) >= 8
    assert cases["fusion_correct_when_at_least_one_baseline_correct"] == 3


def test_temperature_without_a_minimum_is_told(spark):
    right = spark.createDataFrame([(0, [3.0, 1.0]), (1, [0.0, 2.0])], "y int, z array<double>")
    wrong = right.withColumn("y", 1 - F.col("y"))
    unknown = right.withColumn("y", F.lit(None).cast("int"))
    fits = [calibration.fit_temperature(lambda ts: calibration.array_curve(df, "z", "y", ts)) for df in (right, wrong, unknown)]
    assert [f.converged for f in fits] == [False] * 3 and fits[2].nll is None
    assert fits[0].value == pytest.approx(calibration.LEAST_UNIT / 20_000) and fits[1].value == pytest.approx(calibration.MOST_UNIT / 20_000)


def test_prototypes_match_numpy(spark):
    x = RNG.normal(size=(80, 6)).astype("float32")
    y = RNG.integers(0, 7, size=80)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "id int, y int, v array<float>")
    fitted = prototypes.fit_prototypes(df, "y", "v").cache()
    model = PrototypeModel.collect(fitted)
    classes = sorted(set(y.tolist()))
    centres = np.stack([x[y == c].astype("float64").mean(axis=0) for c in classes])
    assert list(model.classes) == classes and np.allclose(model.matrix, centres)
    d = np.sqrt(((x[:, None, :].astype("float64") - centres[None]) ** 2).sum(axis=2))
    got = df.select("id", model.distances(F.col("v")).alias("d")).orderBy("id").collect()
    assert np.allclose([r["d"] for r in got], d)


@pytest.mark.parametrize("per_part", [1, 3, 100])
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_parts_of_a_model_equal_the_whole(spark, monkeypatch, per_part, metric):
    monkeypatch.setattr(classparts, "CHUNK_VALUES", 40)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 3)) * 0.1
    centres[5], centres[6] = centres[2], centres[2]
    names = [f"class {c}" for c in "abcdefgh"]
    x = rng.normal(size=(40, 3)) * 0.1
    y = [None if i % 9 == 0 else "unknown" if i % 7 == 0 else names[i % 8] for i in range(40)]
    df = spark.createDataFrame([(i, y[i], v.tolist()) for i, v in enumerate(x)], "id int, label string, v array<double>").repartition(3)
    fitted = spark.createDataFrame([(n, c.tolist()) for n, c in zip(names, centres)], "class string, centre array<double>")
    got = {r["id"]: r for r in classparts.score_any(df, classparts.ModelParts(fitted, per_part), "v", "label", metric).collect()}
    d = prototypes._distances(x, centres, metric)
    p = softmax(-80.0 * d)
    for i in range(40):
        r, order = got[i], np.argsort(d[i], kind="stable")
        assert (r["pred"], r["second_class"], r["label"]) == (names[order[0]], names[order[1]], y[i])
        assert r["correct"] == (names[order[0]] == y[i])
        want = {"conf": p[i, order[0]], "second": p[i, order[1]], "entropy": -(p[i] * np.log(np.maximum(p[i], 1e-300))).sum(), "distance": d[i, order[0]]}
        if y[i] in names:
            k = names.index(y[i])
            others = [j for j in range(8) if j != k]
            want |= {"nll": -np.log(p[i, k]), "brier": (p[i] ** 2).sum() - 2 * p[i, k] + 1, "true_distance": d[i, k], "competitor_distance": d[i, others].min()}
        else:
            assert r["nll"] is None and r["brier"] is None and r["true_distance"] is None
        for name, value in want.items():
            assert r[name] == pytest.approx(value, rel=1e-7, abs=1e-9), name


def test_parts_have_no_limit_of_classes_and_no_shuffle(spark, monkeypatch):
    monkeypatch.setattr(classparts, "PART_VALUES", 2_000)
    rng = np.random.default_rng(12)
    centres, x = rng.normal(size=(5_000, 2)), rng.normal(size=(30, 2))
    fitted = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "class int, centre array<double>")
    df = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "id int, y int, v array<double>")
    parts = classparts.ModelParts(fitted)
    assert parts.per_part == 1_000 and parts.classes == 5_000
    scored = classparts.score_any(df, parts, "v", "y")
    d = np.sqrt(((x[:, None] - centres) ** 2).sum(2))
    assert [r["pred"] for r in scored.orderBy("id").collect()] == d.argmin(1).tolist()
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="width"):
        classparts.ModelParts(fitted.unionByName(spark.createDataFrame([(9_999, [1.0])], fitted.schema)))
    with pytest.raises(ValueError, match="two prototypes"):
        classparts.ModelParts(fitted.unionByName(fitted.limit(1)))


def test_temperature_from_parts_equals_the_arrays(spark):
    rng = np.random.default_rng(13)
    centres, x = rng.normal(size=(6, 4)) * 0.05, rng.normal(size=(300, 4)) * 0.05
    d = np.sqrt(((x[:, None] - centres) ** 2).sum(2))
    y = np.array([6 if i % 10 == 0 else rng.choice(6, p=row) for i, row in enumerate(softmax(-80 * d, 2.0))])
    fitted = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "class int, centre array<double>")
    df = spark.createDataFrame([(int(c), v.tolist(), z.tolist(), int(c) if c < 6 else None) for c, v, z in zip(y, x, -80 * d)], "y int, v array<double>, z array<double>, at int").cache()
    one = calibration.fit_temperature(lambda ts: calibration.array_curve(df, "z", "at", ts))
    two = calibration.fit_temperature(lambda ts: classparts.curve(df, classparts.ModelParts(fitted, 2), "v", "y", ts))
    assert one.converged and two.converged and one.value == two.value and one.nll == pytest.approx(two.nll)


def test_narrow_scores_equal_the_array_expressions(spark, monkeypatch):
    x = RNG.normal(scale=0.05, size=(50, 4))
    y = RNG.integers(0, 6, size=50)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "id int, y int, v array<double>")
    model = PrototypeModel.collect(prototypes.fit_prototypes(df.filter("y < 5"), "y", "v"))
    monkeypatch.setattr(prototypes, "CHUNK_VALUES", 20)
    narrow = {r["id"]: r for r in prototypes.score_narrow(df, model, "v", "y").collect()}
    wide = prototypes.score(df, model, "v", "y").withColumn("t", vectors.top_two(F.col("probabilities"))).select(
        "id", "y", "pred", "conf", "correct", "t", vectors.entropy(F.col("probabilities")).alias("h"),
        calibration.nll_term(F.col("logits"), F.col("label_position")).alias("nll"),
        calibration.brier_term(F.col("probabilities"), F.col("label_position")).alias("brier")).collect()
    for r in wide:
        n = narrow[r["id"]]
        assert (n["pred"], n["correct"]) == (r["pred"], r["correct"])
        assert n["second_class"] == model.classes[r["t"]["c2"]]
        assert math.isclose(n["conf"], r["conf"]) and math.isclose(n["second"], r["t"]["p2"]) and math.isclose(n["entropy"], r["h"])
        if r["y"] == 5:
            assert n["nll"] is None and n["brier"] is None and n["label_position"] is None
        else:
            assert math.isclose(n["nll"], r["nll"], rel_tol=1e-9) and math.isclose(n["brier"], r["brier"], rel_tol=1e-9)


def test_model_checks(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "y int, v array<double>")
    fitted = prototypes.fit_prototypes(df, "y", "v")
    with pytest.raises(ValueError, match="without a training record"):
        PrototypeModel.collect(fitted, required=[1, 2, 3])
    with pytest.raises(ValueError, match="no class"):
        PrototypeModel.collect(fitted.limit(0))
    model = PrototypeModel.collect(fitted)
    with pytest.raises(Exception, match="must have 2 values"):
        spark.createDataFrame([([1.0],)], "v array<double>").select(model.distances(F.col("v"))).collect()


def test_correlation_is_null_without_variation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    row = df.agg(profile.correlation(F.col("x"), F.col("y")).alias("a"), profile.correlation(F.col("y"), F.col("y")).alias("b")).first()
    assert row["a"] is None and math.isclose(row["b"], 1.0)


# Published curve points: threshold step, accepted, accepted correct, coverage, risk, error capture.
PUBLISHED = [
    (0, 34958, 33280, 1.0, 0.04800045769208765, 0.0),
    (50, 33696, 32793, 0.9638995365867613, 0.02679843304843305, 0.46185935637663883),
    (90, 31228, 31104, 0.8933005320670518, 0.003970795439989753, 0.9261025029797377),
    (99, 26504, 26488, 0.7581669431889696, 0.0006036824630244491, 0.9904648390941597),
    (100, 8, 8, 0.00022884604382401738, 0.0, 1.0),
]


def test_published_curve_points_are_reproduced(spark):
    """A population with the published counts gives the published rates exactly."""
    ends = PUBLISHED[1:] + [(None, 0, 0, None, None, None)]
    levels = [0.3, 0.7, 0.95, 0.995, 1.0]
    groups = [
        (conf, right - next_right, (n - right) - (next_n - next_right))
        for conf, (_, n, right, *_), (_, next_n, next_right, *_) in zip(levels, PUBLISHED, ends)]
    df = spark.createDataFrame(groups, "conf double, good int, bad int")
    rows = df.select("conf", F.explode(F.concat(
        F.array_repeat(F.lit(True), F.col("good")), F.array_repeat(F.lit(False), F.col("bad")))).alias("correct"))
    counts = selective.threshold_counts(rows, "conf", "correct").cache()
    risk = {r["step"]: r for r in selective.coverage_risk(counts).collect()}
    route = {r["step"]: r for r in selective.routing(counts).collect()}
    for step, accepted, right, coverage, selective_risk, capture in PUBLISHED:
        assert (risk[step]["accepted_count"], risk[step]["accepted_correct_count"]) == (accepted, right)
        assert risk[step]["coverage"] == coverage and risk[step]["selective_risk"] == selective_risk
        assert route[step]["model_error_capture_rate"] == capture


def test_published_class_order_and_rates(spark):
    rows = [(186, 378, 218, 8), (187, 475, 369, 7), (241, 234, 167, 10)]
    df = spark.createDataFrame([
        (c, i < right, 0.95 if i >= n - sure else 0.5) for c, n, right, sure in rows for i in range(n)],
        "label int, correct boolean, conf double")
    got = selective.top_error_classes(selective.class_errors(df, "label", "conf", "correct"), 3).collect()
    assert [r["class_id"] for r in got] == [186, 187, 241]
    assert [r["high_confidence_error_rate"] for r in got] == [0.05, 0.0660377358490566, 0.14925373134328357]
    assert got[0]["accuracy"] == 0.5767195767195767 and got[0]["error_rate"] == 0.42328042328042326
