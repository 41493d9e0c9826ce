"""Linear text classifiers: brands of parts, and turns of conversations with features carried over from documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.functions import text
from catalumen.operators import fusion, linear, metrics, ranking, termparts, textmodel
from catalumen.operators.linear import RIDGE, fit_linear
from catalumen.plans.base import query, r6, split_of, sql_split, table, text_table
from catalumen.plans.multiview import PERMUTATION_SEED, sql_metrics
from catalumen.plans.texts import SQL_WORDS
from catalumen.session import cut_lineage

SQL_ROUNDS = 6


def sql_linear(rounds: int, settings: int) -> str:
    """CTEs ``lin(k, setting, pred, score)`` from ``rec(k, y, train)`` and ``ent(k, y, train, term, setting, w)``, one block a step."""
    parts = [f"""lin_n AS MATERIALIZED (SELECT count(*) AS n FROM rec WHERE train),
lip AS MATERIALIZED (SELECT term, sum(o * w * w) * 2.0 / any_value(n) AS l FROM (SELECT *, count(*) OVER (PARTITION BY k) AS o FROM ent WHERE train), lin_n
        GROUP BY term HAVING sum(o * w * w) > 0),
x AS MATERIALIZED (SELECT k, y, train, term, setting, w / sqrt(l) AS x FROM ent JOIN lip USING (term)),
lab AS MATERIALIZED (SELECT s, label FROM (SELECT DISTINCT y AS label FROM rec WHERE train), (SELECT unnest(range({settings})) AS s)),
v0 AS (SELECT 0::BIGINT AS s, '' AS label, '' AS term, 0.0::DOUBLE AS w, 0.0::DOUBLE AS weight WHERE false)"""]
    for r, beyond in enumerate(linear.momentum(rounds), 1):
        parts.append(f"""z{r} AS MATERIALIZED (SELECT k, s, label, any_value(y) AS y, -1 + sum(x * weight) AS z FROM x JOIN v{r - 1} USING (term) WHERE train GROUP BY k, s, label),
p{r} AS MATERIALIZED (
  SELECT rec.k, lab.s, rec.y AS label, -greatest(1 - coalesce(z, -1), 0) * 2.0 / n AS p
  FROM rec JOIN lab ON rec.y = lab.label LEFT JOIN z{r} ON z{r}.k = rec.k AND z{r}.s = lab.s AND z{r}.label = rec.y, lin_n WHERE train
  UNION ALL SELECT k, s, label, (1 + z) * 2.0 / n FROM z{r}, lin_n WHERE label <> y AND z > -1),
g{r} AS MATERIALIZED (SELECT s, label, term, sum(p * x) AS g FROM p{r} JOIN x USING (k) WHERE setting = -1 OR setting = s GROUP BY s, label, term),
u{r} AS (SELECT s, label, term, coalesce(w, 0) AS w, coalesce(weight, 0) - (coalesce(g, 0) + {RIDGE} * coalesce(weight, 0)) / (1 + {RIDGE}) AS new
         FROM v{r - 1} FULL JOIN g{r} USING (s, label, term)),
v{r} AS MATERIALIZED (SELECT s, label, term, new AS w, new + {beyond!r} * (new - w) AS weight FROM u{r})""")
    parts.append(f"""lin_z AS (SELECT k, s, label, -1 + sum(x * w) AS z FROM x JOIN v{rounds} USING (term) WHERE NOT train GROUP BY k, s, label),
lin_all AS (SELECT rec.k, lab.s AS setting, lab.label, round(coalesce(z, -1), 9) AS z FROM rec JOIN lab ON NOT rec.train
            LEFT JOIN lin_z ON lin_z.k = rec.k AND lin_z.s = lab.s AND lin_z.label = lab.label),
lin AS MATERIALIZED (SELECT k, setting, label AS pred, z AS score FROM lin_all QUALIFY row_number() OVER (PARTITION BY k, setting ORDER BY z DESC, label) = 1)""")
    return ",\n".join(parts)


# Brand of a part from the words and word pairs of its name and type.
SQL_BRAND = f"""
toks AS (SELECT p_partkey AS k, p_brand AS y, {sql_split('p_partkey')} AS split, {SQL_WORDS.replace('text', "(p_name || ' ' || p_type)")} AS t FROM part),
rec AS MATERIALIZED (SELECT k, y, split, split = 'train' AS train FROM toks),
grams AS (SELECT k, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM toks),
tfs AS (SELECT k, term, count(*) AS tf FROM grams GROUP BY k, term),
voc AS (SELECT term, count(*) AS df FROM tfs JOIN rec USING (k) WHERE train GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT k, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM rec WHERE train)) / (1 + df)) + 1) AS w FROM tfs JOIN voc USING (term)),
ent AS MATERIALIZED (SELECT k, y, train, term, -1 AS setting, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM raw JOIN rec USING (k)),
{sql_linear(SQL_ROUNDS, 1)}"""


def brand_rows(spark, sf_dir) -> DataFrame:
    """``(p_partkey, p_brand, split, terms)`` with tf-idf weights from the training parts."""
    parts = text_table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name", "p_type").withColumn("split", split_of("p_partkey"))
    words = text.word_tokens(F.concat_ws(" ", "p_name", "p_type"))
    rows = cut_lineage(textmodel.sparse_rows(parts, "p_partkey", words, True, ["p_brand", "split"]), "sparse-rows")
    train = rows.filter(F.col("split") == "train")
    terms = cut_lineage(textmodel.vocabulary(train, 2), "brand-terms")
    return cut_lineage(textmodel.tfidf_rows(rows, terms, train.agg(F.count(F.lit(1))).scalar(), True), "brand-rows")


def brand_predictions(spark, sf_dir) -> DataFrame:
    rows = brand_rows(spark, sf_dir)
    model = fit_linear(rows.filter(F.col("split") == "train"), "p_brand", rounds=SQL_ROUNDS)
    held_out = rows.filter(F.col("split") != "train")
    return held_out.select("p_partkey", "split", "p_brand").join(model.predict(held_out, "p_partkey").drop("setting"), "p_partkey")


@query("linear_text", f"""WITH {SQL_BRAND}
SELECT k AS p_partkey, split, y AS true_label, pred AS predicted_label, round(score, 6) AS score FROM lin JOIN rec USING (k)""")
def linear_text(spark, sf_dir):
    """Linear classifier of many classes on word pairs: fitted on training parts, applied to the others."""
    return brand_predictions(spark, sf_dir).select(
        "p_partkey", "split", F.col("p_brand").alias("true_label"), F.col("pred").alias("predicted_label"), r6("score"))


@query("linear_metrics", f"""WITH {SQL_BRAND},
lp AS (SELECT split, y AS label, pred FROM lin JOIN rec USING (k)), {sql_metrics('lp', 'split', '25', 'lm')}
SELECT split, records, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM lm""")
def linear_metrics(spark, sf_dir):
    rows = metrics.evaluate(brand_predictions(spark, sf_dir), "p_brand", "pred", ["split"], 25)
    return rows.select("split", "records", *[r6(m) for m in metrics.METRICS])


# Features carried over: a frozen model of document languages scores every turn, and its class probabilities join the turn's words.
SETTINGS = [("text_only", 0.0), *[(v, g) for v in ("permuted", "genuine") for g in fusion.GAMMAS]]
SQL_SETTINGS = "(VALUES " + ", ".join(f"({i}, '{v}', {g}::DOUBLE)" for i, (v, g) in enumerate(SETTINGS)) + ") st(setting, variant, gamma)"
SQL_JOINED = f"""
dtok AS (SELECT doc_id, lang, unnest({SQL_WORDS}) AS term FROM documents WHERE {sql_split('doc_id')} = 'train' AND lang IS NOT NULL),
dcnt AS (SELECT doc_id, lang, term, count(*) AS tf FROM dtok GROUP BY ALL),
dvoc AS MATERIALIZED (SELECT term FROM dcnt GROUP BY term HAVING count(*) >= 2),
dpairs AS MATERIALIZED (SELECT term, lang AS cls, sum(tf) AS n FROM dcnt JOIN dvoc USING (term) GROUP BY ALL),
dmass AS (SELECT cls, sum(n) AS m FROM dpairs GROUP BY cls),
ddocs AS (SELECT lang AS cls, count(*) AS docs FROM documents WHERE {sql_split('doc_id')} = 'train' AND lang IS NOT NULL GROUP BY lang),
dconst AS MATERIALIZED (SELECT cls, ln(docs / (SELECT sum(docs) FROM ddocs)) AS prior, -ln(coalesce(m, 0) + (SELECT count(*) FROM dvoc)) AS unseen
           FROM ddocs LEFT JOIN dmass USING (cls)),
turns AS MATERIALIZED (SELECT conv_id * 1000 + turn AS k, role AS y, {sql_split('conv_id * 1000 + turn')} AS split, {SQL_WORDS} AS t FROM conversations),
rec AS MATERIALIZED (SELECT k, y, split, split = 'train' AS train FROM turns),
tt AS (SELECT k, unnest(t) AS term FROM turns),
tfs AS MATERIALIZED (SELECT k, term, count(*) AS tf FROM tt GROUP BY k, term),
klen AS (SELECT k, sum(tf) AS length FROM tfs JOIN dvoc USING (term) GROUP BY k),
gain AS (SELECT k, cls, sum(tf * ln(n + 1)) AS s FROM tfs JOIN dpairs USING (term) GROUP BY ALL),
sc AS (SELECT rec.k, c.cls, round(prior + coalesce(length, 0) * unseen + coalesce(s, 0), 9) AS score
       FROM rec CROSS JOIN dconst c LEFT JOIN klen USING (k) LEFT JOIN gain g ON g.k = rec.k AND g.cls = c.cls),
ex AS (SELECT *, exp(score - max(score) OVER (PARTITION BY k)) AS e FROM sc),
zs AS MATERIALIZED (SELECT k, cls, e / sum(e) OVER (PARTITION BY k) AS z FROM ex),
place AS (SELECT k, row_number() OVER (ORDER BY k) AS a, row_number() OVER (ORDER BY sha256('{PERMUTATION_SEED}|' || k), k) AS b FROM rec WHERE train),
donor AS (SELECT t.k, s.k AS from_k FROM place t JOIN place s ON t.a = s.b),
voc AS (SELECT term, count(*) AS df FROM tfs JOIN rec USING (k) WHERE train GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT k, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM rec WHERE train)) / (1 + df)) + 1) AS w FROM tfs JOIN voc USING (term)),
ent AS MATERIALIZED (
  SELECT k, y, train, term, -1 AS setting, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM raw JOIN rec USING (k)
  UNION ALL
  SELECT rec.k, y, train, setting || '|z:' || cls, setting, gamma * z
  FROM rec JOIN {SQL_SETTINGS} ON gamma > 0 LEFT JOIN donor USING (k)
  JOIN zs ON zs.k = CASE WHEN train AND variant = 'permuted' THEN from_k ELSE rec.k END),
{sql_linear(SQL_ROUNDS, len(SETTINGS))},
lp AS (SELECT split, variant, gamma, y AS label, pred FROM lin JOIN rec USING (k) JOIN {SQL_SETTINGS} USING (setting)),
{sql_metrics('lp', 'split, variant, gamma', '3', 'lm')}"""


def joined_rows(spark, sf_dir) -> DataFrame:
    """``(k, role, split, terms)``: the turn's words beside the carried-over probabilities, scaled for each setting.

    Shifted indices keep the two spaces apart: each setting has terms of its own
    for the second one, so that one fit serves all scales and the control.
    """
    docs = text_table(spark, sf_dir, "documents", "doc_id", "lang", "text").filter(
        (split_of("doc_id") == "train") & F.col("lang").isNotNull())
    # Texts are tokenised once, into packs; pairs of a term and a language are counted in blocks where they lie.
    source = termparts.Packs(docs.select("doc_id", "lang", text.word_tokens(F.col("text")).alias("terms")), made=partial(textmodel.counted, with_bigrams=False))
    counts = cut_lineage(termparts.term_totals(source, "lang").withColumnRenamed("total_tf", "tf"), "source-counts")
    known = cut_lineage(textmodel.vocabulary(source, 2), "source-terms")
    frozen = textmodel.NaiveBayes(known, *textmodel.fit_naive_bayes(counts, known, docs.select("lang"), "lang"))

    turns = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 1_000 + F.col("turn")).withColumn("split", split_of("k"))
    rows = cut_lineage(textmodel.sparse_rows(turns, "k", text.word_tokens(F.col("text")), keep=["role", "split"]), "turn-rows")
    # As many entries a record as the source model has classes: the record's own feature vector.
    carried = cut_lineage(frozen.scores(rows, "k").groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("class", "probability"))).alias("z")), "carried")
    train = rows.filter(F.col("split") == "train")
    # These tables have a row for each turn: they are never broadcast.
    permuted = ranking.permute_column(train.select("k").join(carried.hint("merge"), "k"), "k", "z", PERMUTATION_SEED).select("k", F.col("z").alias("control"))
    terms = cut_lineage(textmodel.vocabulary(train, 2), "turn-terms")
    weighed = textmodel.tfidf_rows(rows, terms, train.agg(F.count(F.lit(1))).scalar(), True)
    both = weighed.join(carried.hint("merge"), "k").join(permuted.hint("merge"), "k", "left")

    def scaled(setting: int, variant: str, gamma: float):
        vector = F.coalesce("control", "z") if variant == "permuted" else F.col("z")
        return F.transform(vector, lambda e: F.struct(
            linear.own_term(setting, F.concat(F.lit("z:"), e["class"])).alias("term"), (F.lit(gamma) * e["probability"]).alias("weight")))

    second = [scaled(i, v, g) for i, (v, g) in enumerate(SETTINGS) if g > 0]
    return cut_lineage(both.select("k", "role", "split", F.concat("terms", *second).alias("terms")), "joined-rows")


@query("joined_features", f"""WITH {SQL_JOINED}
SELECT split, variant, gamma, records, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM lm""")
def joined_features(spark, sf_dir):
    """Text only, carried-over features at every scale, and the permuted control, from one fit."""
    rows = joined_rows(spark, sf_dir)
    model = fit_linear(rows.filter(F.col("split") == "train"), "role", settings=len(SETTINGS), rounds=SQL_ROUNDS)
    held_out = rows.filter(F.col("split") != "train")
    listed = spark.createDataFrame([(i, v, g) for i, (v, g) in enumerate(SETTINGS)], "setting int, variant string, gamma double")
    # One row per setting.
    found = held_out.select("k", "role", "split").join(model.predict(held_out, "k").hint("merge"), "k").join(F.broadcast(listed), "setting")
    scores = metrics.evaluate(found, "role", "pred", ["split", "variant", "gamma"], 3)
    return scores.select("split", "variant", "gamma", "records", *[r6(m) for m in metrics.METRICS])
