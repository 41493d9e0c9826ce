"""Text normalisation, tokens, profiles and text models on the document tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions import jsontext, text, vectors
from catalumen.operators import audit, metrics, normalise, profile, termparts, textmodel
from catalumen.plans.base import SQL_SPACES, query, r6, split_of, sql_split, table, text_table
from catalumen.session import cut_lineage

SQL_CLEAN = f"trim(regexp_replace(text, '{SQL_SPACES}', ' ', 'g'))"
SQL_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SQL_LENGTHS = f"""lengths AS (
  SELECT doc_id, CASE WHEN clean = '' THEN 0 ELSE len(string_split(clean, ' ')) END AS n
  FROM (SELECT doc_id, {SQL_CLEAN} AS clean FROM documents))"""
TARGET_LENGTHS = (50, 200, 500, 1_000, 2_000, 5_000)


@query("ws_normalize", f"""
SELECT doc_id, sha256({SQL_CLEAN}) AS clean_sha, {SQL_CLEAN} <> text AS changed FROM documents""")
def ws_normalize(spark, sf_dir):
    clean = text.squeeze_spaces(F.col("text"))
    return text_table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.sha2(clean, 256).alias("clean_sha"), (clean != F.col("text")).alias("changed"))


@query("approved_fields", f"""
WITH f AS (SELECT 'text' AS field, text FROM documents UNION ALL SELECT 'source', source FROM documents
           UNION ALL SELECT 'lang', lang FROM documents)
SELECT field, count(text) AS values_seen, count(*) FILTER ({SQL_CLEAN} <> text) AS values_changed
FROM f GROUP BY field""")
def approved_fields(spark, sf_dir):
    """Normalise only the named columns and count what was seen and changed."""
    approved = ["text", "source", "lang"]
    return normalise.change_counts(text_table(spark, sf_dir, "documents", "doc_id", *approved), approved)


@query("normalised_fields", f"""
SELECT doc_id, sha256({SQL_CLEAN}) AS text_sha, source, n_chars FROM documents""")
def normalised_fields(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars")
    clean = normalise.normalise_fields(docs, ["text", "absent_field"])
    return clean.select("doc_id", F.sha2("text", 256).alias("text_sha"), "source", "n_chars")


@query("word_tokens", f"""
SELECT doc_id, len({SQL_WORDS})::INTEGER AS n_tokens, len(list_distinct({SQL_WORDS}))::INTEGER AS n_distinct,
       sha256(array_to_string({SQL_WORDS}, ' ')) AS tokens_sha FROM documents""")
def word_tokens(spark, sf_dir):
    tokens = text_table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", text.word_tokens(F.col("text")).alias("t"))
    return tokens.select(
        "doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"),
        F.sha2(F.array_join("t", " "), 256).alias("tokens_sha"))


@query("field_tokens", f"""
WITH f AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END AS description,
         source AS brand FROM documents),
c AS (SELECT doc_id,
         coalesce(trim(regexp_replace(title, '{SQL_SPACES}', ' ', 'g')), '') AS title,
         coalesce(trim(regexp_replace(description, '{SQL_SPACES}', ' ', 'g')), '') AS description,
         coalesce(trim(regexp_replace(brand, '{SQL_SPACES}', ' ', 'g')), '') AS brand FROM f),
j AS (SELECT doc_id, array_to_string(list_filter([title, brand, description], lambda x: x <> ''), ' ') AS joined,
         array_to_string(list_filter([CASE WHEN title <> '' THEN 'title' END, CASE WHEN brand <> '' THEN 'brand' END,
           CASE WHEN description <> '' THEN 'description' END], lambda x: x IS NOT NULL), ',') AS present FROM c)
SELECT doc_id, CASE WHEN joined = '' THEN 0 ELSE len(string_split(joined, ' ')) END::INTEGER AS token_count,
       present AS present_text_fields, sha256(joined) AS combined_sha FROM j""")
def field_tokens(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    first_break = F.instr("text", "\n")
    block = text.field_token_block({
        "title": F.substring_index("text", "\n", 1),
        "brand": F.col("source"),
        "description": F.when(first_break > 0, F.substring(F.col("text"), first_break + 1, F.length("text"))),
    })
    return docs.select("doc_id", block.alias("b")).select(
        "doc_id", "b.token_count", F.array_join("b.present_text_fields", ",").alias("present_text_fields"),
        F.sha2(F.array_join("b.combined_tokens", " "), 256).alias("combined_sha"))


@query("title_flags", f"""
SELECT doc_id, contains(text, chr(65533)) AS has_replacement, length({SQL_CLEAN}) <= 3 AS is_short,
       {SQL_CLEAN} <> text AS is_changed, length(text)::INTEGER AS raw_chars, length({SQL_CLEAN})::INTEGER AS clean_chars
FROM documents""")
def title_flags(spark, sf_dir):
    return text_table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", text.title_flags(F.col("text")).alias("f")).select("doc_id", "f.*")


@query("title_audit", f"""
WITH f AS (SELECT source, text, {SQL_CLEAN} AS clean FROM documents)
SELECT source, count(*) AS records, count(*) FILTER (contains(text, chr(65533))) AS with_replacement,
       count(*) FILTER (length(clean) <= 3) AS short, count(*) FILTER (clean <> text) AS changed,
       sum(length(text))::BIGINT AS raw_chars, sum(length(clean))::BIGINT AS clean_chars FROM f GROUP BY source""")
def title_audit(spark, sf_dir):
    flags = text_table(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        "source", text.title_flags(F.col("text")).alias("f"))
    return flags.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("f.has_replacement").alias("with_replacement"),
        F.count_if("f.is_short").alias("short"), F.count_if("f.is_changed").alias("changed"),
        F.sum("f.raw_chars").alias("raw_chars"), F.sum("f.clean_chars").alias("clean_chars"))


def lengths_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.size(text.space_tokens(F.col("text"))).alias("n"))


@query("length_profile", f"""WITH {SQL_LENGTHS}
SELECT l.lim::INTEGER AS "limit", count(*) FILTER (n <= lim) AS within, count(*) FILTER (n > lim) AS over,
       round(count(*) FILTER (n <= lim) * 100.0 / count(*), 6) AS percent_within
FROM lengths, (VALUES (128), (256), (512), (1024)) l(lim) GROUP BY l.lim""")
def length_profile(spark, sf_dir):
    rows = profile.length_limits(lengths_of(spark, sf_dir), "n")
    return rows.select("limit", "within", "over", r6("percent_within"))


@query("length_stats", f"""WITH {SQL_LENGTHS}
SELECT 'tokens' AS signal, count(*) AS count, min(n)::DOUBLE AS min, max(n)::DOUBLE AS max, round(avg(n), 6) AS mean,
       round(quantile_cont(n::DOUBLE, 0.5), 6) AS median, round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90,
       round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(n::DOUBLE, 0.99), 6) AS p99 FROM lengths""")
def length_stats(spark, sf_dir):
    long = lengths_of(spark, sf_dir).select(F.lit("tokens").alias("signal"), F.col("n").cast("double").alias("value"))
    stats = profile.describe(long, "signal", "value", (0.5, 0.9, 0.95, 0.99))
    return stats.select("signal", "count", "min", "max", r6("mean"), *[
        r6(F.col("percentiles")[i], name) for i, name in enumerate(("median", "p90", "p95", "p99"))])


@query("window_excess", f"""WITH {SQL_LENGTHS}
SELECT count(*) AS records, count(*) FILTER (n > 256) AS records_over, sum(greatest(0, n - 256))::BIGINT AS excess_tokens,
       round(avg(greatest(1, ceil(n / 254.0))), 6) AS mean_chunks, max(greatest(1, ceil(n / 254.0)))::INTEGER AS max_chunks
FROM lengths""")
def window_excess(spark, sf_dir):
    n = F.col("n")
    return lengths_of(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(n > text.WINDOW_TOKENS).alias("records_over"),
        F.sum(text.window_excess(n)).alias("excess_tokens"),
        r6(F.avg(text.chunk_count(n)), "mean_chunks"), F.max(text.chunk_count(n)).alias("max_chunks"))


@query("chunk_profile", f"""WITH {SQL_LENGTHS},
c AS (SELECT greatest(1, ceil(n / 254.0))::INTEGER AS chunks, count(*) AS n FROM lengths GROUP BY 1)
SELECT chunks, n, (sum(n) OVER (ORDER BY chunks))::BIGINT AS records_up_to,
       round(sum(n) OVER (ORDER BY chunks) * 100.0 / sum(n) OVER (), 6) AS percent_up_to FROM c""")
def chunk_profile(spark, sf_dir):
    rows = profile.chunk_distribution(lengths_of(spark, sf_dir), "n")
    return rows.select("chunks", "n", "records_up_to", r6("percent_up_to"))


@query("chunk_limits", f"""WITH {SQL_LENGTHS}, c AS (SELECT greatest(1, ceil(n / 254.0)) AS chunks FROM lengths)
SELECT k::INTEGER AS "limit", count(*) FILTER (chunks <= k) AS within, count(*) FILTER (chunks > k) AS over,
       round(count(*) FILTER (chunks <= k) * 100.0 / count(*), 6) AS percent_within
FROM c, (SELECT unnest([1, 2, 3, 4, 5, 8, 10, 16]) AS k) GROUP BY k""")
def chunk_limits(spark, sf_dir):
    counts = lengths_of(spark, sf_dir).select(text.chunk_count(F.col("n")).alias("chunks"))
    return profile.length_limits(counts, "chunks", text.CHUNK_LIMITS).select(
        "limit", "within", "over", r6("percent_within"))


@query("chunk_tokens", f"""
WITH t AS (SELECT doc_id, CASE WHEN {SQL_CLEAN} = '' THEN [] ELSE string_split({SQL_CLEAN}, ' ') END AS toks FROM documents),
c AS (SELECT doc_id, toks, unnest(range(0, greatest(len(toks), 1), 254)) AS s FROM t)
SELECT doc_id, (s // 254)::INTEGER AS chunk, len(toks[s + 1:s + 254])::INTEGER AS n_tokens,
       sha256(array_to_string(toks[s + 1:s + 254], ' ')) AS chunk_sha FROM c""")
def chunk_tokens(spark, sf_dir):
    pieces = text_table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", text.space_tokens(F.col("text")).alias("t")).select(
        "doc_id", F.posexplode(text.chunks(F.col("t"))).alias("chunk", "tokens"))
    return pieces.select("doc_id", "chunk", F.size("tokens").alias("n_tokens"),
                         F.sha2(F.array_join("tokens", " "), 256).alias("chunk_sha"))


@query("nearest_length", f"""WITH {SQL_LENGTHS}, t AS (SELECT unnest([50, 200, 500, 1000, 2000, 5000]) AS target)
SELECT target::INTEGER AS target, (min(row(abs(n - target), doc_id, n))).element_2 AS doc_id FROM lengths, t GROUP BY target"""
       .replace("(min(row(abs(n - target), doc_id, n))).element_2", "arg_min(doc_id, abs(n - target) * 1000000000 + doc_id)"))
def nearest_length(spark, sf_dir):
    return profile.nearest_to_targets(lengths_of(spark, sf_dir), "doc_id", "n", TARGET_LENGTHS).select("target", "doc_id")


# TF-IDF: the vocabulary comes from training documents only.
def _sql_tfidf(tokens: str, bigrams: bool, min_df: int, cap: int | None, sublinear: bool) -> str:
    if bigrams:
        grams = ("list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))")
    else:
        grams = "t"
    limit = f"ORDER BY total DESC, term LIMIT {cap}" if cap else ""
    tf = "(1 + ln(tf))" if sublinear else "tf::DOUBLE"
    return f"""
toks AS (SELECT doc_id, {sql_split('doc_id')} AS split, {tokens} AS t FROM documents),
grams AS (SELECT doc_id, split, unnest({grams}) AS term FROM toks),
tfs AS (SELECT doc_id, any_value(split) AS split, term, count(*) AS tf FROM grams GROUP BY doc_id, term),
voc AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tfs WHERE split = 'train' GROUP BY term HAVING count(*) >= {min_df} {limit}),
nd AS (SELECT count(*) AS n FROM toks WHERE split = 'train'),
raw AS (SELECT doc_id, term, {tf} * (ln((1 + n) / (1 + df)) + 1) AS w FROM tfs JOIN voc USING (term), nd),
wts AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)
"""


SQL_SPACE_TOKENS = f"CASE WHEN {SQL_CLEAN} = '' THEN [] ELSE string_split({SQL_CLEAN}, ' ') END"
# An unaccented word pattern drops one-character words in the capped variant.
SQL_LONG_WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1)"
TFIDF_VARIANTS = {
    "tfidf_bigrams": dict(bigrams=True, min_df=2, cap=None, sublinear=True),
    "tfidf_unigrams": dict(bigrams=False, min_df=2, cap=300_000, sublinear=False),
    "tfidf_capped": dict(bigrams=True, min_df=1, cap=100_000, sublinear=True),
}
SQL_TOKENS = {"tfidf_bigrams": SQL_WORDS, "tfidf_unigrams": SQL_SPACE_TOKENS, "tfidf_capped": SQL_LONG_WORDS}


def tokens_for(variant: str):
    words = text.word_tokens(F.col("text"))
    return {"tfidf_bigrams": words, "tfidf_unigrams": text.space_tokens(F.col("text")),
            "tfidf_capped": F.filter(words, lambda w: F.length(w) > 1)}[variant]


def tfidf_weights(spark, sf_dir, variant: str, names: bool = True) -> DataFrame:
    """Texts are tokenised once, into written packs that hold each word once; words and word pairs are counted from them, in the worker that needs the counts."""
    options = TFIDF_VARIANTS[variant]
    docs = text_table(spark, sf_dir, "documents", "doc_id", "text").withColumn("split", split_of("doc_id"))
    packs = termparts.Packs(docs.select("doc_id", "split", tokens_for(variant).alias("terms")), most=termparts.PACKED // (1 + options["bigrams"]),
                            made=partial(textmodel.counted, with_bigrams=options["bigrams"]))
    terms = cut_lineage(textmodel.vocabulary(packs.where("split", "train"), options["min_df"], options["cap"]))
    n_docs = docs.filter(F.col("split") == "train").agg(F.count(F.lit(1))).scalar()
    return textmodel.tfidf_rows(packs, terms, n_docs, options["sublinear"], names).drop("split")


def _register_tfidf(variant: str) -> None:
    options = TFIDF_VARIANTS[variant]
    sql = f"""WITH {_sql_tfidf(SQL_TOKENS[variant], **options)}
SELECT doc_id, count(*) AS n_features, round(sum(w), 6) AS weight_sum, round(max(w), 6) AS max_weight FROM wts GROUP BY doc_id"""

    @query(variant, sql)
    def run(spark, sf_dir):
        weights = F.transform("terms", lambda t: t["weight"])
        return tfidf_weights(spark, sf_dir, variant, names=False).filter(F.size("terms") > 0).select(
            "doc_id", F.size("terms").cast("long").alias("n_features"), r6(vectors.total(weights), "weight_sum"), r6(F.array_max(weights), "max_weight"))


for _variant in TFIDF_VARIANTS:
    _register_tfidf(_variant)


@query("vocabulary", f"""WITH {_sql_tfidf(SQL_WORDS, False, 2, None, False)}
SELECT term, df, total::BIGINT AS total_tf FROM voc ORDER BY total DESC, term LIMIT 300000""")
def vocabulary(spark, sf_dir):
    train = text_table(spark, sf_dir, "documents", "doc_id", "text").filter(split_of("doc_id") == "train")
    counts = textmodel.term_counts(train, "doc_id", text.word_tokens(F.col("text")))
    return textmodel.vocabulary(counts, 2, 300_000)


# Naive Bayes on the labelled documents, truth = quality.
SQL_NB = f"""
lab AS (SELECT doc_id, quality AS cls, {sql_split('doc_id')} AS split FROM labels),
tok AS (SELECT doc_id, unnest({SQL_WORDS}) AS term FROM documents),
cnt AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
tr AS (SELECT term, cls, tf FROM cnt JOIN lab USING (doc_id) WHERE split = 'train'),
voc AS (SELECT term FROM tr GROUP BY term HAVING count(*) >= 2),
pairs AS (SELECT term, cls, sum(tf) AS n FROM tr JOIN voc USING (term) GROUP BY ALL),
mass AS (SELECT cls, sum(n) AS m FROM pairs GROUP BY cls),
consts AS (SELECT cls, ln(count(*) / (SELECT count(*) FROM lab WHERE split = 'train')) AS prior,
                  -ln(any_value(m) + (SELECT count(*) FROM voc)) AS unseen
           FROM lab JOIN mass USING (cls) WHERE split = 'train' GROUP BY cls)"""


def _sql_scores(counts: str, key: str, ids: str) -> str:
    return f"""
klen AS (SELECT {key}, sum(tf) AS length FROM {counts} JOIN voc USING (term) GROUP BY {key}),
base AS (SELECT d.{key}, cls, prior + coalesce(length, 0) * unseen AS s FROM {ids} d CROSS JOIN consts LEFT JOIN klen USING ({key})),
gain AS (SELECT {key}, cls, sum(tf * ln(n + 1)) AS s FROM {counts} JOIN pairs USING (term) GROUP BY ALL),
sc AS (SELECT b.{key}, b.cls, b.s + coalesce(g.s, 0) AS score FROM base b LEFT JOIN gain g USING ({key}, cls))"""


def nb_model(spark: SparkSession, sf_dir: str):
    """Labels, written sparse rows of the labelled documents, and the fitted model."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").withColumn("split", split_of("doc_id"))
    docs = text_table(spark, sf_dir, "documents", "doc_id", "text").join(labels, "doc_id")
    rows = cut_lineage(textmodel.sparse_rows(
        docs, "doc_id", text.word_tokens(F.col("text")), keep=["split", "quality"]), "sparse-rows")
    train = rows.filter(F.col("split") == "train")
    terms = cut_lineage(textmodel.vocabulary(train, 2))
    classes, weights = textmodel.fit_naive_bayes(
        textmodel.exploded(train), terms, labels.filter(F.col("split") == "train"), "quality")
    return labels, rows, textmodel.NaiveBayes(terms, classes, weights)


def nb_predictions(spark, sf_dir) -> DataFrame:
    _, rows, model = nb_model(spark, sf_dir)
    held_out = rows.filter(F.col("split") != "train")
    return held_out.select("doc_id", "split", "quality").join(model.predict(held_out, "doc_id"), "doc_id")


@query("nb_text", f"""WITH {SQL_NB}, held AS (SELECT doc_id FROM lab JOIN documents USING (doc_id) WHERE split <> 'train'),
hc AS (SELECT cnt.* FROM cnt JOIN held USING (doc_id)), {_sql_scores('hc', 'doc_id', 'held')}
SELECT doc_id, any_value(split) AS split, any_value(lab.cls) AS true_label, arg_max(sc.cls, score) AS predicted_label,
       round(max(score), 6) AS score
FROM sc JOIN lab USING (doc_id) GROUP BY doc_id""")
def nb_text(spark, sf_dir):
    return nb_predictions(spark, sf_dir).select(
        "doc_id", "split", F.col("quality").alias("true_label"), F.col("pred").alias("predicted_label"), r6("score"))


@query("nb_metrics", f"""WITH {SQL_NB}, held AS (SELECT doc_id FROM lab JOIN documents USING (doc_id) WHERE split <> 'train'),
hc AS (SELECT cnt.* FROM cnt JOIN held USING (doc_id)), {_sql_scores('hc', 'doc_id', 'held')},
pr AS (SELECT doc_id, any_value(split) AS split, any_value(lab.cls) AS t, arg_max(sc.cls, score) AS q FROM sc JOIN lab USING (doc_id) GROUP BY doc_id),
k AS (SELECT split, c, count(*) FILTER (t = c) AS sup, count(*) FILTER (q = c) AS prd, count(*) FILTER (t = c AND q = c) AS hit
      FROM pr, (SELECT unnest([0, 1]) AS c) GROUP BY ALL),
f AS (SELECT *, CASE WHEN sup + prd > 0 THEN 2 * hit / (sup + prd) ELSE 0 END AS f1 FROM k)
SELECT split, sum(sup)::BIGINT AS records, round(sum(hit) / sum(sup), 6) AS accuracy,
       round(avg(f1) FILTER (sup + prd > 0), 6) AS macro_f1, round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1 FROM f GROUP BY split""")
def nb_metrics(spark, sf_dir):
    rows = metrics.evaluate(nb_predictions(spark, sf_dir), "quality", "pred", ["split"])
    return rows.select("split", "records", *[r6(m) for m in metrics.METRICS])


@query("nb_transfer", f"""WITH {SQL_NB},
btok AS (SELECT item_id, unnest({SQL_WORDS}) AS term FROM benchmark),
bc AS (SELECT item_id, term, count(*) AS tf FROM btok GROUP BY ALL), {_sql_scores('bc', 'item_id', 'benchmark')},
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY item_id)) AS e FROM sc)
SELECT item_id, cls AS class, round(e / sum(e) OVER (PARTITION BY item_id), 6) AS probability FROM e""")
def nb_transfer(spark, sf_dir):
    """The model of one table scores the records of another; the vectors are features there."""
    _, _, model = nb_model(spark, sf_dir)
    rows = textmodel.sparse_rows(table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", text.word_tokens(F.col("text")))
    return model.scores(rows, "item_id").select("item_id", "class", r6("probability"))


# JSON of unknown shape, built from each conversation turn.
def turn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    document = F.struct(
        F.array(F.struct(F.col("role").alias("language_tag"), F.col("text").alias("value"))).alias("item_name"),
        F.struct(F.col("role").alias("source"), F.array("text").alias("body")).alias("note"))
    return turns.select("conv_id", "turn", F.to_json(document).alias("raw"))


@query("json_text", f"""
WITH c AS (SELECT conv_id, turn, role, {SQL_CLEAN} AS clean FROM conversations)
SELECT conv_id, turn, 3 AS listing_leaves, sha256(concat_ws(' ', clean, role, clean)) AS listing_sha,
       2 AS attribute_leaves, sha256(concat_ws(' ', clean, clean)) AS attribute_sha FROM c""")
def json_text(spark, sf_dir):
    leaves = turn_documents(spark, sf_dir).select(
        "conv_id", "turn", jsontext.text_leaves(F.col("raw")).alias("listing"),
        jsontext.text_leaves(F.col("raw"), jsontext.ATTRIBUTE_SKIPPED_KEYS, prefer_value=False).alias("attribute"))

    def digest(column):
        return F.sha2(text.squeeze_spaces(F.array_join(column, " ")), 256)

    return leaves.select(
        "conv_id", "turn", F.size("listing").alias("listing_leaves"), digest("listing").alias("listing_sha"),
        F.size("attribute").alias("attribute_leaves"), digest("attribute").alias("attribute_sha"))


@query("json_squeeze", f"""
SELECT conv_id, turn, sha256({SQL_CLEAN}) AS value_sha, sha256(text) AS body_sha FROM conversations""")
def json_squeeze(spark, sf_dir):
    """Normalise below the approved field only; the other copy of the text stays as it is."""
    cleaned = turn_documents(spark, sf_dir).select(
        "conv_id", "turn", jsontext.squeeze_json(F.col("raw"), only=("value",), keep=("language_tag",)).alias("raw"))
    return cleaned.select(
        "conv_id", "turn", F.sha2(F.get_json_object("raw", "$.item_name[0].value"), 256).alias("value_sha"),
        F.sha2(F.get_json_object("raw", "$.note.body[0]"), 256).alias("body_sha"))


@query("typed_values", f"""
SELECT conv_id, turn, sha256({SQL_CLEAN}) AS value_sha, role AS first_tag FROM conversations""")
def typed_values(spark, sf_dir):
    """The same for a declared shape, without leaving the JVM."""
    turns = table(spark, sf_dir, "conversations").withColumn(
        "items", F.array(F.struct(F.col("role").alias("language_tag"), F.col("text").alias("value"))))
    clean = turns.withColumn("items", text.squeeze_values(F.col("items")))
    return clean.select("conv_id", "turn", F.sha2(text.joined_values(F.col("items")), 256).alias("value_sha"),
                        F.col("items")[0]["language_tag"].alias("first_tag"))


@query("text_counters", f"""
WITH f AS (SELECT *, {SQL_CLEAN} AS clean FROM documents)
SELECT 'records' AS counter, count(*) AS value FROM f UNION ALL
SELECT 'empty_text', count(*) FILTER (clean = '') FROM f UNION ALL
SELECT 'missing_lang', count(*) FILTER (lang IS NULL OR lang = '') FROM f UNION ALL
SELECT 'wrong_n_chars', count(*) FILTER (n_chars <> length(text)) FROM f UNION ALL
SELECT 'changed_by_normalisation', count(*) FILTER (clean <> text) FROM f""")
def text_counters(spark, sf_dir):
    clean = text.squeeze_spaces(F.col("text"))
    return audit.counters(text_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars"), {
        "empty_text": clean == "",
        "missing_lang": F.col("lang").isNull() | (F.col("lang") == ""),
        "wrong_n_chars": F.col("n_chars") != F.char_length("text"),
        "changed_by_normalisation": clean != F.col("text"),
    })
