"""Identity, taxonomy, labels, splits and audits on the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions import identity, jsontext, labels, paths, text
from catalumen.operators import audit, components, images, jsonleaves, metrics, profile, ranking, taxonomy
from catalumen.operators.joins import assert_one_to_one, join_spread, lookup
from catalumen.plans.base import query, r6, split_of, sql_bucket, sql_split, table
from catalumen.session import cut_lineage
from catalumen.sources import files

# ---------------------------------------------------------------- identity


def listing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    domain = F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment"))
    return customers.withColumn("domain", domain).withColumn(
        "record_id", identity.record_id("listing", F.col("c_custkey"), F.col("c_name"), F.col("domain")))


SQL_LISTING_ID = ("'listing:' || substr(sha256(c_custkey || '|' || c_name || '|' || "
                  "CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment ELSE '' END), 1, 16)")


def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as an earlier run left them: some of another record, some in upper case."""
    other = identity.record_id("listing", F.col("c_custkey") + 1, F.col("c_name"), F.col("domain"))
    return listing_ids(spark, sf_dir).withColumn(
        "stored", F.when(F.col("c_custkey") % 13 == 0, other).when(F.col("c_custkey") % 17 == 0, F.upper("record_id"))
        .otherwise(F.col("record_id")))


@query("record_ids", f"""SELECT c_custkey, {SQL_LISTING_ID} AS record_id, c_custkey % 13 = 0 OR c_custkey % 17 <> 0 AS well_formed,
  c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AS agrees FROM customer""")
def record_ids(spark, sf_dir):
    """Ids worked out again and held against the stored ones."""
    return stored_ids(spark, sf_dir).select(
        "c_custkey", "record_id", identity.record_id_is_well_formed(F.col("stored"), "listing").alias("well_formed"),
        (F.col("record_id") == F.col("stored")).alias("agrees"))


@query("id_checks", """
WITH i AS (SELECT count(*) FILTER (c_custkey % 13 <> 0 AND c_custkey % 17 = 0) AS odd, count(*) FILTER (c_custkey % 19 = 0) AS twice FROM customer)
SELECT 'malformed_ids' AS "check", odd AS observed, 0::BIGINT AS expected, odd = 0 AS passed FROM i
UNION ALL SELECT 'repeated_ids', twice, 0, twice = 0 FROM i""")
def id_checks(spark, sf_dir):
    """Stored ids, some of which were delivered twice."""
    stored = stored_ids(spark, sf_dir)
    ids = stored.unionByName(stored.filter(F.col("c_custkey") % 19 == 0)).groupBy(F.col("stored").alias("id")).agg(
        F.count(F.lit(1)).alias("n"))
    observed = ids.agg(
        F.count_if(~identity.record_id_is_well_formed(F.col("id"), "listing")).alias("malformed_ids"),
        F.sum(F.col("n") - 1).alias("repeated_ids"))
    rows = observed.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in observed.columns])).alias("c")).select("c.*")
    return audit.check_table(rows, {"malformed_ids": 0, "repeated_ids": 0})


@query("hash_split", f"""
SELECT o_orderkey, {sql_bucket('o_orderkey')}::INTEGER AS bucket, {sql_split('o_orderkey')} AS split,
       CASE WHEN {sql_bucket('o_orderkey')} < 90000 THEN 'train' ELSE 'validation' END AS two_way FROM orders""")
def hash_split(spark, sf_dir):
    keyed = table(spark, sf_dir, "orders", "o_orderkey").withColumn("bucket", identity.bucket(F.col("o_orderkey")))
    return keyed.select("o_orderkey", "bucket", identity.three_way_split(F.col("bucket")).alias("split"),
                        identity.two_way_split(F.col("bucket")).alias("two_way"))


@query("partition_check", f"""
WITH s AS (SELECT o_orderkey AS k, {sql_split('o_orderkey')} AS split FROM orders),
p AS (SELECT k, split FROM s WHERE k % 103 <> 0 UNION ALL SELECT k, 'test' FROM s WHERE k % 101 = 0),
h AS (SELECT s.k, min(p.split) AS split, max(p.split) AS last FROM s LEFT JOIN p ON s.k = p.k GROUP BY s.k)
SELECT count(*) AS population, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation,
       count(*) FILTER (split = 'test') AS test, count(*) FILTER (split <> last) AS in_two_parts,
       count(*) FILTER (split IS NULL) = 0 AS covers_population FROM h""")
def partition_check(spark, sf_dir):
    """Three id lists against the population; some ids are in two lists and some in none."""
    population = table(spark, sf_dir, "orders", "o_orderkey")
    lists = population.withColumn("split", split_of("o_orderkey"))
    parts = lists.filter(F.col("o_orderkey") % 103 != 0).unionByName(
        lists.filter(F.col("o_orderkey") % 101 == 0).withColumn("split", F.lit("test")))
    held = population.join(parts, "o_orderkey", "left").groupBy("o_orderkey").agg(
        F.min("split").alias("split"), F.max("split").alias("last"))
    return held.agg(
        F.count(F.lit(1)).alias("population"), *[
            F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")],
        F.count_if(F.col("split") != F.col("last")).alias("in_two_parts"),
        (F.count_if(F.col("split").isNull()) == 0).alias("covers_population"))


@query("content_hash", """
SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_partkey":' || p_partkey ||
  ',"p_size":' || CASE WHEN p_size > 45 THEN 'null' ELSE p_size::VARCHAR END || ',"p_type":"' || p_type || '"}') AS record_hash FROM part""")
def content_hash(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_size") <= 45, F.col("p_size")))
    names = ("p_type", "p_size", "p_partkey", "p_name", "p_brand")
    return parts.select("p_partkey", identity.content_hash({n: F.col(n) for n in names}).alias("record_hash"))


def _sql_print(expression: str, view: str) -> str:
    lanes = ", ".join(f"sum(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(2))
    return (f"SELECT '{view}' AS view, count(*) AS records, sha256(concat_ws('|', count(*)::VARCHAR, {lanes})) AS fingerprint "
            f"FROM (SELECT sha256({expression}) AS d FROM orders)")


@query("fingerprint", "\nUNION ALL\n".join([
    _sql_print("o_orderkey::VARCHAR", "ids"), _sql_print("o_orderpriority", "labels"),
    _sql_print("concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)", "rows")]))
def fingerprint(spark, sf_dir):
    return profile.population_fingerprints(table(spark, sf_dir, "orders"), {
        "ids": ["o_orderkey"], "labels": ["o_orderpriority"],
        "rows": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]})


@query("row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def row_numbers(spark, sf_dir):
    return ranking.rank_by_number(table(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey")


@query("first_occurrence", f"""
SELECT l_partkey, min(l_orderkey) AS first_record, min({sql_split('l_orderkey')}) AS lowest_split, count(*) AS n_references
FROM lineitem GROUP BY l_partkey""")
def first_occurrence(spark, sf_dir):
    """First record that refers to each image, and one of its splits."""
    refs = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").withColumn("split", split_of("l_orderkey"))
    return refs.groupBy("l_partkey").agg(
        F.min("l_orderkey").alias("first_record"), F.min("split").alias("lowest_split"),
        F.count(F.lit(1)).alias("n_references"))


@query("feature_join", """
SELECT d.doc_id, n_chars, length(text) AS feature FROM documents d""")
def feature_join(spark, sf_dir):
    """Features joined to records by key; the job stops unless both sides match one to one."""
    records = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    features = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.char_length("text").cast("long").alias("feature"))
    return assert_one_to_one(records, features, "doc_id").select("doc_id", "n_chars", "feature")


@query("split_sizes", f"""
WITH s AS (SELECT {sql_split('o_orderkey')} AS split FROM orders), n AS (SELECT count(*) AS n FROM orders)
SELECT split, count(*) AS records, abs(count(*) * 100.0 / any_value(n) - CASE split WHEN 'train' THEN 80 ELSE 10 END) < 5 AS as_expected
FROM s, n GROUP BY split""")
def split_sizes(spark, sf_dir):
    """Records per split against the shares the split is made for."""
    expected = F.when(F.col("split") == "train", 80).otherwise(10)
    sizes = table(spark, sf_dir, "orders", "o_orderkey").groupBy(split_of("o_orderkey").alias("split")).agg(
        F.count(F.lit(1)).alias("records"))
    total = table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    return sizes.select("split", "records", (F.abs(F.col("records") * 100.0 / total - expected) < 5).alias("as_expected"))


@query("file_manifest")
def file_manifest(spark, sf_dir):
    return files.hash_manifest(spark, sf_dir, "*.parquet")


@query("manifest_drift")
def manifest_drift(spark, sf_dir):
    """Against a record in which one file's hash is out of date and one file is unknown."""
    manifest = files.hash_manifest(spark, sf_dir, "*.parquet")
    recorded = manifest.filter(F.col("relative_path") != "pages.parquet").withColumn(
        "sha256", F.when(F.col("relative_path") == "labels.parquet", F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return files.manifest_drift(manifest, recorded)


# ---------------------------------------------------------------- taxonomy


def customer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_nationkey", "n_regionkey",
        F.concat_ws(">", "n_regionkey", "c_nationkey", "c_custkey").alias("path"))


SQL_PATHS = """cp AS (SELECT c_custkey, c_nationkey, n_regionkey, n_regionkey || '>' || c_nationkey || '>' || c_custkey AS path
       FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("path_parse", f"""WITH {SQL_PATHS},
v AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN replace(path, '>', '>>') WHEN 1 THEN path || '>x' ELSE path END AS path FROM cp),
p AS (SELECT c_custkey, path, CASE WHEN c_custkey % 5 > 1 THEN string_split(path, '>') END AS nodes FROM v)
SELECT c_custkey, path, array_to_string(nodes, '/') AS nodes, len(nodes)::INTEGER AS depth, nodes[1] AS root, nodes[3] AS leaf,
       nodes IS NULL AS rejected FROM p""")
def path_parse(spark, sf_dir):
    case = F.col("c_custkey") % 5
    varied = customer_paths(spark, sf_dir).withColumn(
        "path", F.when(case == 0, F.replace("path", F.lit(">"), F.lit(">>"))).when(
            case == 1, F.concat("path", F.lit(">x"))).otherwise(F.col("path")))
    parsed = varied.select("c_custkey", "path", paths.path_parts(F.col("path")).alias("p"))
    rejected = F.col("p.category_path").isNull()
    return parsed.select(
        "c_custkey", "path", F.array_join("p.category_path", "/").alias("nodes"),
        F.when(~rejected, F.col("p.depth")).alias("depth"), F.col("p.root_category_id").alias("root"),
        F.col("p.leaf_category_id").alias("leaf"), rejected.alias("rejected"))


@query("path_errors", f"""WITH {SQL_PATHS},
v AS (SELECT c_custkey, path, c_custkey % 7 AS k FROM cp)
SELECT c_custkey, CASE k WHEN 0 THEN '' WHEN 1 THEN 'category_path_depth_mismatch,category_id_path_depth_mismatch'
  WHEN 2 THEN 'root_category_id_mismatch,root_category_id_path_mismatch' WHEN 3 THEN 'leaf_category_id_mismatch,leaf_category_id_path_mismatch'
  WHEN 4 THEN 'category_id_path_not_string' WHEN 5 THEN 'category_path_not_list' ELSE 'depth_not_integer' END AS errors FROM v""")
def path_errors(spark, sf_dir):
    case = F.col("c_custkey") % 7
    nodes = F.split("path", ">")
    broken = customer_paths(spark, sf_dir).select(
        "c_custkey",
        F.when(case != 4, F.col("path")).alias("path"),
        F.when(case != 5, nodes).alias("nodes"),
        F.when(case != 6, F.when(case == 1, 4).otherwise(3)).alias("depth"),
        F.when(case == 2, "none").otherwise(nodes[0]).alias("root"),
        F.when(case == 3, "none").otherwise(nodes[2]).alias("leaf"))
    errors = paths.path_errors(*[F.col(c) for c in ("path", "nodes", "depth", "root", "leaf")])
    return broken.select("c_custkey", F.array_join(errors, ",").alias("errors"))


SQL_NODES = f"""{SQL_PATHS},
nodes AS (SELECT DISTINCT n_regionkey::VARCHAR AS node_id, NULL::VARCHAR AS parent, 1 AS depth FROM cp
  UNION SELECT DISTINCT n_regionkey || '>' || c_nationkey, n_regionkey::VARCHAR, 2 FROM cp
  UNION SELECT DISTINCT path, n_regionkey || '>' || c_nationkey, 3 FROM cp)"""


@query("taxonomy_nodes", f"WITH {SQL_NODES} SELECT node_id, parent, depth FROM nodes")
def taxonomy_nodes(spark, sf_dir):
    return taxonomy.taxonomy_nodes(customer_paths(spark, sf_dir), "path")


@query("stage_repeats", """
WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 9 = 0),
a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 1 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 3
  UNION ALL SELECT o_orderkey, 'Y' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 <> 3 UNION ALL SELECT -1 - o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 20),
g AS (SELECT k, count(*) FILTER (b) AS nb, count(*) FILTER (NOT b) AS na, any_value(s) FILTER (b) AS sb, any_value(s) FILTER (NOT b) AS sa
  FROM (SELECT *, true AS b FROM b UNION ALL SELECT *, false FROM a) GROUP BY k)
SELECT CASE WHEN nb > 1 OR na > 1 THEN 'repeated' WHEN na = 0 THEN 'missing' WHEN nb = 0 THEN 'extra' WHEN sb <> sa THEN 'changed' ELSE 'equal' END AS status,
  count(*) AS keys, sum(k)::BIGINT AS key_sum FROM g GROUP BY 1""")
def stage_repeats(spark, sf_dir):
    """Two stages of which each has keys more than once: such a key is one row with a status of its own."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    before = orders.unionByName(orders.filter(key % 9 == 0))
    kept = orders.filter(key % 7 != 3)
    after = kept.withColumn("o_orderstatus", F.when(key % 5 == 1, "X").otherwise(F.col("o_orderstatus"))).unionByName(
        kept.filter(key % 11 == 0).withColumn("o_orderstatus", F.lit("Y"))).unionByName(
        orders.filter(key < 20).withColumn("o_orderkey", -1 - key))
    return audit.stage_diff(before, after, "o_orderkey", ["o_orderstatus"]).groupBy("status").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("o_orderkey").alias("key_sum"))


@query("taxonomy_checks", f"""WITH {SQL_NODES}
SELECT count(*) AS nodes, 0::BIGINT AS parent_depth_mismatch, 0::BIGINT AS wrong_depth, count(*) FILTER (depth = 1) AS roots FROM nodes""")
def taxonomy_checks(spark, sf_dir):
    return taxonomy.node_problems(taxonomy.taxonomy_nodes(customer_paths(spark, sf_dir), "path"))


@query("terminal_nodes", f"""WITH {SQL_NODES}
SELECT node_id, parent, depth FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent = n.node_id)""")
def terminal_nodes(spark, sf_dir):
    return taxonomy.terminal_nodes(taxonomy.taxonomy_nodes(customer_paths(spark, sf_dir), "path"))


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, with the path of their customer as the true category."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customers = customer_paths(spark, sf_dir).withColumnRenamed("c_custkey", "o_custkey")
    return lookup(orders, customers, ["o_custkey"], "inner").withColumn("split", split_of("o_orderkey"))


SQL_ORDER_PATHS = f"""{SQL_PATHS},
op AS (SELECT o_orderkey, o_custkey, c_nationkey, n_regionkey, path, {sql_split('o_orderkey')} AS split
       FROM orders JOIN cp ON o_custkey = c_custkey)"""


def guessed_paths(spark, sf_dir) -> DataFrame:
    """Orders with their true path and a guess that goes wrong at a level, by rule."""
    case = F.col("o_orderkey") % 4
    guess = (
        F.when(case == 0, F.col("path"))
        .when(case == 1, F.concat_ws(">", "n_regionkey", "c_nationkey", (F.col("o_custkey") + 1).cast("string")))
        .when(case == 2, F.concat_ws(">", "n_regionkey", (F.col("c_nationkey") + 1).cast("string"), "o_custkey"))
        .otherwise(F.concat_ws(">", (F.col("n_regionkey") + 1).cast("string"), "c_nationkey")))
    return order_paths(spark, sf_dir).select("o_orderkey", "split", "path", guess.alias("guess"))


@query("level_accuracy", f"""WITH {SQL_ORDER_PATHS},
g AS (SELECT string_split(path, '>') AS t, string_split(CASE o_orderkey % 4 WHEN 0 THEN path
        WHEN 1 THEN n_regionkey || '>' || c_nationkey || '>' || (c_custkey_next)
        WHEN 2 THEN n_regionkey || '>' || (c_nationkey + 1) || '>' || o_custkey
        ELSE (n_regionkey + 1) || '>' || c_nationkey END, '>') AS p
      FROM (SELECT *, o_custkey + 1 AS c_custkey_next FROM op)),
l AS (SELECT i AS level, t[i] = p[i] AS hit FROM g, (SELECT unnest([1, 2, 3]) AS i))
SELECT level::INTEGER AS level, count(*) AS total, count(*) FILTER (hit) AS correct, round(count(*) FILTER (hit) / count(*), 6) AS accuracy
FROM l GROUP BY level""")
def level_accuracy(spark, sf_dir):
    rows = guessed_paths(spark, sf_dir)
    return taxonomy.level_accuracy(rows, "path", "guess").select("level", "total", "correct", r6("accuracy"))


@query("hierarchical_f1", f"""WITH {SQL_ORDER_PATHS},
g AS (SELECT split, string_split(path, '>') AS t, CASE WHEN o_orderkey % 12 <> 5 THEN string_split(CASE o_orderkey % 4 WHEN 0 THEN path
        WHEN 1 THEN n_regionkey || '>' || c_nationkey || '>' || (o_custkey + 1) WHEN 2 THEN n_regionkey || '>' || (c_nationkey + 1) || '>' || o_custkey
        ELSE (n_regionkey + 1) || '>' || c_nationkey END, '>') END AS p FROM op),
s AS (SELECT split, len(t) AS d, coalesce(len(p), 0) AS g, p IS NOT NULL AS known,
        CASE WHEN p IS NULL OR t[1] <> p[1] THEN 0 WHEN t[2] <> p[2] OR len(p) < 2 THEN 1 WHEN len(p) < 3 OR t[3] <> p[3] THEN 2 ELSE 3 END AS c FROM g)
SELECT split, count(*) AS records, round(sum(c) / sum(g), 6) AS precision, round(sum(c) / sum(d), 6) AS recall, round(2 * sum(c) / (sum(g) + sum(d)), 6) AS f1,
  round(avg(d + g - 2 * c) FILTER (known), 6) AS mean_distance FROM s GROUP BY split""")
def hierarchical_f1(spark, sf_dir):
    """Ancestor sets and tree distance of guesses, some of which are missing."""
    rows = guessed_paths(spark, sf_dir).withColumn("guess", F.when(F.col("o_orderkey") % 12 != 5, F.col("guess")))
    found = taxonomy.hierarchical_metrics(rows, "path", "guess", ["split"])
    return found.select("split", "records", *[r6(c) for c in ("precision", "recall", "f1", "mean_distance")])


@query("unseen_children", f"""WITH {SQL_ORDER_PATHS},
e AS (SELECT split, n_regionkey::VARCHAR AS parent, c_nationkey::VARCHAR AS child FROM op UNION
      SELECT split, c_nationkey::VARCHAR, o_custkey::VARCHAR FROM op),
tr AS (SELECT DISTINCT parent, child FROM e WHERE split = 'train'), te AS (SELECT DISTINCT parent, child FROM e WHERE split = 'test')
SELECT parent, child FROM te WHERE parent IN (SELECT parent FROM tr) AND (parent, child) NOT IN (SELECT (parent, child) FROM tr)""")
def unseen_children(spark, sf_dir):
    rows = order_paths(spark, sf_dir)
    return taxonomy.unseen_children(
        rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test"), "path")


@query("unseen_paths", f"""WITH {SQL_ORDER_PATHS}
SELECT DISTINCT path FROM op WHERE split = 'test' EXCEPT SELECT DISTINCT path FROM op WHERE split = 'train'""")
def unseen_paths(spark, sf_dir):
    rows = order_paths(spark, sf_dir)
    return taxonomy.unseen_paths(
        rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test"), "path")


# Predictions over many classes: one order in three gets the next customer.
def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.col("o_orderkey") % 3 == 0
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_custkey").alias("truth"),
        F.when(wrong & (F.col("o_custkey") % 10 != 9), F.col("o_custkey") + 1)
        .when(wrong, F.col("o_custkey") - 9).otherwise(F.col("o_custkey")).alias("pred"))


SQL_PREDICTIONS = """pr AS (SELECT o_custkey AS t, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 10 <> 9 THEN o_custkey + 1
    WHEN o_orderkey % 3 = 0 THEN o_custkey - 9 ELSE o_custkey END AS q FROM orders),
k AS (SELECT c_custkey AS class, coalesce(sup, 0) AS support, coalesce(prd, 0) AS predicted, coalesce(hit, 0) AS correct FROM customer
      LEFT JOIN (SELECT t, count(*) AS sup, count(*) FILTER (t = q) AS hit FROM pr GROUP BY t) a ON t = c_custkey
      LEFT JOIN (SELECT q, count(*) AS prd FROM pr GROUP BY q) b ON q = c_custkey)"""


def customer_report(spark, sf_dir) -> DataFrame:
    classes = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("class"))
    return metrics.class_report(
        metrics.confusion(order_predictions(spark, sf_dir), "truth", "pred"), classes=classes)


@query("support_buckets", f"""WITH {SQL_PREDICTIONS},
b AS (SELECT *, CASE WHEN support = 0 THEN '0' WHEN support <= 5 THEN '1-5' WHEN support <= 10 THEN '6-10' WHEN support <= 25 THEN '11-25'
  WHEN support <= 50 THEN '26-50' WHEN support <= 100 THEN '51-100' WHEN support <= 500 THEN '101-500' ELSE '501+' END AS support_bucket FROM k)
SELECT support_bucket, count(*) AS classes, sum(support)::BIGINT AS records, sum(correct)::BIGINT AS correct,
       count(*) FILTER (predicted = 0) AS never_predicted, round(sum(correct) / nullif(sum(support), 0), 6) AS accuracy
FROM b GROUP BY 1""")
def support_buckets(spark, sf_dir):
    rows = metrics.accuracy_by_support(customer_report(spark, sf_dir))
    return rows.select("support_bucket", "classes", "records", "correct", "never_predicted", r6("accuracy"))


@query("silent_classes", f"""WITH {SQL_PREDICTIONS.replace("FROM orders)", "FROM orders WHERE o_custkey % 11 NOT IN (3, 4))")}
SELECT class, CASE WHEN support = 0 AND predicted = 0 THEN 'zero_support_zero_prediction' WHEN support = 0 THEN 'zero_support'
  ELSE 'zero_prediction' END AS kind FROM k WHERE support = 0 OR predicted = 0""")
def silent_classes(spark, sf_dir):
    """Classes without records or predictions; some customers' orders are left out, so that there are any."""
    rows = order_predictions(spark, sf_dir).filter(~(F.col("truth") % 11).isin(3, 4))
    classes = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("class"))
    report = metrics.class_report(metrics.confusion(rows, "truth", "pred"), classes=classes)
    none, never = F.col("support") == 0, F.col("predicted") == 0
    return report.filter(none | never).select(
        "class", F.when(none & never, "zero_support_zero_prediction").when(none, "zero_support")
        .otherwise("zero_prediction").alias("kind"))


@query("weakest_classes", f"""WITH {SQL_PREDICTIONS}
SELECT class, support, round(CASE WHEN support + predicted > 0 THEN 2 * correct / (support + predicted) ELSE 0 END, 6) AS f1
FROM k ORDER BY round(CASE WHEN support + predicted > 0 THEN 2 * correct / (support + predicted) ELSE 0 END, 12), support DESC, class LIMIT 50""")
def weakest_classes(spark, sf_dir):
    return customer_report(spark, sf_dir).orderBy(
        F.round("f1", 12), F.col("support").desc(), "class").limit(50).select("class", "support", r6("f1"))


@query("largest_classes", f"""WITH {SQL_PREDICTIONS}
SELECT class, support, correct FROM k ORDER BY support DESC, class LIMIT 50""")
def largest_classes(spark, sf_dir):
    return customer_report(spark, sf_dir).orderBy(F.col("support").desc(), "class").limit(50).select(
        "class", "support", "correct")


# ---------------------------------------------------------------- labels

RAW_LABEL_CASES = 13


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with its type written in one of thirteen raw forms."""
    case = F.col("p_partkey") % RAW_LABEL_CASES

    def wrap(before: str, after: str):
        return F.concat(F.lit(before), F.col("p_type"), F.lit(after))

    raw = (
        F.when(case == 0, wrap('[{"value": "  ', ' "}]'))
        .when(case == 1, wrap('[{"value":"', '"}]'))
        .when(case == 2, wrap('[{"value":"', '"},{"value":"Y"}]'))
        .when(case == 3, wrap('"', '"'))
        .when(case == 4, wrap('{"value":"', '"}'))
        .when(case == 5, F.lit("[]"))
        .when(case == 6, wrap('[{"value":"', '","language_tag":"en"}]'))
        .when(case == 7, wrap('["', '"]'))
        .when(case == 8, F.lit('[{"value":7}]'))
        .when(case == 9, F.lit('[{"value":"   "}]'))
        .when(case == 10, F.lit("null"))
        .when(case == 11, F.col("p_type"))
        .otherwise(wrap('"[{\\"value\\": \\"', '\\"}]"')))
    return table(spark, sf_dir, "part", "p_partkey", "p_type").withColumn("raw", raw)


@query("label_canonical", """
SELECT p_partkey, CASE WHEN p_partkey % 13 IN (0, 1) THEN p_type END AS strict_value,
  CASE p_partkey % 13 WHEN 0 THEN 'list_dict_value' WHEN 1 THEN 'list_dict_value' WHEN 2 THEN 'list_length_not_one'
    WHEN 5 THEN 'list_length_not_one' WHEN 6 THEN 'unexpected_dict_keys' WHEN 7 THEN 'list_item_not_dict'
    WHEN 8 THEN 'value_not_string' WHEN 9 THEN 'empty_value' ELSE 'not_list' END AS strict_method,
  CASE WHEN p_partkey % 13 IN (0, 1, 3, 4, 6, 11, 12) THEN p_type END AS lenient_value FROM part""")
def label_canonical(spark, sf_dir):
    rows = raw_labels(spark, sf_dir).select(
        "p_partkey", labels.strict_label(F.col("raw")).alias("s"), labels.lenient_label(F.col("raw")).alias("lenient_value"))
    return rows.select("p_partkey", F.col("s.value").alias("strict_value"),
                       F.col("s.method").alias("strict_method"), "lenient_value")


@query("label_presence", """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'null' WHEN 2 THEN 'unparseable' ELSE 'present' END AS kind,
       count(*) AS n FROM part GROUP BY 1""")
def label_presence(spark, sf_dir):
    """Absent, null and unparseable labels are counted apart."""
    case = F.col("p_partkey") % 4
    raw = (F.when(case == 0, F.lit('{"item":1}')).when(case == 1, F.lit('{"product_type":null}'))
           .when(case == 2, F.concat(F.lit('{"product_type":'), "p_type"))
           .otherwise(F.concat(F.lit('{"product_type":"'), "p_type", F.lit('"}'))))
    rows = table(spark, sf_dir, "part", "p_partkey", "p_type").select(
        labels.presence_kind(raw, "product_type").alias("kind"))
    return audit.histogram(rows, "kind")


@query("first_values", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type END AS label FROM part""")
def first_values(spark, sf_dir):
    """First usable entry of a value list, null when there is none."""
    case = F.col("p_partkey") % 3
    items = F.array(
        F.struct(F.lit("  ").alias("value")), F.struct(F.lit(None).cast("string").alias("value")),
        F.struct(F.when(case == 0, F.concat(F.lit(" "), "p_brand")).otherwise("").alias("value")),
        F.struct(F.when(case <= 1, F.col("p_type")).alias("value")))
    return table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").select(
        "p_partkey", labels.first_value(items).alias("label"))


@query("label_match", """
WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) ELSE '  ' || p_brand || ' ' END AS label FROM part),
c AS (SELECT DISTINCT p_brand AS label FROM part)
SELECT count(*) AS records, count(*) FILTER (label IN (SELECT label FROM c)) AS exact_matches,
       count(*) FILTER (lower(trim(label)) IN (SELECT lower(label) FROM c)) AS folded_matches FROM r""")
def label_match(spark, sf_dir):
    parts = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    case = F.col("p_partkey") % 3
    label = F.when(case == 0, F.col("p_brand")).when(case == 1, F.upper("p_brand")).otherwise(
        F.concat(F.lit("  "), "p_brand", F.lit(" ")))
    rows = parts.select(label.alias("label")).withColumn("folded", labels.fold_label(F.col("label")))
    brands = parts.select(F.col("p_brand").alias("label")).distinct()
    exact = brands.select("label", F.lit(True).alias("exact"))
    folded = brands.select(labels.fold_label(F.col("label")).alias("folded")).distinct().withColumn("close", F.lit(True))
    # Labels are counted first, so the lookups meet one row per distinct label.
    counted = rows.groupBy("label", "folded").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(exact, "label", "left").join(folded, "folded", "left")
    return joined.agg(
        F.sum("n").alias("records"),
        F.sum(F.when(F.col("exact"), F.col("n")).otherwise(0)).alias("exact_matches"),
        F.sum(F.when(F.col("close"), F.col("n")).otherwise(0)).alias("folded_matches"))


def class_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a fine-grained class label and their split."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_retailprice",
        F.concat_ws("/", "p_brand", "p_type", "p_size").alias("label"), split_of("p_partkey").alias("split"))


SQL_CLASSES = f"""cr AS (SELECT p_partkey, p_size, p_retailprice, p_brand || '/' || p_type || '/' || p_size AS label,
  {sql_split('p_partkey')} AS split FROM part)"""
SPLITS = ("train", "validation", "test")


@query("class_universe", f"""WITH {SQL_CLASSES}
SELECT label, count(*) AS total, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'validation') AS validation_count,
       count(*) FILTER (split = 'test') AS test_count, count(*) FILTER (split = 'train') = 0 AS unseen_in_train FROM cr GROUP BY label""")
def class_universe(spark, sf_dir):
    return audit.class_universe(class_records(spark, sf_dir), "label", "split", SPLITS)


@query("class_sets", f"""WITH {SQL_CLASSES},
a AS (SELECT DISTINCT label FROM cr WHERE split = 'train'), b AS (SELECT DISTINCT label FROM cr WHERE split <> 'train')
SELECT (SELECT count(*) FROM a) AS train_classes, (SELECT count(*) FROM b) AS other_classes,
  (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS train_only,
  (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS unseen,
  true AS sizes_add_up, true AS union_is_universe""")
def class_sets(spark, sf_dir):
    rows = class_records(spark, sf_dir)
    a = rows.filter(F.col("split") == "train").select("label").distinct()
    b = rows.filter(F.col("split") != "train").select("label").distinct()
    universe = rows.select("label").distinct()
    united = a.unionByName(b).distinct()

    def tagged(name, frame):
        return frame.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))

    sizes = tagged("a", a).unionByName(tagged("b", b)).unionByName(tagged("shared", a.intersect(b))).unionByName(
        tagged("a_only", a.subtract(b))).unionByName(tagged("b_only", b.subtract(a))).unionByName(
        tagged("drift", united.exceptAll(universe).unionByName(universe.exceptAll(united))))
    wide = sizes.groupBy().pivot("part", ["a", "b", "shared", "a_only", "b_only", "drift"]).agg(F.first("n"))
    return wide.select(
        F.col("a").alias("train_classes"), F.col("b").alias("other_classes"), "shared",
        F.col("a_only").alias("train_only"), F.col("b_only").alias("unseen"),
        ((F.col("shared") + F.col("a_only") == F.col("a")) & (F.col("shared") + F.col("b_only") == F.col("b"))).alias("sizes_add_up"),
        (F.col("drift") == 0).alias("union_is_universe"))


@query("label_encoding", f"""WITH {SQL_CLASSES},
c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS class_id FROM (SELECT DISTINCT label FROM cr WHERE split = 'train'))
SELECT p_partkey, cr.label, class_id::INTEGER AS class_id, class_id IS NOT NULL AS known FROM cr LEFT JOIN c USING (label) WHERE split <> 'train'""")
def label_encoding(spark, sf_dir):
    rows = class_records(spark, sf_dir)
    classes = audit.class_table(rows.filter(F.col("split") == "train"), "label")
    return audit.encode_labels(rows.filter(F.col("split") != "train"), "label", classes).select(
        "p_partkey", "label", "class_id", "known")


SQL_ADMISSIBLE = f"""{SQL_CLASSES},
u AS (SELECT label, count(*) AS total, count(*) FILTER (split = 'train') AS train_count,
        count(*) FILTER (split = 'train' AND p_size <= 40) AS in_train_list,
        count(*) FILTER (split = 'validation' AND p_size <= 10) AS in_validation_list,
        count(*) FILTER (split = 'test' AND p_size % 5 = 0) AS in_test_list FROM cr GROUP BY label),
adm AS (SELECT *, CASE WHEN train_count = 0 THEN 'PASS' ELSE 'FAIL' END AS training_exclusion,
   CASE WHEN train_count > 0 THEN 'FAIL' WHEN in_train_list + in_validation_list + in_test_list = 0 THEN 'PASS' ELSE 'FAIL' END AS model_selection_exclusion,
   CASE WHEN train_count > 0 THEN 'FAIL' WHEN total % 3 <> 0 THEN 'PASS' ELSE 'NOT_ESTABLISHED' END AS downstream_exclusion,
   CASE WHEN in_test_list = 0 THEN 'PASS' ELSE 'FAIL' END AS test_isolation,
   CASE WHEN train_count > 0 THEN 'INADMISSIBLE' WHEN in_train_list + in_validation_list + in_test_list = 0 AND total % 3 <> 0 THEN 'ADMISSIBLE' ELSE 'NOT_ESTABLISHED' END AS admissibility
 FROM u)"""


def admissible(spark, sf_dir) -> DataFrame:
    """Classes with their overlap with the id lists of earlier stages, and the decision."""
    rows = class_records(spark, sf_dir)
    lists = {
        "in_train_list": rows.filter((F.col("split") == "train") & (F.col("p_size") <= 40)),
        "in_validation_list": rows.filter((F.col("split") == "validation") & (F.col("p_size") <= 10)),
        "in_test_list": rows.filter((F.col("split") == "test") & (F.col("p_size") % 5 == 0))}
    flagged = rows.select("p_partkey", "label", "split")
    for name, ids in lists.items():
        flagged = flagged.join(ids.select("p_partkey", F.lit(1).alias(name)), "p_partkey", "left")
    per_class = flagged.groupBy("label").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("split") == "train").alias("train_count"),
        *[F.count(name).alias(name) for name in lists])
    return audit.admissibility(
        per_class, F.col("train_count"), [F.col("in_train_list"), F.col("in_validation_list")],
        F.col("in_test_list"), F.col("total") % 3 != 0, F.lit(True))


@query("admissibility", f"WITH {SQL_ADMISSIBLE} SELECT * FROM adm")
def admissibility(spark, sf_dir):
    return admissible(spark, sf_dir)


@query("admissibility_totals", f"""WITH {SQL_ADMISSIBLE}
SELECT admissibility, count(*) AS classes, sum(total)::BIGINT AS records FROM adm GROUP BY 1""")
def admissibility_totals(spark, sf_dir):
    return admissible(spark, sf_dir).groupBy("admissibility").agg(
        F.count(F.lit(1)).alias("classes"), F.sum("total").alias("records"))


@query("split_names", """
WITH v AS (SELECT CASE event_type WHEN 'click' THEN 'train' WHEN 'view' THEN 'val' WHEN 'error' THEN 'dev' WHEN 'signup' THEN 'test' ELSE 'holdout' END AS name FROM events)
SELECT name, CASE name WHEN 'val' THEN 'validation' WHEN 'dev' THEN 'validation' WHEN 'holdout' THEN NULL ELSE name END AS split, count(*) AS n
FROM v GROUP BY ALL""")
def split_names(spark, sf_dir):
    name = (F.when(F.col("event_type") == "click", "train").when(F.col("event_type") == "view", "val")
            .when(F.col("event_type") == "error", "dev").when(F.col("event_type") == "signup", "test").otherwise("holdout"))
    rows = table(spark, sf_dir, "events", "event_type").select(name.alias("name"))
    return rows.withColumn("split", labels.split_name(F.col("name"))).groupBy("name", "split").agg(
        F.count(F.lit(1)).alias("n"))


@query("supervision", """
WITH s AS (SELECT o_orderkey % 2 = 0 AS c, o_orderkey % 3 = 0 AS a, o_orderstatus = 'F' AS i FROM orders)
SELECT CASE WHEN c AND a THEN 'category_and_attributes' WHEN c THEN 'category_only' WHEN a THEN 'attributes_only'
            WHEN i THEN 'information_only' ELSE 'none' END AS supervision_type, count(*) AS n,
       count(*) FILTER (c OR a) AS label_available, count(*) FILTER (i) AS information_available FROM s GROUP BY 1""")
def supervision(spark, sf_dir):
    flags = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(
        (F.col("o_orderkey") % 2 == 0).alias("c"), (F.col("o_orderkey") % 3 == 0).alias("a"),
        (F.col("o_orderstatus") == "F").alias("i"))
    kind = labels.supervision_type(F.col("c"), F.col("a"), F.col("i"))
    block = F.struct((F.col("c") | F.col("a")).alias("label_available"), F.col("i").alias("information_available"))
    return flags.select(kind.alias("supervision_type"), block.alias("s")).groupBy("supervision_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("s.label_available").alias("label_available"),
        F.count_if("s.information_available").alias("information_available"))


# ---------------------------------------------------------------- splits over shared images


def line_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    refs = lines.select("l_orderkey", F.concat_ws("-", "l_partkey", "l_suppkey").alias("image"))
    return table(spark, sf_dir, "orders", F.col("o_orderkey").alias("l_orderkey")), refs


SQL_COMPONENTS = """
RECURSIVE refs AS (SELECT DISTINCT l_orderkey AS r, l_partkey || '-' || l_suppkey AS i FROM lineitem),
star AS (SELECT r, min(r) OVER (PARTITION BY i) AS m FROM refs),
pairs AS (SELECT DISTINCT r AS a, m AS b FROM star WHERE r <> m UNION SELECT DISTINCT m, r FROM star WHERE r <> m),
walk(r, c) USING KEY (r) AS (
  SELECT o_orderkey AS r, o_orderkey AS c FROM orders
  UNION
  SELECT p.b, min(w.c) FROM walk w JOIN pairs p ON p.a = w.r JOIN recurring.walk cur ON cur.r = p.b
  WHERE w.c < cur.c GROUP BY p.b),
comp AS (SELECT r AS l_orderkey, c AS component FROM walk)"""


@query("component_split", f"""WITH {SQL_COMPONENTS},
digests AS (SELECT component, sha256(l_orderkey::VARCHAR) AS d FROM comp),
keyed AS (SELECT component, count(*) AS size, 'component|' || sha256(concat_ws('|', count(*)::VARCHAR,
            sum(('0x' || substr(d, 1, 15))::BIGINT)::VARCHAR, sum(('0x' || substr(d, 16, 15))::BIGINT)::VARCHAR)) AS k
          FROM digests GROUP BY component)
SELECT l_orderkey, component, size, {sql_split('k')} AS split FROM comp JOIN keyed USING (component)""")
def component_split(spark, sf_dir):
    records, refs = line_references(spark, sf_dir)
    return components.component_split(records, refs, "l_orderkey", "image")


@query("component_sizes", f"""WITH {SQL_COMPONENTS}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY 1)
SELECT size, count(*) AS components FROM s GROUP BY size""")
def component_sizes(spark, sf_dir):
    records, refs = line_references(spark, sf_dir)
    members = components.connected_components(records, refs, "l_orderkey", "image")
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(
        F.count(F.lit(1)).alias("components"))


def split_references(spark, sf_dir) -> DataFrame:
    _, refs = line_references(spark, sf_dir)
    return refs.withColumn("split", split_of("l_orderkey"))


SQL_SPLIT_REFS = f"sr AS (SELECT l_partkey || '-' || l_suppkey AS image, {sql_split('l_orderkey')} AS split FROM lineitem)"


@query("leakage", f"""WITH {SQL_SPLIT_REFS}, k AS (SELECT image, count(DISTINCT split) AS s, count(*) AS n FROM sr GROUP BY image)
SELECT count(*) AS keys, count(*) FILTER (s > 1) AS keys_in_two_splits, sum(n)::BIGINT AS "rows", sum(n - s)::BIGINT AS repeats_within FROM k""")
def leakage(spark, sf_dir):
    per_key = components.leaking_keys(split_references(spark, sf_dir), "image")
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n_splits") > 1).alias("keys_in_two_splits"),
        F.sum("n_rows").alias("rows"), F.sum("n_repeats_within").alias("repeats_within"))


@query("split_overlap", f"""WITH {SQL_SPLIT_REFS}, d AS (SELECT DISTINCT image, split FROM sr)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared_keys, min(a.image) AS first_example
FROM d a JOIN d b ON a.image = b.image AND a.split < b.split GROUP BY ALL""")
def split_overlap(spark, sf_dir):
    return components.split_overlap(split_references(spark, sf_dir), "image")


@query("component_leakage", """
SELECT 0::BIGINT AS images_in_two_splits, count(*) AS records_placed FROM orders""")
def component_leakage(spark, sf_dir):
    """Splitting by component leaves no image on two sides."""
    records, refs = line_references(spark, sf_dir)
    placed = components.component_split(records, refs, "l_orderkey", "image").select("l_orderkey", "split")
    placed = cut_lineage(placed, "component-split")
    per_image = components.leaking_keys(join_spread(refs, placed, ["l_orderkey"], "inner"), "image")
    leaking = per_image.agg(F.count_if(F.col("n_splits") > 1).alias("images_in_two_splits"))
    return leaking.withColumn("records_placed", placed.agg(F.count(F.lit(1))).scalar())


# ---------------------------------------------------------------- images


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image metadata from the parts: older rows repeat every id with another size."""
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_retailprice").filter(F.col("p_size") <= 40)
    current = parts.select(
        F.col("p_partkey").alias("image_id"), F.concat("p_name", F.lit(".jpg")).alias("relative_path"),
        F.col("p_size").alias("height"), (F.col("p_partkey") % 7 != 0).alias("physical_file_available"),
        F.lit(1).alias("row_order"))
    older = current.withColumn("height", F.lit(-1)).withColumn("row_order", F.lit(0))
    return images.last_per_key(
        current.unionByName(older), "image_id", F.col("row_order"),
        ["relative_path", "height", "physical_file_available"])


def attached(spark, sf_dir) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("position"), F.col("l_partkey").alias("image_id"), "l_suppkey")
    return images.attach_inventory(refs, inventory(spark, sf_dir))


SQL_ATTACHED = """att AS (SELECT l_orderkey, l_linenumber - 1 AS position, l_partkey AS image_id, l_suppkey,
  p_name || '.jpg' AS relative_path, p_size AS height, p_partkey % 7 <> 0 AS physical_file_available, p_partkey IS NOT NULL AS metadata_available
  FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON l_partkey = p_partkey)"""


@query("lookup_join", f"""WITH {SQL_ATTACHED}
SELECT l_orderkey, position, image_id, l_suppkey, metadata_available, coalesce(physical_file_available, false) AS physical_file_available,
       relative_path, height, height * 2 AS width FROM att""")
def lookup_join(spark, sf_dir):
    rows = attached(spark, sf_dir)
    ref = images.image_reference(
        F.col("image_id").cast("string"), F.col("metadata_available"), F.col("physical_file_available"),
        F.col("relative_path"), F.col("height"), F.col("height") * 2)
    return rows.select("l_orderkey", "position", "image_id", "l_suppkey", ref.alias("r")).select(
        "l_orderkey", "position", "image_id", "l_suppkey", "r.metadata_available", "r.physical_file_available",
        "r.relative_path", "r.height", "r.width")


@query("image_counts", f"""WITH {SQL_ATTACHED}
SELECT l_orderkey, count(*) AS referenced, count(*) FILTER (physical_file_available) AS available,
       count(*) FILTER (NOT coalesce(physical_file_available, false)) AS missing, bool_or(position = 0) AS has_main,
       bool_or(position = 0 AND coalesce(physical_file_available, false)) AS main_available FROM att GROUP BY l_orderkey""")
def image_counts(spark, sf_dir):
    return images.image_counts(attached(spark, sf_dir), "l_orderkey", "physical_file_available")


@query("reference_audit", """
WITH r AS (SELECT DISTINCT l_partkey AS id FROM lineitem), i AS (SELECT p_partkey AS id FROM part WHERE p_size <= 40)
SELECT CASE WHEN i.id IS NULL THEN 'referenced_without_metadata' WHEN r.id IS NULL THEN 'never_referenced' ELSE 'referenced_with_metadata' END AS status,
       count(*) AS ids, min(coalesce(r.id, i.id)) AS first_example FROM r FULL JOIN i ON r.id = i.id GROUP BY 1""")
def reference_audit(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem", F.col("l_partkey").alias("image_id"))
    rows = images.reference_audit(refs, inventory(spark, sf_dir))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("ids"), F.min("image_id").alias("first_example"))


@query("reference_examples", """
WITH r AS (SELECT DISTINCT l_partkey AS id FROM lineitem), i AS (SELECT p_partkey AS id FROM part WHERE p_size <= 40),
s AS (SELECT CASE WHEN i.id IS NULL THEN 'referenced_without_metadata' WHEN r.id IS NULL THEN 'never_referenced' ELSE 'referenced_with_metadata' END AS status,
       coalesce(r.id, i.id) AS image_id FROM r FULL JOIN i ON r.id = i.id)
SELECT status, image_id FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY image_id) AS rn FROM s) WHERE rn <= 20""")
def reference_examples(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem", F.col("l_partkey").alias("image_id"))
    rows = images.reference_audit(refs, inventory(spark, sf_dir))
    return ranking.first_examples(rows, ["status"], ["image_id"], 20).select("status", "image_id")


@query("image_paths", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') AS raw FROM pages),
v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(substr(raw, 2), '/', '\') || '.jpg' WHEN 1 THEN '../' || substr(raw, 2) || '.jpg'
        WHEN 2 THEN raw || '.PNG' WHEN 3 THEN ' ' || substr(raw, 2) || '.JPEG ' ELSE substr(raw, 2) || '.gif' END AS path FROM p),
n AS (SELECT page_id, replace(trim(path), '\', '/') AS path FROM v),
s AS (SELECT page_id, CASE WHEN path <> '' AND NOT regexp_matches(path, '(^|/)\.\.(/|$)') AND NOT starts_with(path, '/') THEN path END AS safe_path FROM n)
SELECT page_id, safe_path, coalesce(regexp_matches(safe_path, '(?i)\.(jpg|jpeg|png)$'), false) AS usable FROM s""")
def image_paths(spark, sf_dir):
    raw = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+", ""), r"[?#].*$", "")
    inner = F.substr(F.col("raw"), F.lit(2))
    case = F.col("page_id") % 5
    path = (F.when(case == 0, F.concat(F.replace(inner, F.lit("/"), F.lit("\\")), F.lit(".jpg")))
            .when(case == 1, F.concat(F.lit("../"), inner, F.lit(".jpg")))
            .when(case == 2, F.concat("raw", F.lit(".PNG")))
            .when(case == 3, F.concat(F.lit(" "), inner, F.lit(".JPEG ")))
            .otherwise(F.concat(inner, F.lit(".gif"))))
    safe = table(spark, sf_dir, "pages", "page_id", "url").withColumn("raw", raw).select(
        "page_id", paths.relative_path(path).alias("safe_path"))
    return safe.select("page_id", "safe_path",
                       F.coalesce(paths.has_image_extension(F.col("safe_path")), F.lit(False)).alias("usable"))


@query("url_counts", """
WITH u AS (SELECT page_id, len(regexp_extract_all(html, 'href="[^"]*"'))::INTEGER AS a, len(regexp_extract_all(html, 'src="[^"]*"'))::INTEGER AS b FROM pages)
SELECT page_id, a AS link_references, b AS image_references, a > 0 AS has_link_reference, b > 0 AS has_image_reference FROM u""")
def url_counts(spark, sf_dir):
    found = table(spark, sf_dir, "pages", "page_id", "html").select(
        "page_id",
        F.size(F.regexp_extract_all("html", F.lit('href="[^"]*"'), F.lit(0))).alias("link_references"),
        F.size(F.regexp_extract_all("html", F.lit('src="[^"]*"'), F.lit(0))).alias("image_references"))
    return found.select("*", (F.col("link_references") > 0).alias("has_link_reference"),
                        (F.col("image_references") > 0).alias("has_image_reference"))


# ---------------------------------------------------------------- audits


def second_stage(spark, sf_dir) -> DataFrame:
    """Orders after a faulty stage: some rows lost, some changed, some added."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    kept = orders.filter(F.col("o_orderkey") % 101 != 0).withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus"))
    ).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 89 != 0, F.col("o_orderpriority")))
    extra = orders.filter(F.col("o_orderkey") % 103 == 0).withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return kept.unionByName(extra)


SQL_STAGES = """a AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderpriority FROM orders),
b AS (SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
             CASE WHEN o_orderkey % 89 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 101 <> 0
      UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 103 = 0),
j AS (SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra'
        WHEN a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
          OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'changed' ELSE 'equal' END AS status,
        CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN array_to_string(list_filter([
          CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey' END,
          CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
          CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') END AS changed_columns
      FROM a FULL JOIN b ON a.k = b.k)"""
STAGE_COLUMNS = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query("stage_diff", f"WITH {SQL_STAGES} SELECT status, changed_columns, count(*) AS n, min(o_orderkey) AS first_key FROM j GROUP BY ALL")
def stage_diff(spark, sf_dir):
    rows = audit.stage_diff(table(spark, sf_dir, "orders"), second_stage(spark, sf_dir), "o_orderkey", STAGE_COLUMNS)
    return rows.groupBy("status", F.array_join("changed_columns", ",").alias("changed_columns")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


def stage_counters(df: DataFrame) -> DataFrame:
    return audit.counters(df, {
        "status_f": F.col("o_orderstatus") == "F", "no_priority": F.col("o_orderpriority").isNull(),
        "low_customer": F.col("o_custkey") < 10}).withColumnRenamed("counter", "metric")


@query("metric_drift", f"""WITH {SQL_STAGES},
sa AS (SELECT 'records' AS metric, count(*)::DOUBLE AS v FROM a UNION ALL SELECT 'status_f', count(*) FILTER (o_orderstatus = 'F') FROM a
  UNION ALL SELECT 'no_priority', count(*) FILTER (o_orderpriority IS NULL) FROM a UNION ALL SELECT 'low_customer', count(*) FILTER (o_custkey < 10) FROM a),
sb AS (SELECT 'records' AS metric, count(*)::DOUBLE AS v FROM b UNION ALL SELECT 'status_f', count(*) FILTER (o_orderstatus = 'F') FROM b
  UNION ALL SELECT 'no_priority', count(*) FILTER (o_orderpriority IS NULL) FROM b UNION ALL SELECT 'low_customer', count(*) FILTER (o_custkey < 10) FROM b)
SELECT metric, sa.v AS stored, sb.v AS recomputed, sa.v = sb.v AS passed FROM sa JOIN sb USING (metric)""")
def metric_drift(spark, sf_dir):
    return audit.metric_drift(
        stage_counters(table(spark, sf_dir, "orders")), stage_counters(second_stage(spark, sf_dir)))


@query("metric_recheck", """
SELECT o_orderstatus AS metric, round(avg(o_totalprice), 4) AS stored, true AS passed FROM orders GROUP BY 1""")
def metric_recheck(spark, sf_dir):
    """A stored mean against sum over count, within a tolerance."""
    orders = table(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice")
    stored = orders.groupBy(F.col("o_orderstatus").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    again = orders.groupBy(F.col("o_orderstatus").alias("metric")).agg(
        (F.sum("o_totalprice") / F.count("o_totalprice")).alias("value"))
    return audit.metric_drift(stored, again, 1e-6).select("metric", F.round("stored", 4).alias("stored"), "passed")


def traced(spark, sf_dir) -> DataFrame:
    """Labelled documents followed back through two earlier stages of their texts."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    targets = table(spark, sf_dir, "labels", "doc_id").withColumn("split", split_of("doc_id")).withColumn(
        "usable", F.col("doc_id") % 23 != 0)
    has_text = text.text_available([F.when(F.col("doc_id") % 31 != 0, F.col("text"))])
    canonical = docs.filter(F.col("doc_id") % 41 != 0).select(
        "doc_id", F.col("lang").alias("origin"), has_text.alias("has_text"))
    processed = docs.filter(F.col("doc_id") % 37 != 0).select(
        "doc_id", F.when(F.col("doc_id") % 43 == 0, "moved").otherwise(split_of("doc_id")).alias("split"),
        (has_text & (F.col("doc_id") % 29 != 0)).alias("has_text"))
    return audit.trace(targets, "doc_id", {"canonical": canonical, "processed": processed})


SQL_TRACED = rf"""tr AS (SELECT l.doc_id, {sql_split('l.doc_id')} AS split, l.doc_id % 23 <> 0 AS usable, d.doc_id IS NOT NULL AND l.doc_id % 41 <> 0 AS in_c,
  d.doc_id IS NOT NULL AND l.doc_id % 37 <> 0 AS in_p, CASE WHEN l.doc_id % 43 = 0 THEN 'moved' ELSE {sql_split('l.doc_id')} END AS p_split,
  lang AS origin, l.doc_id % 31 <> 0 AND regexp_matches(text, '[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]') AS c_text FROM labels l LEFT JOIN documents d USING (doc_id)),
tc AS (SELECT doc_id, CASE WHEN NOT in_c THEN 'MISSING_FROM_CANONICAL' WHEN NOT in_p THEN 'MISSING_FROM_B2' WHEN split <> p_split THEN 'SPLIT_MISMATCH'
  WHEN origin <> 'en' THEN 'LABEL_NOT_FROM_EXPECTED_FALLBACK_SOURCE' WHEN NOT c_text THEN 'LABEL_WITHOUT_CANONICAL_APPROVED_TEXT'
  WHEN NOT (c_text AND doc_id % 29 <> 0) THEN 'INPUT_LOST_OR_ABSENT_AT_B2' WHEN NOT usable THEN 'INPUT_LOST_AT_B3' ELSE 'LABEL_AND_INPUT_ALIGNED' END AS trace_class,
  CASE WHEN NOT in_c THEN 'MISSING_CANONICAL_RECORD' WHEN NOT in_p THEN 'MISSING_B2_RECORD'
  WHEN NOT c_text THEN 'SOURCE_AND_B2_NO_APPROVED_TEXT' WHEN doc_id % 29 = 0 THEN 'TEXT_LOST_DURING_B2_PROCESSING'
  ELSE 'TEXT_AVAILABLE_FOR_FURTHER_INTERFACE_REVIEW' END AS text_loss FROM tr)"""


def trace_classes(spark, sf_dir) -> DataFrame:
    c = F.col
    canonical_text = F.coalesce(c("canonical_has_text"), F.lit(False))
    processed_text = F.coalesce(c("processed_has_text"), F.lit(False))
    return traced(spark, sf_dir).select(
        "doc_id",
        audit.trace_class(
            c("in_canonical"), c("in_processed"), c("split") == c("processed_split"), c("canonical_origin") == "en",
            canonical_text, processed_text, c("usable")).alias("trace_class"),
        audit.text_loss_class(c("in_canonical"), c("in_processed"), canonical_text, processed_text).alias("text_loss"))


@query("trace", f"WITH {SQL_TRACED} SELECT doc_id, trace_class, text_loss FROM tc")
def trace(spark, sf_dir):
    return trace_classes(spark, sf_dir)


@query("trace_counts", f"WITH {SQL_TRACED} SELECT trace_class, count(*) AS n FROM tc GROUP BY 1")
def trace_counts(spark, sf_dir):
    return audit.histogram(trace_classes(spark, sf_dir), "trace_class")


@query("target_status", """
WITH s AS (SELECT quality = 1 AS c, toxic = 1 AS a, text IS NOT NULL AND text <> '' AS t FROM labels LEFT JOIN documents USING (doc_id)),
n AS (SELECT count(*) FILTER (c OR a) AS candidates, count(*) FILTER ((c OR a) AND t) AS with_text, count(*) FILTER (c) AS categories, count(*) FILTER (a) AS attributes FROM s)
SELECT *, CASE WHEN candidates = 0 THEN 'BLOCKED_NO_EXPLICIT_SUPERVISION' WHEN with_text = 0 THEN 'BLOCKED_NO_USABLE_B3_INPUT'
  WHEN categories > 0 AND attributes > 0 THEN 'BLOCKED_TARGET_AMBIGUITY' ELSE 'ELIGIBLE_FOR_TARGET_CONFIRMATION' END AS status FROM n""")
def target_status(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "left")
    category, attribute = F.col("quality") == 1, F.col("toxic") == 1
    with_text = F.coalesce(F.col("text") != "", F.lit(False))
    totals = rows.agg(
        F.count_if(category | attribute).alias("candidates"),
        F.count_if((category | attribute) & with_text).alias("with_text"),
        F.count_if(category).alias("categories"), F.count_if(attribute).alias("attributes"))
    return totals.withColumn("status", audit.target_status(
        *[F.col(c) for c in ("candidates", "with_text", "categories", "attributes")]))


@query("duplicates", """
WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT l_partkey, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS s, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 'order_line' AS key_name, count(*) AS distinct_keys, sum(n)::BIGINT AS records, sum(n - 1)::BIGINT AS duplicate_occurrences,
       count(*) FILTER (n > 1) AS duplicated_keys FROM a
UNION ALL SELECT 'part_supplier', count(*), sum(n)::BIGINT, sum(n - 1)::BIGINT, count(*) FILTER (n > 1) FROM b""")
def duplicates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    supplier = F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey"))
    first = audit.duplicates(lines, ["l_orderkey", "l_linenumber"]).withColumn("key_name", F.lit("order_line"))
    second = audit.duplicates(lines.withColumn("l_suppkey", supplier), ["l_partkey", "l_suppkey"]).withColumn(
        "key_name", F.lit("part_supplier"))
    return first.unionByName(second).select(
        "key_name", "distinct_keys", "records", "duplicate_occurrences", "duplicated_keys")


@query("value_histogram", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def value_histogram(spark, sf_dir):
    return audit.histogram(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("top_values", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def top_values(spark, sf_dir):
    return audit.most_common(table(spark, sf_dir, "lineitem", "l_partkey"), "l_partkey", 20)


SQL_LINE_COUNTERS = {
    "negative_quantity": "l_quantity <= 0", "discount_out_of_range": "l_discount < 0 OR l_discount > 1",
    "missing_flag": "l_returnflag IS NULL OR l_returnflag = ''", "open_lines": "l_linestatus = 'O'",
    "large_lines": "l_quantity >= 40",
}


def line_counters(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return audit.counters(lines, {name: F.expr(condition) for name, condition in SQL_LINE_COUNTERS.items()})


@query("quality_counters", "SELECT 'records' AS counter, count(*) AS value FROM lineitem" + "".join(
    f"\nUNION ALL SELECT '{n}', count(*) FILTER ({c}) FROM lineitem" for n, c in SQL_LINE_COUNTERS.items()))
def quality_counters(spark, sf_dir):
    return line_counters(spark, sf_dir)


EXPECTED_ZERO = ("negative_quantity", "discount_out_of_range", "missing_flag")


@query("quality_checks", "\nUNION ALL ".join(
    f"SELECT '{n}' AS \"check\", count(*) FILTER ({SQL_LINE_COUNTERS[n]}) AS observed, 0::BIGINT AS expected, "
    f"count(*) FILTER ({SQL_LINE_COUNTERS[n]}) = 0 AS passed FROM lineitem" for n in EXPECTED_ZERO))
def quality_checks(spark, sf_dir):
    return audit.check_table(line_counters(spark, sf_dir), {n: 0 for n in EXPECTED_ZERO})


@query("quality_verdict", f"""
WITH c AS ({" UNION ALL ".join(f"SELECT count(*) FILTER ({SQL_LINE_COUNTERS[n]}) = 0 AS passed FROM lineitem" for n in EXPECTED_ZERO)})
SELECT count(*) AS checks, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS passed FROM c""")
def quality_verdict(spark, sf_dir):
    return audit.overall_verdict(audit.check_table(line_counters(spark, sf_dir), {n: 0 for n in EXPECTED_ZERO}))


@query("accounting", """
WITH s AS (SELECT o_orderstatus AS grp, count(*) AS n, count(*) FILTER (o_totalprice >= 100000) AS accepted,
  count(*) FILTER (o_totalprice < 100000) AS reviewed FROM orders GROUP BY 1)
SELECT grp, n, accepted, reviewed, accepted + reviewed = n AS adds_up FROM s""")
def accounting(spark, sf_dir):
    accepted = F.col("o_totalprice") >= 100_000
    counts = table(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice").groupBy(
        F.col("o_orderstatus").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("reviewed"))
    return counts.withColumn("adds_up", F.col("accepted") + F.col("reviewed") == F.col("n"))


@query("eligibility_funnel", f"""
WITH d AS (SELECT {sql_split('d.doc_id')} AS split, CASE WHEN quality IS NULL THEN 'invalid_target'
  WHEN len(string_split(trim(text), ' ')) < 20 THEN 'unusable_text' WHEN d.doc_id % 11 = 0 THEN 'unusable_main_image'
  WHEN toxic = 1 THEN 'target_outside_common_classes' ELSE 'eligible' END AS reason
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT split, reason, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS percent FROM d GROUP BY split, reason""")
def eligibility_funnel(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.withColumn("split", split_of("doc_id"))
    steps = {
        "invalid_target": F.col("quality").isNull(),
        "unusable_text": F.size(F.split(F.trim("text"), " ")) < 20,
        "unusable_main_image": F.col("doc_id") % 11 == 0,
        "target_outside_common_classes": F.col("toxic") == 1,
    }
    return audit.funnel(rows, steps, ["split"]).select("split", "reason", "n", r6("percent"))


@query("signal_matrix", f"""
WITH u AS (
 SELECT 'documents' AS dataset, {sql_split('doc_id')} AS split, text <> '' AS text, lang <> 'en' AS attributes, true AS category, false AS visual FROM documents
 UNION ALL SELECT 'pages', {sql_split('page_id')}, html <> '', false, contains(url, '/en/'), contains(html, '<img') FROM pages
 UNION ALL SELECT 'conversations', {sql_split('conv_id')}, text <> '', role = 'user', false, false FROM conversations)
SELECT dataset, split, count(*) AS records, count(*) FILTER (text) AS text, count(*) FILTER (attributes) AS attributes,
       count(*) FILTER (category) AS category, count(*) FILTER (visual) AS visual FROM u GROUP BY ROLLUP (dataset, split)""")
def signal_matrix(spark, sf_dir):
    def part(name, key, **flags):
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("dataset"), split_of(key).alias("split"), *[c.alias(f) for f, c in flags.items()])

    no = F.lit(False)
    rows = part("documents", "doc_id", text=F.col("text") != "", attributes=F.col("lang") != "en", category=F.lit(True), visual=no)
    rows = rows.unionByName(part("pages", "page_id", text=F.col("html") != "", attributes=no,
                                 category=F.col("url").contains("/en/"), visual=F.col("html").contains("<img")))
    rows = rows.unionByName(part("conversations", "conv_id", text=F.col("text") != "",
                                 attributes=F.col("role") == "user", category=no, visual=no))
    return audit.availability_matrix(rows, ["text", "attributes", "category", "visual"])


# ---------------------------------------------------------------- JSON of varying shape


def event_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines: some lack fields, some hold nulls, some are broken."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    case = F.col("event_id") % 6
    raw = (F.when(case == 0, F.col("props"))
           .when(case == 1, F.concat(F.lit('{"k":'), k, F.lit(',"user":'), F.col("user_id").cast("string"), F.lit(',"tags":["a","b"]}')))
           .when(case == 2, F.concat(F.lit('{"k":null,"type":"'), "event_type", F.lit('","tags":[]}')))
           .when(case == 3, F.concat(F.lit('{"k":"'), k, F.lit('","type":"","nested":{"x":{"y":true}}}')))
           .when(case == 4, F.concat(F.lit("{broken "), k))
           .otherwise(F.concat(F.lit("["), k, F.lit("]"))))
    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props").select("event_id", raw.alias("raw"))


@query("json_field_presence", """
WITH e AS (SELECT event_id % 6 AS c FROM events),
f AS (SELECT unnest(CASE c WHEN 0 THEN ['k'] WHEN 1 THEN ['k', 'user', 'tags'] WHEN 2 THEN ['k', 'type', 'tags'] WHEN 3 THEN ['k', 'type', 'nested'] ELSE [] END) AS field FROM e)
SELECT field, count(*) AS n FROM f GROUP BY field""")
def json_field_presence(spark, sf_dir):
    return audit.field_presence(event_objects(spark, sf_dir), "raw")


@query("required_fields", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'type,tags' WHEN 1 THEN 'type' WHEN 2 THEN '' WHEN 3 THEN 'tags' END AS missing,
       event_id % 6 >= 4 AS malformed FROM events""")
def required_fields(spark, sf_dir):
    missing = labels.missing_fields(F.col("raw"), ["k", "type", "tags"])
    return event_objects(spark, sf_dir).select(
        "event_id", F.array_join(missing, ",").alias("missing"), missing.isNull().alias("malformed"))


@query("field_structure", """
SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'missing' WHEN 3 THEN 'string' ELSE 'number' END AS k_kind,
  CASE WHEN event_id % 6 IN (1, 2) THEN 'list' ELSE 'missing' END AS tags_kind, CASE event_id % 6 WHEN 3 THEN 'dict' ELSE 'missing' END AS nested_kind,
  event_id % 6 = 1 AS tags_present, event_id % 6 IN (2, 3) AS type_present_listing, event_id % 6 = 2 AS type_present_attribute
FROM events WHERE event_id % 6 < 4""")
def field_structure(spark, sf_dir):
    """Kind and presence per field; the two presence rules differ on an empty text."""
    docs = event_objects(spark, sf_dir).filter(F.json_object_keys("raw").isNotNull()).withColumn("d", F.parse_json("raw"))

    def field(name):
        return F.try_variant_get(F.col("d"), f"$.{name}", "variant")

    return docs.select(
        "event_id", jsontext.value_kind(field("k")).alias("k_kind"), jsontext.value_kind(field("tags")).alias("tags_kind"),
        jsontext.value_kind(field("nested")).alias("nested_kind"),
        jsontext.is_present(field("tags"), True).alias("tags_present"),
        jsontext.is_present(field("type"), True).alias("type_present_listing"),
        jsontext.is_present(field("type"), False).alias("type_present_attribute"))


@query("json_leaves", r"""
WITH e AS (SELECT event_id, event_id % 6 AS c, event_type, user_id, regexp_extract(props, '(\d+)', 1) AS k FROM events)
SELECT event_id, 'k' AS path, CASE WHEN c <> 2 THEN k END AS value FROM e WHERE c < 4
UNION ALL SELECT event_id, 'user', user_id::VARCHAR FROM e WHERE c = 1
UNION ALL SELECT event_id, 'tags[0]', 'a' FROM e WHERE c = 1 UNION ALL SELECT event_id, 'tags[1]', 'b' FROM e WHERE c = 1
UNION ALL SELECT event_id, 'type', CASE WHEN c = 2 THEN event_type ELSE '' END FROM e WHERE c IN (2, 3)
UNION ALL SELECT event_id, 'nested.x.y', 'true' FROM e WHERE c = 3""")
def json_leaves(spark, sf_dir):
    docs = event_objects(spark, sf_dir).filter(F.json_object_keys("raw").isNotNull())
    return jsonleaves.json_leaves(docs, "raw", ["event_id"])


@query("json_leaves_any", r"""
WITH t AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 4 AS c FROM conversations)
SELECT conv_id, turn, 'a[''b.' || role || ''']' || CASE c WHEN 0 THEN '[1]' WHEN 1 THEN '.x[''it\''s'']' ELSE '' END AS path,
  sha256(CASE WHEN c = 2 THEN 'true' ELSE text END) AS value_sha FROM t WHERE c < 3
UNION ALL SELECT conv_id, turn, 'a[''b.' || role || '''][0]', sha256(turn::VARCHAR) FROM t WHERE c = 0
UNION ALL SELECT conv_id, turn, 'n', NULL FROM t WHERE c < 3
UNION ALL SELECT conv_id, turn, NULL, sha256('{broken ' || turn) FROM t WHERE c = 3""")
def json_leaves_any(spark, sf_dir):
    """Names with dots and quotes, lists, nulls and lines that are broken."""
    case = (F.col("conv_id") + F.col("turn")) % 4

    def doc(inner):
        fields = F.struct(F.create_map(F.concat(F.lit("b."), "role"), inner).alias("a"), F.lit(None).cast("string").alias("n"))
        return F.to_json(fields, {"ignoreNullFields": "false"})

    raw = (F.when(case == 0, doc(F.array(F.col("turn").cast("string"), F.col("text"))))
           .when(case == 1, doc(F.struct(F.struct(F.col("text").alias("it's")).alias("x"))))
           .when(case == 2, doc(F.lit(True))).otherwise(F.concat(F.lit("{broken "), F.col("turn").cast("string"))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return jsonleaves.json_leaves(rows, "raw", ["conv_id", "turn"]).select("conv_id", "turn", "path", F.sha2("value", 256).alias("value_sha"))


@query("report_gate", """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem)
SELECT 'status' AS path, 'PASS' AS expected, 'PASS' AS value, 'ok' AS verdict
UNION ALL SELECT 'version', 'v002', 'v001', 'different'
UNION ALL SELECT 'counts.records', n::VARCHAR, n::VARCHAR, 'ok' FROM n
UNION ALL SELECT 'counts.closed', '0', NULL, 'missing'""")
def report_gate(spark, sf_dir):
    """Declared fields of an earlier report against what this run requires."""
    lines = table(spark, sf_dir, "lineitem", "l_linestatus")
    report = lines.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("l_linestatus") == "O").alias("open")).select(
        F.to_json(F.struct(F.lit("PASS").alias("status"), F.lit("v001").alias("version"),
                           F.struct("records", "open").alias("counts"))).alias("doc"))
    leaves = jsonleaves.json_leaves(report, "doc", [])
    total = lines.agg(F.count(F.lit(1)).cast("string").alias("n"))
    fixed = spark.createDataFrame(
        [("status", "PASS"), ("version", "v002"), ("counts.closed", "0")], "path string, expected string")
    expected = fixed.unionByName(total.select(F.lit("counts.records").alias("path"), F.col("n").alias("expected")))
    return expected.join(leaves, "path", "left").withColumn(
        "verdict", F.when(F.col("value").isNull(), "missing").when(F.col("value") == F.col("expected"), "ok").otherwise("different"))
