"""Stored artefacts: a given table is written in a sink's form below the shared folder, some of it spoiled by rule, read back and checked."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from catalumen.functions import vectors
from catalumen.operators import audit, ranking, selective, taxonomy
from catalumen.plans.base import query, split_of, sql_split, table
from catalumen.plans.catalogue import SQL_NODES, customer_paths
from catalumen.plans.multiview import PERMUTATION_SEED
from catalumen.plans.reliability import SQL_BASE, SQL_CURVE, scored
from catalumen.session import cut_lineage, scratch_path
from catalumen.sources import bundles, delimited, files, jsonlines, sinks


def split_orders(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "orders-by-split")
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").withColumn("split", split_of("o_orderkey"))
    sinks.write_by_split(rows, path, order=["o_orderkey"])
    return path


@query("split_table", f"""
WITH o AS (SELECT o_orderkey, o_totalprice, {sql_split('o_orderkey')} AS split FROM orders)
SELECT 'one_split' AS reader, count(*) AS records, coalesce(sum(o_orderkey), 0)::BIGINT AS key_sum, round(sum(o_totalprice), 2) AS total FROM o WHERE split = 'validation'
UNION ALL SELECT 'chosen_splits', count(*), coalesce(sum(o_orderkey), 0)::BIGINT, round(sum(o_totalprice), 2) FROM o WHERE split IN ('validation', 'test')
UNION ALL SELECT 'key_range', count(*), coalesce(sum(o_orderkey), 0)::BIGINT, round(sum(o_totalprice), 2) FROM o WHERE split = 'train' AND o_orderkey BETWEEN 100 AND 400
UNION ALL SELECT 'all_splits', count(*), coalesce(sum(o_orderkey), 0)::BIGINT, round(sum(o_totalprice), 2) FROM o""")
def split_table(spark, sf_dir):
    """One table kept by split and sorted by key: a split, splits named by another table, a range of keys, and all of it."""
    path = split_orders(spark, sf_dir)
    listed = spark.createDataFrame([("train", 0), ("validation", 1), ("test", 1)], "split string, held_out int")
    readers = {
        "one_split": sinks.read_splits(spark, path, ["validation"]),
        "chosen_splits": sinks.read_chosen(spark, path, listed.filter("held_out = 1")),
        "key_range": sinks.read_splits(spark, path, ["train"]).filter(F.col("o_orderkey").between(100, 400)),
        "all_splits": sinks.read_splits(spark, path, ["train", "validation", "test"])}
    result = None
    for name, rows in readers.items():
        row = rows.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("o_orderkey"), F.lit(0)).alias("key_sum"),
                       F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("reader", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return result


@query("tsv_quoted", """
SELECT 'records' AS counter, count(*) AS value FROM customer UNION ALL SELECT 'malformed', count(*) FILTER (c_custkey % 7 IN (1, 2)) FROM customer
UNION ALL SELECT 'empty_name', count(*) FILTER (c_custkey % 7 = 3) FROM customer UNION ALL SELECT 'empty_segment', count(*) FILTER (c_custkey % 7 = 4) FROM customer
UNION ALL SELECT 'tabs_in_names', count(*) FILTER (c_custkey % 7 NOT IN (1, 2, 3)) FROM customer""")
def tsv_quoted(spark, sf_dir):
    """Quoted fields may hold tabs and quotes; lines with another number of fields and empty fields are counted."""
    path = scratch_path(spark, "tsv-quoted")
    case = F.col("c_custkey") % 7
    name = F.concat(F.lit('"'), F.regexp_replace("c_name", "#", "\t"), F.lit(' ""known"""'))
    line = (F.when(case == 1, F.col("c_name")).when(case == 2, F.concat_ws("\t", "c_name", "c_mktsegment", F.lit("more")))
            .when(case == 3, F.concat_ws("\t", F.lit('""'), "c_mktsegment")).when(case == 4, F.concat_ws("\t", name, F.lit("")))
            .otherwise(F.concat_ws("\t", name, "c_mktsegment")))
    table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select(line.alias("value")).write.text(path)
    frame = delimited.scan_quoted(spark, path, ["name", "segment"])
    counters = delimited.scan_counters(frame, ["name", "segment"])
    return audit.counters(frame, {**counters, "tabs_in_names": ~F.col("malformed") & F.coalesce(F.col("name").contains("\t"), F.lit(False))})


def page_files(spark: SparkSession, sf_dir: str) -> str:
    """Pages as text files, one for each fifty page numbers, below folders that name them."""
    path = scratch_path(spark, "page-files")
    pages = table(spark, sf_dir, "pages", "page_id", "html").withColumn("pack", F.expr("page_id div 50"))
    packs = max(1, pages.select("pack").distinct().count())
    rows = pages.repartition(packs, "pack").sortWithinPartitions("pack", "page_id")
    rows.select("pack", F.coalesce("html", F.lit("")).alias("value")).write.partitionBy("pack").text(path)
    return path


SQL_PACKS = "packs AS (SELECT page_id // 50 AS pack, string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id) AS content FROM pages GROUP BY 1)"
PACK_OF = r"^pack=(\d+)/"


@query("file_inventory", f"""WITH {SQL_PACKS}
SELECT pack, 1::BIGINT AS files, strlen(content)::BIGINT AS length, '.txt' AS extension FROM packs""")
def file_inventory(spark, sf_dir):
    """Files below a root: path, size and extension, without reading them."""
    listed = files.list_files(spark, page_files(spark, sf_dir), "*.txt")
    return listed.groupBy(F.regexp_extract("relative_path", PACK_OF, 1).cast("long").alias("pack"), "extension").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("length"))


@query("file_hashes", f"""WITH {SQL_PACKS} SELECT pack, strlen(content)::BIGINT AS length, sha256(content) AS sha256 FROM packs""")
def file_hashes(spark, sf_dir):
    """The hash manifest of real files, small ones whole and large ones in pieces."""
    manifest = files.hash_manifest(spark, page_files(spark, sf_dir), "*.txt")
    return manifest.select(F.regexp_extract("relative_path", PACK_OF, 1).cast("long").alias("pack"), "length", "sha256")


@query("file_availability", """
WITH stored AS (SELECT DISTINCT 'img/' || (l_partkey % 10) || '/' || l_partkey || CASE WHEN l_partkey % 13 = 0 THEN '.txt' ELSE '.JPG' END AS path FROM lineitem WHERE l_partkey % 5 <> 0)
SELECT p_partkey::VARCHAR AS image_id, p_partkey % 9 <> 0 AND path IS NOT NULL AS physical_file_available
FROM part LEFT JOIN stored ON path = 'img/' || (p_partkey % 10) || '/' || p_partkey || '.JPG'""")
def file_availability(spark, sf_dir):
    """Image metadata against a file inventory: back slashes are the same path, paths that leave the root and other kinds of files do not count."""
    key = F.col("l_partkey")
    stored = table(spark, sf_dir, "lineitem", "l_partkey").filter(key % 5 != 0).select(F.concat(
        F.lit("img/"), (key % 10).cast("string"), F.lit("/"), key.cast("string"), F.when(key % 13 == 0, ".txt").otherwise(".JPG")).alias("relative_path"))
    image = F.col("p_partkey")
    slash = F.when(image % 2 == 0, "\\").otherwise("/")
    up = F.when(image % 9 == 0, "../").otherwise("")
    named = table(spark, sf_dir, "part", "p_partkey").select(
        image.cast("string").alias("image_id"),
        F.concat(up, F.lit("img"), slash, (image % 10).cast("string"), slash, image.cast("string"), F.lit(".JPG")).alias("relative_path"))
    return files.mark_available(named, stored).select("image_id", "physical_file_available")


@query("array_bundle", f"""
WITH v AS (SELECT vec_id, {sql_split('vec_id')} AS split FROM embeddings)
SELECT 'rows:train' AS "check", count(*) FILTER (split = 'train') + count(*) FILTER (vec_id % 20 = 0 AND split <> 'train') AS observed, (count(*) FILTER (split = 'train'))::BIGINT AS expected,
  count(*) FILTER (vec_id % 20 = 0 AND split <> 'train') = 0 AS passed FROM v
UNION ALL SELECT 'rows:test', count(*) FILTER (split = 'test') + count(*) FILTER (vec_id % 20 = 0 AND split = 'train'), count(*) FILTER (split = 'test'), count(*) FILTER (vec_id % 20 = 0 AND split = 'train') = 0 FROM v
UNION ALL SELECT 'p:row_sum', count(*) FILTER (vec_id % 7 = 0) + count(*) FILTER (vec_id % 140 = 0), 0, false FROM v
UNION ALL SELECT 'p:wrong_width', count(*) FILTER (vec_id % 7 = 1) + count(*) FILTER (vec_id % 7 = 1 AND vec_id % 20 = 0), 0, false FROM v
UNION ALL SELECT 'p:negative', count(*) FILTER (vec_id % 7 = 2) + count(*) FILTER (vec_id % 7 = 2 AND vec_id % 20 = 0), 0, false FROM v
UNION ALL SELECT 'vec_id:repeated_id', count(*) FILTER (vec_id % 20 = 0), 0, false FROM v
UNION ALL SELECT 'ids_in_two_splits', count(*) FILTER (vec_id % 20 = 0), 0, false FROM v""")
def array_bundle(spark, sf_dir):
    """A stored matrix with faulty rows and with ids that came into a second split, and its report."""
    base = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("split", split_of("vec_id"))
    shares = vectors.normalise(F.transform("embedding", lambda x: F.abs(x.cast("double")) + 1e-9))
    case = F.col("vec_id") % 7
    rest = F.slice("p", 2, 63)
    spoiled = base.withColumn("p", shares).withColumn("p", (
        F.when(case == 0, F.transform("p", lambda x: x * 0.5)).when(case == 1, F.slice("p", 1, 63))
        .when(case == 2, F.concat(F.array(-F.col("p")[0]), rest)).otherwise(F.col("p")))).select("vec_id", "split", "p")
    again = spoiled.filter(F.col("vec_id") % 20 == 0).withColumn("split", F.when(F.col("split") == "train", "test").otherwise("train"))
    path = scratch_path(spark, "bundle")
    spoiled.unionByName(again).write.parquet(path)
    stored = bundles.read_bundle(spark, path, ["vec_id", "split", "p"])
    expected = {r["split"]: r["n"] for r in base.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return bundles.matrix_report(stored, "vec_id", {"p": 64}, "split", {s: expected.get(s, 0) for s in ("train", "test")})


@query("curve_file", f"""WITH {SQL_BASE}, {SQL_CURVE}
SELECT step::INTEGER AS step, threshold, accepted AS accepted_count, ok AS accepted_correct_count FROM cnt, tot""")
def curve_file(spark, sf_dir):
    """A curve as one CSV file in grid order, read back with its schema and its number of rows checked."""
    curve = selective.coverage_risk(selective.threshold_counts(scored(spark, sf_dir), "conf", "correct"))
    path = scratch_path(spark, "curve")
    sinks.write_small_csv(curve.select("step", "threshold", "accepted_count", "accepted_correct_count"), path, ["step"])
    return bundles.read_curve(spark, path, "step int, threshold double, accepted_count long, accepted_correct_count long", 101)


@query("jsonl_sink", """
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN lang END AS lang, source, 3::INTEGER AS n_keys FROM documents""")
def jsonl_sink(spark, sf_dir):
    """Compact JSON lines keep a null field as a null."""
    path = scratch_path(spark, "jsonl")
    rows = table(spark, sf_dir, "documents", "doc_id", "lang", "source").withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    sinks.write_jsonl(rows, path)
    raw = jsonlines.read_raw(spark, path)
    return raw.select(
        F.variant_get("doc", "$.doc_id", "long").alias("doc_id"), F.variant_get("doc", "$.lang", "string").alias("lang"),
        F.variant_get("doc", "$.source", "string").alias("source"),
        F.size(F.json_object_keys(F.to_json("doc"))).alias("n_keys"))


@query("report_sink", """
WITH c AS (SELECT 'records' AS counter, count(*) AS value FROM orders UNION ALL SELECT 'open', count(*) FILTER (o_orderstatus = 'O') FROM orders
  UNION ALL SELECT 'large', count(*) FILTER (o_totalprice > 200000) FROM orders)
SELECT counter, value, CASE counter WHEN 'records' THEN true WHEN 'open' THEN false END AS check_passed, false AS report_passed FROM c""")
def report_sink(spark, sf_dir):
    """One nested report of counters, checks and verdict, one of whose checks expects a wrong number."""
    orders = table(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice")
    counted = cut_lineage(audit.counters(orders, {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 200_000}), "counters")
    found = {r["counter"]: r["value"] for r in counted.collect()}
    path = scratch_path(spark, "report")
    sinks.write_report(counted, audit.check_table(counted, {"records": found["records"], "open": found["open"] + 1}), path)
    report = spark.read.schema("counters map<string,long>, checks array<struct<check:string,passed:boolean>>, passed boolean").json(path)
    verdicts = F.map_from_entries(F.transform("checks", lambda c: F.struct(c["check"], c["passed"])))
    return report.select(F.explode("counters").alias("counter", "value"), verdicts.alias("v"), F.col("passed").alias("report_passed")).select(
        "counter", "value", F.try_element_at("v", F.col("counter")).alias("check_passed"), "report_passed")


# Checks over artefacts that are partly wrong, each fault by rule.


@query("metric_recheck_spoiled", """
SELECT o_custkey % 50 AS metric, round(avg(o_totalprice) + CASE o_custkey % 50 % 5 WHEN 0 THEN 1 WHEN 1 THEN 0.0000001 ELSE 0 END, 4) AS stored,
  CASE WHEN o_custkey % 50 % 5 = 2 THEN NULL ELSE round(avg(o_totalprice), 4) END AS recomputed, o_custkey % 50 % 5 IN (1, 3, 4) AS passed
FROM orders GROUP BY o_custkey % 50""")
def metric_recheck_spoiled(spark, sf_dir):
    """Stored means, some off by more than the tolerance, some by less, some without a recomputed one."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").withColumn("metric", F.col("o_custkey") % 50)
    means = orders.groupBy("metric").agg(F.avg("o_totalprice").alias("value"))
    case = F.col("metric") % 5
    stored = means.withColumn("value", F.col("value") + F.when(case == 0, 1.0).when(case == 1, 1e-7).otherwise(0.0))
    again = orders.filter(case != 2).groupBy("metric").agg((F.sum("o_totalprice") / F.count("o_totalprice")).alias("value"))
    return audit.metric_drift(stored, again, 1e-5).select("metric", F.round("stored", 4).alias("stored"), F.round("recomputed", 4).alias("recomputed"), "passed")


@query("taxonomy_faults", f"""WITH {SQL_NODES},
n AS (SELECT *, ('0x' || substr(sha256(node_id), 1, 4))::BIGINT % 5 AS c FROM nodes)
SELECT count(*) AS nodes, count(*) FILTER (c = 0 OR (c = 1 AND depth = 1)) AS parent_depth_mismatch, count(*) FILTER (c = 2) AS wrong_depth,
  count(*) FILTER (depth = 1 AND c <> 2) + count(*) FILTER (c = 2 AND depth = 0) AS roots FROM n""")
def taxonomy_faults(spark, sf_dir):
    """Nodes that lost or gained a parent, or have another depth than their id."""
    nodes = taxonomy.taxonomy_nodes(customer_paths(spark, sf_dir), "path")
    case = F.conv(F.substring(F.sha2("node_id", 256), 1, 4), 16, 10).cast("long") % 5
    parent = F.when((case == 0) & (F.col("depth") > 1), F.lit(None).cast("string")).when(
        case.isin(0, 1) & (F.col("depth") == 1), "elsewhere").otherwise(F.col("parent"))
    spoiled = nodes.withColumn("case", case).withColumn("parent", parent).withColumn(
        "parent", F.when(F.col("case") == 2, F.coalesce("parent", F.lit("above"))).otherwise(F.col("parent"))).withColumn(
        "depth", F.when(F.col("case") == 2, F.col("depth") + 1).otherwise(F.col("depth")))
    return taxonomy.node_problems(spoiled)


@query("curve_faults", f"""WITH {SQL_BASE}, {SQL_CURVE}
SELECT 'grid_complete' AS "check", false AS passed UNION ALL SELECT 'threshold_zero_accepts_all', max(CASE WHEN step = 0 THEN n - accepted + 1 END) = 0 FROM cnt, tot
UNION ALL SELECT 'coverage_never_rises', false UNION ALL SELECT 'accepted_adds_up', count(*) FILTER (step % 10 = 5 AND accepted > 0) = 0 FROM cnt""")
def curve_faults(spark, sf_dir):
    """A curve without one of its points, with a record lost at zero, a jump and counts that do not add up."""
    curve = selective.coverage_risk(selective.threshold_counts(scored(spark, sf_dir), "conf", "correct"))
    step = F.col("step")
    spoiled = curve.filter(step != 17).withColumn("abstained_count", F.when(step == 0, F.col("abstained_count") + 1).otherwise(F.col("abstained_count"))).withColumn(
        "coverage", F.when(step == 60, 2.0).otherwise(F.col("coverage"))).withColumn(
        "accepted_error_count", F.when(step % 10 == 5, F.col("accepted_error_count") + 1).otherwise(F.col("accepted_error_count")))
    return selective.curve_checks(spoiled)


@query("permutation_faults", f"""
WITH t AS (SELECT vec_id, {sql_split('vec_id')} AS split FROM embeddings), tr AS (SELECT vec_id FROM t WHERE split = 'train'),
p AS (SELECT a.vec_id, CASE WHEN a.vec_id % 10 = 0 THEN (SELECT min(vec_id) FROM tr) WHEN a.vec_id % 10 = 1 THEN a.vec_id ELSE b.vec_id END AS donor
  FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM tr) a
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('{PERMUTATION_SEED}|' || vec_id), vec_id) AS i FROM tr) b ON a.i = b.i)
SELECT count(*) AS records, count(DISTINCT donor) AS distinct_sources, count(*) = count(DISTINCT donor) AS complete,
  count(*) FILTER (donor = vec_id) AS unmoved FROM p""")
def permutation_faults(spark, sf_dir):
    """A control in which some records share a donor and some kept their own value."""
    train = table(spark, sf_dir, "embeddings", "vec_id", "label").withColumn("split", split_of("vec_id")).filter("split = 'train'").drop("split")
    least = train.agg(F.min("vec_id")).scalar()
    case = F.col("vec_id") % 10
    spoiled = ranking.permute_column(train, "vec_id", "label", PERMUTATION_SEED).withColumn(
        "label_from", F.when(case == 0, least).when(case == 1, F.col("vec_id")).otherwise(F.col("label_from")))
    return ranking.permutation_report(spoiled, "vec_id", "label_from")
