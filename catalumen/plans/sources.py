"""Queries that write a given table in a source's form below the shared folder and read it with that source's operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.operators import ranking
from catalumen.plans.base import query, table
from catalumen.session import scratch_path
from catalumen.sources import delimited, files, jsonlines

# Kinds of lines that are put into the JSON-lines files by rule, as Spark and as SQL spell them.
LINE_KINDS = ("whole", "text_behind", "two_objects", "single_quotes", "repeated_key", "cut_off", "list", "null_value")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line for each order, most of them whole and each fault by rule."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    kind = F.element_at(F.array(*map(F.lit, LINE_KINDS)), (F.col("o_orderkey") % len(LINE_KINDS) + 1).cast("int"))
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    line = (F.when(F.col("kind") == "text_behind", F.concat(body, F.lit(" behind")))
            .when(F.col("kind") == "two_objects", F.concat(body, body))
            .when(F.col("kind") == "single_quotes", F.translate(body, '"', "'"))
            .when(F.col("kind") == "repeated_key", F.regexp_replace(body, r"\}$", ',"id":0}'))
            .when(F.col("kind") == "cut_off", F.regexp_replace(body, r"\}$", ""))
            .when(F.col("kind") == "list", F.concat(F.lit("["), body, F.lit("]")))
            .when(F.col("kind") == "null_value", F.lit("null")).otherwise(body))
    return orders.withColumn("kind", kind).withColumn("line", line)


@query("json_lines_strict", """
SELECT count(*) AS lines, count(*) FILTER (o_orderkey % 8 <> 0) AS malformed, count(*) FILTER (o_orderkey % 8 = 0) AS objects,
  sum(o_orderkey) FILTER (o_orderkey % 8 = 0)::BIGINT AS id_sum FROM orders""")
def json_lines_strict(spark, sf_dir):
    """Only lines that are one JSON object, without repeated keys, count as good."""
    path = scratch_path(spark, "json-lines")
    order_lines(spark, sf_dir).select("line").write.text(path)
    rows = jsonlines.read_raw(spark, path, fail=False)
    return rows.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("malformed").alias("malformed"), F.count_if(~F.col("malformed")).alias("objects"),
        F.sum(F.try_variant_get("doc", "$.id", "long")).alias("id_sum"))


@query("json_typed", "SELECT o_orderkey, o_orderstatus, o_custkey % 7 = 0 AS flagged FROM orders")
def json_typed(spark, sf_dir):
    path = scratch_path(spark, "json-typed")
    table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_custkey").select(
        "o_orderkey", "o_orderstatus", (F.col("o_custkey") % 7 == 0).alias("flagged")).write.json(path)
    return jsonlines.read_typed(spark, path, "o_orderkey long, o_orderstatus string, flagged boolean")


@query("json_gzipped", "SELECT count(*) AS lines, count(DISTINCT s_nationkey) AS nations, sum(s_suppkey)::BIGINT AS key_sum FROM supplier")
def json_gzipped(spark, sf_dir):
    path = scratch_path(spark, "json-gzipped")
    table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").write.option("compression", "gzip").json(path)
    doc = F.parse_json("raw")
    return jsonlines.read_gzipped(spark, path, 4).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct(F.variant_get(doc, "$.s_nationkey", "long")).alias("nations"),
        F.sum(F.variant_get(doc, "$.s_suppkey", "long")).alias("key_sum"))


def order_files(spark: SparkSession, sf_dir: str) -> str:
    """Tab-separated files in key order, with a blank line after every tenth record."""
    path = scratch_path(spark, "tsv")
    line = F.concat_ws("\t", "o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    rows.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select(
        F.when(F.col("o_orderkey") % 10 == 0, F.concat(line, F.lit("\n  "))).otherwise(line).alias("value")).write.text(path)
    return path


@query("tsv_numbered", """
SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index
FROM orders WHERE o_orderkey % 3 <> 0""")
def tsv_numbered(spark, sf_dir):
    """Accepted rows numbered in file order: blank lines and rejected rows take no number."""
    lines = delimited.read_lines(spark, order_files(spark, sf_dir), ordered=True)
    rows = delimited.split_columns(lines, ["id", "status", "priority"])
    return ranking.file_order_index(rows.filter(F.col("id").cast("long") % 3 != 0)).select("id", "status", "row_index")


@query("tsv_malformed", "SELECT count(*) AS lines, count(*) FILTER (o_orderkey % 5 = 0) AS malformed FROM orders")
def tsv_malformed(spark, sf_dir):
    """Lines with another column count are kept and marked."""
    path = scratch_path(spark, "tsv-bad")
    short = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(
        F.concat_ws("\t", "o_orderkey", short).alias("value")).write.text(path)
    rows = delimited.split_columns(delimited.read_lines(spark, path), ["id", "status"], fail=False)
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.count_if("malformed").alias("malformed"))


@query("tsv_with_header", "SELECT s_suppkey::VARCHAR AS id, s_name AS name FROM supplier")
def tsv_with_header(spark, sf_dir):
    path = scratch_path(spark, "tsv-header")
    table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).write.option("sep", "\t").option(
        "header", "true").option("quote", "").csv(path)
    return delimited.read_with_header(spark, path, ["id", "name"])


@query("image_table", """
SELECT 'i' || p_partkey AS image_id, p_size::INTEGER AS height, (p_size * 2)::INTEGER AS width, 'a/' || (p_partkey % 9) || '/' || p_partkey || '.jpg' AS relative_path
FROM part WHERE p_partkey % 11 <> 0""")
def image_table(spark, sf_dir):
    """Image metadata as gzipped CSV; rows without an id are left out and back slashes become slashes."""
    path = scratch_path(spark, "image-table")
    key = F.col("p_partkey").cast("string")
    table(spark, sf_dir, "part", "p_partkey", "p_size").select(
        F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("i"), key)).alias("image_id"), F.col("p_size").alias("height"),
        (F.col("p_size") * 2).alias("width"),
        F.concat(F.lit("a\\"), (F.col("p_partkey") % 9).cast("string"), F.lit("\\"), key, F.lit(".jpg")).alias("path"),
    ).write.option("header", "true").option("compression", "gzip").csv(path)
    return files.read_image_table(spark, path).select("image_id", "height", "width", "relative_path")


@query("page_manifest", """
SELECT url AS relative_path, strlen(coalesce(html, ''))::BIGINT AS length, sha256(coalesce(html, '')) AS sha256 FROM pages""")
def page_manifest(spark, sf_dir):
    """The hash manifest over contents that are rows of a table."""
    return files.manifest_of(page_contents(spark, sf_dir))


def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return table(spark, sf_dir, "pages", "url", "html").select(
        F.col("url").alias("relative_path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


@query("page_drift", """
WITH now AS (SELECT page_id, url, min(sha256(coalesce(html, ''))) AS h FROM pages GROUP BY page_id, url)
SELECT page_id::VARCHAR AS relative_path, h AS sha256, CASE WHEN page_id % 7 = 0 THEN sha256(h) WHEN page_id % 7 <> 1 THEN h END AS expected_sha256
FROM now WHERE page_id % 7 IN (0, 1)""")
def page_drift(spark, sf_dir):
    """Against a record in which some hashes are out of date and some pages are unknown."""
    pages = table(spark, sf_dir, "pages", "page_id", "html").select(
        F.col("page_id").cast("string").alias("relative_path"), F.lit(0).cast("long").alias("length"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    manifest = files.manifest_of(pages)
    number = F.col("relative_path").cast("long") % 7
    recorded = manifest.filter(number != 1).withColumn(
        "sha256", F.when(number == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return files.manifest_drift(manifest, recorded)
