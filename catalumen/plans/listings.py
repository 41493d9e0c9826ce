"""Listings from start to end: nested documents, presence and type blocks, image references out and back again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.functions import jsontext
from catalumen.operators import images
from catalumen.plans.base import query, table
from catalumen.session import cut_lineage

FIELDS = ("status", "price", "size", "tags", "note", "flag", "absent")


def listings(spark, sf_dir) -> DataFrame:
    """``(o_orderkey, main, others, raw)``: an order as a listing, its lines' parts as images, some ids empty and some lists missing."""
    order = F.col("o_orderkey")
    case = order % 6
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    ids = F.transform("lines", lambda x: F.when(x["l_linenumber"] % 5 != 0, x["l_partkey"].cast("string")).otherwise(""))
    body = F.struct(
        F.col("o_orderstatus").alias("status"),
        F.when(case > 1, F.col("o_totalprice") + 0.5).alias("price"), F.col("o_custkey").alias("size"),
        F.when(case == 2, F.array().cast("array<string>")).when(case != 3, F.array(F.lit("a"))).alias("tags"),
        F.when(case == 4, "").otherwise("x").alias("note"), (case > 2).alias("flag"))
    # An object in place of a text, and a number as text.
    raw = F.to_json(body)
    raw = F.when(case == 5, F.regexp_replace(raw, '"note":"x"', '"note":{}')).when(
        case == 1, F.regexp_replace(raw, r"\}$", ',"price":"1.5"}')).otherwise(raw)
    # An order has few lines: one row holds them.
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").join(lines, "o_orderkey", "left").withColumn(
        "ids", F.coalesce(ids, F.array().cast("array<string>")))
    return rows.select(
        "o_orderkey", F.when(order % 7 != 0, F.try_element_at("ids", F.lit(1))).otherwise("").alias("main"),
        F.when(order % 11 != 0, F.slice("ids", F.lit(2), F.greatest(F.size("ids") - 1, F.lit(0)))).alias("others"), raw.alias("raw"))


SQL_LISTINGS = """
l AS (SELECT l_orderkey AS o, list(CASE WHEN l_linenumber % 5 <> 0 THEN l_partkey::VARCHAR ELSE '' END ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1),
g AS (SELECT o_orderkey, o_orderkey % 6 AS c, CASE WHEN o_orderkey % 7 <> 0 THEN ids[1] ELSE '' END AS main,
        CASE WHEN o_orderkey % 11 <> 0 THEN coalesce(ids[2:], []) END AS others FROM orders LEFT JOIN l ON o = o_orderkey),
refs AS (SELECT o_orderkey, 0 AS position, main AS id FROM g UNION ALL
         SELECT o_orderkey, generate_subscripts(others, 1), unnest(others) FROM g),
att AS (SELECT o_orderkey, position, id, p_partkey IS NOT NULL AS found, coalesce(p_partkey % 3 <> 0, false) AS there
        FROM refs LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 4) ON p_partkey = TRY_CAST(id AS BIGINT) WHERE coalesce(id, '') <> ''),
per AS (SELECT o_orderkey, count(*) AS referenced, count(*) FILTER (there) AS available, count(*) FILTER (position = 0) AS mains,
          string_agg(id || CASE WHEN there THEN '+' WHEN found THEN '-' ELSE '?' END, ',' ORDER BY position) FILTER (position > 0) AS others FROM att GROUP BY 1)"""


@query("listing_blocks", f"""WITH {SQL_LISTINGS}
SELECT g.o_orderkey, (coalesce(main, '') <> '')::INT + coalesce(len(g.others), 0)::INT AS claimed, coalesce(referenced, 0) AS referenced, coalesce(available, 0) AS available,
  CASE WHEN coalesce(main, '') <> '' THEN main END AS main_image, coalesce(per.others, '') AS other_images,
  'status=true,price=' || CASE WHEN c = 0 THEN 'false' ELSE 'true' END || ',size=true,tags=' || CASE WHEN c IN (2, 3) THEN 'false' ELSE 'true' END || ',note=true,flag=true,absent=false' AS presence,
  'status=str,price=' || CASE c WHEN 0 THEN 'missing' WHEN 1 THEN 'str' ELSE 'float' END || ',size=int,tags=' || CASE WHEN c = 3 THEN 'missing' ELSE 'list' END
    || ',note=' || CASE WHEN c = 5 THEN 'dict' ELSE 'str' END || ',flag=bool,absent=missing' AS types,
  c NOT IN (4, 5) AS note_filled, c NOT IN (2, 3) AS tags_filled
FROM g LEFT JOIN per USING (o_orderkey)""")
def listing_blocks(spark, sf_dir):
    """Each listing's images looked up and nested again, its claims, and the presence, type and content of its fields."""
    rows = cut_lineage(listings(spark, sf_dir), "listings")
    parts = table(spark, sf_dir, "part", "p_partkey").filter(F.col("p_partkey") % 10 != 4).select(
        F.col("p_partkey").cast("string").alias("image_id"), (F.col("p_partkey") % 3 != 0).alias("physical_file_available"),
        F.lit("x").alias("path"), F.lit(1).alias("height"))
    attached = cut_lineage(images.attach_inventory(images.explode_references(rows, "o_orderkey", "main", "others"), parts), "references")
    attached = attached.withColumn("image_id", F.when(F.coalesce("image_id", F.lit("")) != "", F.col("image_id")))
    ref = images.image_reference(F.col("image_id"), F.col("metadata_available"), F.col("physical_file_available"),
                                 F.col("path"), F.col("height"), F.col("height"))
    nested = images.nest_references(attached, "o_orderkey", ref)
    counts = images.image_counts(attached, "o_orderkey", "physical_file_available").select("o_orderkey", "referenced", "available")
    v = F.parse_json("raw")
    blocks = rows.select(
        "o_orderkey", images.referenced_count(F.col("main"), F.col("others")).alias("claimed"), jsontext.structure_block(v, FIELDS).alias("b"),
        *[jsontext.variant_has_content(F.try_variant_get(v, f"$.{f}", "variant")).alias(f"{f}_filled") for f in ("note", "tags")])
    mark = F.transform("other_images", lambda r: F.concat(r["image_id"], F.when(r["physical_file_available"], "+").when(r["metadata_available"], "-").otherwise("?")))

    def spelled(column):
        return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")

    return blocks.join(counts, "o_orderkey").join(nested, "o_orderkey").select(
        "o_orderkey", "claimed", "referenced", "available", F.col("main_image.image_id").alias("main_image"), F.array_join(mark, ",").alias("other_images"),
        spelled("b.field_presence").alias("presence"), spelled("b.field_types").alias("types"), "note_filled", "tags_filled")
