"""Leaves of JSON documents of any shape, one level of all documents at a time, inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.functions.jsontext import PLAIN_NAME, strict_json
from catalumen.session import cut_lineage


def _step(path: Column, pos: Column, name: Column) -> Column:
    quoted = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    plain = F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))
    return F.when(name.isNull(), F.concat(path, F.lit("["), pos.cast("string"), F.lit("]"))).when(
        name.rlike(PLAIN_NAME), plain).otherwise(F.concat(path, F.lit("['"), quoted, F.lit("']")))


def json_leaves(rows: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """``(keys..., path, value)``: one row per leaf, ``a.b[0].c`` and its value as text.

    Other names than ``PLAIN_NAME`` are written ``['...']``, so that a name with a dot is
    told from two names. Empty objects and lists have no leaf; a null leaf has a
    null value. A text that is not one JSON value, or repeats a name within an object,
    gives one row without a path, with the text as its value; a null text gives none.
    Containers are unfolded where they lie, one level of all documents in a pass: as
    many passes as the deepest document has levels, and no shuffle.
    """
    if any(c.startswith("__") for c in keys):
        raise ValueError("columns that begin with __ are used for the unfolding")
    spark = rows.sparkSession
    level = cut_lineage(rows.filter(F.col(raw).isNotNull()).select(
        *keys, F.lit("").alias("__path"), F.try_parse_json(strict_json(F.col(raw))).alias("__node"), F.col(raw).alias("__raw")), "json-level")
    found = [level.filter(F.col("__node").isNull()).select(*keys, F.lit(None).cast("string").alias("path"), F.col("__raw").alias("value"))]
    level = level.filter(F.col("__node").isNotNull()).drop("__raw")
    while True:
        kind = F.schema_of_variant("__node")
        container = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        text = F.when(kind == "STRING", F.variant_get("__node", "$", "string")).when(kind != "VOID", F.to_json("__node"))
        found.append(level.filter(~container).select(*keys, F.col("__path").alias("path"), text.alias("value")))
        inside = level.filter(container).lateralJoin(spark.tvf.variant_explode(F.col("__node").outer())).select(
            *keys, _step(F.col("__path"), F.col("pos"), F.col("key")).alias("__path"), F.col("value").alias("__node"))
        level = cut_lineage(inside, "json-level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
