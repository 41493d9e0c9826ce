"""Listing-to-image lookups, availability and per-listing counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.operators.joins import lookup


def explode_references(listings: DataFrame, key: str, main: str, others: str) -> DataFrame:
    """One row per image id of a listing: position 0 is the main image.

    A listing without images keeps one row with a null id.
    """
    other_ids = F.coalesce(F.col(others), F.array().cast("array<string>"))
    ids = F.concat(F.array(F.col(main)), other_ids)
    return listings.select(key, F.posexplode(ids).alias("position", "image_id")).filter(
        (F.coalesce("image_id", F.lit("")) != "") | (F.col("position") == 0))


def last_per_key(inventory: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """Keep the last row of a repeated key, as a rebuilt lookup table would."""
    return inventory.groupBy(key).agg(
        F.max_by(F.struct(*columns), order).alias("__row")).select(key, "__row.*")


def attach_inventory(references: DataFrame, inventory: DataFrame, key: str = "image_id") -> DataFrame:
    """Left lookup that keeps references without metadata; balanced when one image is in most listings."""
    found = inventory.withColumn("__found", F.lit(True))
    return lookup(references, found, [key]).withColumn(
        "metadata_available", F.coalesce("__found", F.lit(False))).drop("__found")


def referenced_count(main: Column, others: Column) -> Column:
    """Images a listing claims to have: its main one and the whole list, empty entries included."""
    listed = F.when(others.isNotNull(), F.size(others)).otherwise(0)
    return F.when(F.coalesce(main, F.lit("")) != "", 1).otherwise(0) + listed


def image_counts(attached: DataFrame, key: str, available: str) -> DataFrame:
    """Usable references per listing: all, available, missing, and the main image.

    Empty ids are no references here; ``referenced_count`` counts them.
    """
    present = F.col("image_id").isNotNull()
    return attached.groupBy(key).agg(
        F.count_if(present).alias("referenced"),
        F.count_if(present & F.coalesce(F.col(available), F.lit(False))).alias("available"),
        F.count_if(present & ~F.coalesce(F.col(available), F.lit(False))).alias("missing"),
        F.coalesce(F.max((F.col("position") == 0) & present), F.lit(False)).alias("has_main"),
        F.coalesce(F.max((F.col("position") == 0) & F.col(available)), F.lit(False)).alias("main_available"))


def image_reference(image_id: Column, found: Column, available: Column, path: Column,
                    height: Column, width: Column) -> Column:
    """Reference struct; without metadata its size and path stay null, without an id it is null."""
    return F.when(F.coalesce(image_id, F.lit("")) != "", F.struct(
        image_id.alias("image_id"), found.alias("metadata_available"),
        (found & F.coalesce(available, F.lit(False))).alias("physical_file_available"),
        F.when(found, path).alias("relative_path"),
        F.when(found, height).alias("height"), F.when(found, width).alias("width")))


def nest_references(attached: DataFrame, key: str, reference: Column) -> DataFrame:
    """Back to one row per listing: main reference and the others in their order.

    The arrays are as long as the id list the listing came with.
    """
    rows = attached.select(key, "position", reference.alias("ref"))
    return rows.groupBy(key).agg(
        F.max_by("ref", F.when(F.col("position") == 0, 1)).alias("main_image"),
        F.sort_array(F.collect_list(F.when(
            (F.col("position") > 0) & F.col("ref").isNotNull(), F.struct("position", "ref")))).alias("__others"),
    ).select(key, "main_image", F.transform("__others", lambda x: x["ref"]).alias("other_images"))


def reference_audit(references: DataFrame, inventory: DataFrame, key: str = "image_id") -> DataFrame:
    """Distinct referenced ids with and without metadata, and inventory ids nobody refers to."""
    sides = references.select(key, F.lit(1).alias("r"), F.lit(0).alias("i")).unionByName(
        inventory.select(key, F.lit(0).alias("r"), F.lit(1).alias("i"))).filter(F.col(key).isNotNull())
    per_id = sides.groupBy(key).agg(F.max("r").alias("r"), F.max("i").alias("i"))
    status = F.when((F.col("r") == 1) & (F.col("i") == 1), "referenced_with_metadata").when(
        F.col("r") == 1, "referenced_without_metadata").otherwise("never_referenced")
    return per_id.select(key, status.alias("status"))
