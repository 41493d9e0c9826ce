"""File inventories, lookups with required columns, hash manifests and drift."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions import paths

WHOLE_FILE_LIMIT = 256 * 1024 * 1024
READ_BYTES = 8 * 1024 * 1024


def read_image_table(spark: SparkSession, path: str) -> DataFrame:
    """Image metadata from a (gzipped) CSV; rows without id or path are left out."""
    frame = spark.read.csv(path, header=True, escape='"')
    missing = {"image_id", "height", "width", "path"} - set(frame.columns)
    if missing:
        raise ValueError(f"image table lacks {sorted(missing)}")
    return frame.filter(
        (F.coalesce("image_id", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != "")
    ).select(
        "image_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"),
        F.regexp_replace("path", r"\\", "/").alias("relative_path"),
        F.monotonically_increasing_id().alias("row_order"))


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``(path, relative_path, length, extension)``; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    frame = reader.load(root).select("path", "length")
    return frame.withColumn("relative_path", _below(root)).withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))


def _below(root: str) -> Column:
    """The listed path below ``root``, whichever of the two names the file system with ``file:`` or slashes."""
    def plain(path: Column) -> Column:
        return F.regexp_replace(path, "^file:/+", "/")

    base = plain(F.lit(root.rstrip("/") + "/"))
    listed = plain(F.col("path"))
    return F.when(F.startswith(listed, base), F.substr(listed, F.length(base) + 1)).otherwise(listed)


def mark_available(image_table: DataFrame, files: DataFrame) -> DataFrame:
    """Whether the documented file of an image exists and is an image file."""
    present = files.filter(paths.has_image_extension(F.col("relative_path"))).select(
        F.col("relative_path").alias("__path"), F.lit(True).alias("__present")).distinct()
    keyed = image_table.withColumn("__path", paths.relative_path(F.col("relative_path")))
    return keyed.join(present, "__path", "left").withColumn(
        "physical_file_available", F.coalesce("__present", F.lit(False))).drop("__path", "__present")


def _hash_streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        digests = []
        for uri in batch["path"]:
            source, name = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1)
                                                  if uri.startswith("file:/") and not uri.startswith("file://")
                                                  else uri)
            digest = hashlib.sha256()
            with source.open_input_stream(name) as stream:
                while chunk := stream.read(READ_BYTES):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield batch[["path", "length"]].assign(sha256=digests)


def manifest_of(contents: DataFrame) -> DataFrame:
    """``(relative_path, length, sha256)`` of contents that are rows: ``(relative_path, length, content)``."""
    return contents.select("relative_path", "length", F.sha2("content", 256).alias("sha256"))


def hash_manifest(spark: SparkSession, root: str, pattern: str | None = None,
                  whole_file_limit: int = WHOLE_FILE_LIMIT) -> DataFrame:
    """``(relative_path, length, sha256)`` per file, one task per group of files.

    Files up to the limit are hashed inside Spark; larger ones are read as a
    stream, so no file has to fit in memory.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(root)
    small = manifest_of(files.filter(F.col("length") <= whole_file_limit).withColumnRenamed("path", "relative_path"))
    large = files.filter(F.col("length") > whole_file_limit).select("path", "length").mapInPandas(
        _hash_streams, "path string, length long, sha256 string")
    return small.withColumnRenamed("relative_path", "path").unionByName(large).select(
        _below(root).alias("relative_path"), "length", "sha256")


def manifest_drift(manifest: DataFrame, expected: DataFrame, key: str = "relative_path") -> DataFrame:
    """Files whose recorded hash differs, is missing or was never recorded."""
    recorded = expected.select(key, F.col("sha256").alias("expected_sha256"))
    return manifest.select(key, "sha256").join(recorded, key, "full_outer").filter(
        ~F.col("sha256").eqNullSafe(F.col("expected_sha256")))


def require_columns(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(frame.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return frame
