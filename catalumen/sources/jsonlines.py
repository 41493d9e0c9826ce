"""JSON-lines sources: fail-fast, permissive and many gzipped files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalumen.functions.jsontext import is_json_object


def read_typed(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Declared shape; the first broken line stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_raw(spark: SparkSession, path: str | list[str], fail: bool = True) -> DataFrame:
    """One JSON object per line, kept as text in ``raw`` with a ``variant`` copy.

    Broken JSON and JSON that is not an object count the same. With ``fail``
    either stops the job, otherwise it is kept with ``malformed`` set.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumnRenamed("value", "raw")
    is_object = is_json_object(F.col("raw"))
    if fail:
        message = F.concat(F.lit("not a JSON object: "), F.substring("raw", 1, 200))
        lines = lines.withColumn("raw", F.when(is_object, F.col("raw")).otherwise(F.raise_error(message).cast("string")))
        return lines.withColumn("doc", F.parse_json("raw"))
    return lines.withColumn("malformed", ~is_object).withColumn(
        "doc", F.when(is_object, F.try_parse_json("raw")))


def read_gzipped(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    """All ``*.json.gz`` files of a folder, with their names.

    A gzip file cannot be split, so rows are spread again after the scan.
    """
    lines = spark.read.option("pathGlobFilter", "*.json.gz").text(folder).select(
        F.col("value").alias("raw"), F.col("_metadata.file_name").alias("file_name"))
    return lines.repartition(partitions) if partitions else lines
