"""Tab-separated sources: strict, with header, and quote-aware permissive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], ordered: bool = False) -> DataFrame:
    """Text lines as ``value``; ``ordered`` adds what ``file_order_index`` needs."""
    lines = spark.read.text(path)
    if not ordered:
        return lines
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__mono"))


def split_columns(lines: DataFrame, names: Sequence[str], fail: bool = True) -> DataFrame:
    """Cut lines at tabs without quoting; blank lines are skipped.

    With ``fail`` a line with another column count stops the job, otherwise it
    is kept with ``malformed`` set.
    """
    parts = F.split("value", "\t")
    right_size = F.size(parts) == len(names)
    rows = lines.filter(F.trim("value") != "")
    others = [c for c in rows.columns if c != "value"]
    if fail:
        message = F.concat(F.lit(f"expected {len(names)} columns in: "), F.substring("value", 1, 200))
        checked = F.when(right_size, parts).otherwise(F.raise_error(message).cast("array<string>"))
        rows = rows.withColumn("__parts", checked)
        return rows.select(*[F.col("__parts")[i].alias(n) for i, n in enumerate(names)], *others)
    return rows.select(
        *[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)],
        (~right_size).alias("malformed"), *others)


def read_with_header(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Tab-separated with a header that must name exactly these columns, in order."""
    frame = spark.read.csv(path, sep="\t", header=True, quote="", enforceSchema=False)
    if list(frame.columns) != list(names):
        raise ValueError(f"header {frame.columns} differs from {list(names)}")
    return frame


def scan_quoted(spark: SparkSession, path: str, names: Sequence[str], header: bool = False) -> DataFrame:
    """Tab-separated with CSV quoting; bad rows are kept and marked ``malformed``."""
    schema = ", ".join(f"`{n}` string" for n in names) + ", `_corrupt` string"
    frame = spark.read.schema(schema).csv(
        path, sep="\t", header=header, quote='"', escape='"', mode="PERMISSIVE",
        columnNameOfCorruptRecord="_corrupt", enforceSchema=True)
    return frame.select(*names, F.col("_corrupt").isNotNull().alias("malformed"))


def scan_counters(frame: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """Conditions for ``operators.audit.counters`` over a scanned frame."""
    empty = {f"empty_{n}": ~F.col("malformed") & (F.coalesce(F.trim(n), F.lit("")) == "") for n in names}
    return {"malformed": F.col("malformed"), **empty}
