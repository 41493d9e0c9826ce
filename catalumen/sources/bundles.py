"""Array bundles, curve files and run configuration."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions import vectors
from catalumen.sources.files import require_columns


def read_bundle(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A Parquet bundle with one row per record; required columns must exist."""
    return require_columns(spark.read.parquet(path), required)


def bundle_problems(bundle: DataFrame, key: str, arrays: dict[str, int]) -> DataFrame:
    """``(array, problem, n)`` over the probability arrays, plus repeated ids."""
    rows = bundle.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("array"), vectors.vector_problem(F.col(a).cast("array<double>"), w).alias("problem"))
        for a, w in arrays.items()])).alias("p")).select("p.*")
    found = rows.filter(F.col("problem").isNotNull()).groupBy("array", "problem").agg(F.count(F.lit(1)).alias("n"))
    repeated = bundle.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(
        F.sum(F.col("c") - 1).alias("n")).select(
        F.lit(key).alias("array"), F.lit("repeated_id").alias("problem"), "n").filter(F.col("n") > 0)
    return found.unionByName(repeated)


def matrix_report(bundle: DataFrame, key: str, arrays: dict[str, int], split: str, expected: dict[str, int]) -> DataFrame:
    """``(check, observed, expected, passed)`` of a stored matrix: rows of each split, faulty arrays, repeated and shared ids."""
    counts = bundle.agg(*[F.count_if(F.col(split) == name).alias(f"rows:{name}") for name in expected])
    faults = bundle_problems(bundle, key, arrays)
    seen = bundle.groupBy(key).agg(F.count_distinct(split).alias("splits")).agg(F.count_if(F.col("splits") > 1).alias("n"))
    rows = counts.select(F.explode(F.array(*[F.struct(
        F.lit(f"rows:{name}").alias("check"), F.col(f"rows:{name}").alias("observed"), F.lit(n).cast("long").alias("expected"))
        for name, n in expected.items()])).alias("r")).select("r.*")
    # One row for each kind of fault.
    bad = faults.select(F.concat_ws(":", "array", "problem").alias("check"), F.col("n").alias("observed"), F.lit(0).cast("long").alias("expected"))
    shared = seen.select(F.lit("ids_in_two_splits").alias("check"), F.col("n").alias("observed"), F.lit(0).cast("long").alias("expected"))
    return rows.unionByName(bad).unionByName(shared).withColumn("passed", F.col("observed") == F.col("expected"))


def read_curve(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    """A small curve written as CSV; the row count must match when it is given."""
    frame = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    if rows is not None:
        found = frame.limit(rows + 1).count()
        if found != rows:
            raise ValueError(f"expected {rows} curve rows, found {found}")
    return frame


def load_config(path: str) -> dict[str, Any]:
    """Operator parameters from a JSON file, or YAML where that parser is present."""
    content = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML needs the yaml package") from error
        loaded = yaml.safe_load(content)
    else:
        loaded = json.loads(content)
    if not isinstance(loaded, dict):
        raise ValueError("configuration must be a mapping")
    return loaded
