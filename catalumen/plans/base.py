"""Registry of named queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions import identity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL spelling of the fixed hash bucket, for a key expression put in place of {key}.
SQL_BUCKET = "(('0x' || substr(sha256('phase-a-split-v001|' || ({key})), 1, 16))::UBIGINT % 100000)"
SQL_SPLIT = ("CASE WHEN {b} < 80000 THEN 'train' WHEN {b} < 90000 THEN 'validation' ELSE 'test' END")
SQL_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def sql_bucket(key: str) -> str:
    return SQL_BUCKET.format(key=key)


def sql_split(key: str) -> str:
    return SQL_SPLIT.format(b=sql_bucket(key))


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL twin where SQL can express it."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table of long texts, spread over the cores when its files give too few splits.

    Rows go to tasks by the hash of the unique ``key``, so a repeated task sees
    the same rows. With as many splits as cores nothing is moved.
    """
    frame = table(spark, sf_dir, name, key, *columns)
    cores = spark.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores, key)


def r6(column: Column | str, name: str | None = None) -> Column:
    """Six digits, so that summation order does not show."""
    rounded = F.round(F.col(column) if isinstance(column, str) else column, 6)
    return rounded.alias(name or column)


def split_of(key: str) -> Column:
    return identity.three_way_split(identity.bucket(F.col(key)))
