"""Whitespace normalisation of named columns, with counts of what it touched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.functions import text


def normalise_fields(df: DataFrame, approved: Sequence[str]) -> DataFrame:
    """Squeeze spaces in the approved text columns; every other column stays as it is."""
    return df.withColumns({c: text.squeeze_spaces(F.col(c)) for c in approved if c in df.columns})


def change_counts(df: DataFrame, approved: Sequence[str]) -> DataFrame:
    """``(field, values_seen, values_changed)`` for the approved columns, in one pass."""
    one = df.agg(*[x for c in approved for x in (
        F.count(c).alias(f"{c}_seen"),
        F.count_if(text.squeeze_spaces(F.col(c)) != F.col(c)).alias(f"{c}_changed"))])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"{c}_seen").alias("values_seen"),
                 F.col(f"{c}_changed").alias("values_changed")) for c in approved])).alias("f")).select("f.*")
