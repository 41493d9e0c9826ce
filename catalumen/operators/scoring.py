"""Scoring with a model the user supplies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def batch_score(df: DataFrame, make_model: Callable[[], Callable], schema: str) -> DataFrame:
    """Score a frame with a user-supplied model that is loaded once per task.

    ``make_model`` returns a function from one pandas batch to one pandas batch.
    """

    def run(batches):
        model = make_model()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)
