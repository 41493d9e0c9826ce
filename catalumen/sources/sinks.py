"""Writers: compact JSON lines, per-split folders, small CSV files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_by_split(df: DataFrame, path: str, split: str = "split", form: str = "parquet",
                   files_per_split: int = 0, mode: str = "errorifexists", order: list[str] | None = None) -> None:
    """One folder per split, so a reader of one split opens only its files.

    Rows are written where they are; ``files_per_split`` first spreads each
    split over that many tasks, however large one split is. With ``order`` every file
    holds a range of its own, sorted, so a reader of a few keys skips files and row groups.
    """
    if order:
        tasks = (files_per_split,) if files_per_split else ()
        df = df.repartitionByRange(*tasks, split, *order).sortWithinPartitions(split, *order)
    elif files_per_split:
        share = F.pmod(F.xxhash64(*[f.name for f in df.schema if f.name != split and "map<" not in f.dataType.simpleString()]), F.lit(files_per_split))
        df = df.withColumn("__share", share).repartition(split, "__share").drop("__share")
    df.write.mode(mode).partitionBy(split).format(form).save(path)


def read_splits(spark: SparkSession, path: str, splits: list[str], split: str = "split", form: str = "parquet") -> DataFrame:
    """The named splits of a table kept by split; no other folder is listed or opened."""
    return spark.read.format(form).load(path).filter(F.col(split).isin(splits))


def read_chosen(spark: SparkSession, path: str, chosen: DataFrame, split: str = "split", form: str = "parquet") -> DataFrame:
    """The splits that ``chosen`` names, one row a split: folders are pruned when its rows are known."""
    return spark.read.format(form).load(path).join(F.broadcast(chosen.select(split)), split, "left_semi")


def write_small_csv(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """One CSV file with header, for curves and top-k reports only."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode(mode).csv(path, header=True)


def write_report(counters: DataFrame, checks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One nested JSON object: counters by name, the checks and the overall verdict."""
    totals = counters.agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("counter", "value")))).alias("counters"))
    verdict = checks.agg(
        F.sort_array(F.collect_list(F.struct(*sorted(checks.columns)))).alias("checks"),
        F.every("passed").alias("passed"))
    report = totals.select("counters", verdict.select(F.struct("checks", "passed")).scalar().alias("v"))
    report.select("counters", "v.checks", "v.passed").coalesce(1).write.mode(mode).json(path)


def write_predictions(df: DataFrame, path: str, key: str, truth: str, predicted: str,
                      mode: str = "errorifexists") -> None:
    """Auditable output: id, true label, predicted label."""
    df.select(key, F.col(truth).alias("true_label"), F.col(predicted).alias("predicted_label")).write.mode(
        mode).parquet(path)
