"""Taxonomy nodes, terminal nodes, unseen children and level-wise accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.functions import paths


def taxonomy_nodes(df: DataFrame, path: str) -> DataFrame:
    """Every prefix of every path once: ``(node_id, parent, depth)``."""
    distinct_paths = df.select(paths.parse_path(F.col(path)).alias("nodes")).filter(
        F.col("nodes").isNotNull()).distinct()
    return distinct_paths.select(F.explode(paths.path_prefixes(F.col("nodes"))).alias("n")).select(
        "n.*").distinct()


def node_problems(nodes: DataFrame) -> DataFrame:
    """A node has no parent exactly when its depth is one; its id ends with its own part."""
    return nodes.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("parent").isNull() != (F.col("depth") == 1)).alias("parent_depth_mismatch"),
        F.count_if(F.size(F.split("node_id", paths.PATH_SEPARATOR)) != F.col("depth")).alias("wrong_depth"),
        F.count_if(F.col("depth") == 1).alias("roots"),
    )


def terminal_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    parents = nodes.select(F.col("parent").alias("node_id")).filter(F.col("node_id").isNotNull()).distinct()
    return nodes.join(parents, "node_id", "left_anti")


def edges(df: DataFrame, path: str) -> DataFrame:
    """Distinct ``(parent, child)`` steps between neighbouring path parts."""
    parts = F.split(F.col(path), paths.PATH_SEPARATOR)
    steps = F.zip_with(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda parent, child: F.struct(parent.alias("parent"), child.alias("child")))
    return df.select(path).distinct().select(F.explode(steps).alias("e")).select("e.*").distinct()


def unseen_children(train: DataFrame, test: DataFrame, path: str) -> DataFrame:
    """Steps seen in test only, below parents that both sides know."""
    train_edges, test_edges = edges(train, path), edges(test, path)
    known = train_edges.select("parent").distinct()
    return test_edges.join(known, "parent", "left_semi").join(
        train_edges, ["parent", "child"], "left_anti")


def unseen_paths(train: DataFrame, test: DataFrame, path: str) -> DataFrame:
    return test.select(path).distinct().join(train.select(path), path, "left_anti")


def level_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Agreement per path level, over the levels the true path has.

    Equal pairs are counted before the levels are unfolded.
    """
    pairs = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    guess = F.split(F.col(predicted), paths.PATH_SEPARATOR)
    levels = pairs.select(
        "n", guess.alias("guess"),
        F.posexplode(F.split(F.col(truth), paths.PATH_SEPARATOR)).alias("i", "node"))
    hit = F.coalesce(F.try_element_at("guess", F.col("i") + 1) == F.col("node"), F.lit(False))
    return levels.groupBy((F.col("i") + 1).alias("level")).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("correct"),
    ).withColumn("accuracy", F.col("correct") / F.col("total"))


def hierarchical_metrics(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 over the sets of a path's ancestors (itself included), and mean tree distance.

    A missing prediction has no ancestors and no distance. Equal pairs are counted first.
    """
    by = by or []
    pairs = df.filter(F.col(truth).isNotNull()).groupBy(*by, truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    t, p = F.col(truth), F.col(predicted)
    sizes = pairs.select(
        *by, "n", paths.common_depth(t, p).alias("common"), F.size(F.split(t, paths.PATH_SEPARATOR)).alias("deep"),
        F.when(p.isNotNull(), F.size(F.split(p, paths.PATH_SEPARATOR))).otherwise(0).alias("guessed"),
        F.when(p.isNotNull(), paths.tree_distance(t, p)).alias("distance"))
    n = F.col("n")
    sums = sizes.groupBy(*by).agg(
        F.sum("n").alias("records"), F.sum(n * F.col("common")).alias("c"), F.sum(n * F.col("deep")).alias("d"),
        F.sum(n * F.col("guessed")).alias("g"), F.sum(n * F.col("distance")).alias("far"), F.sum(F.when(F.col("distance").isNotNull(), n)).alias("m"))
    return sums.select(
        *by, "records", F.try_divide("c", "g").alias("precision"), F.try_divide("c", "d").alias("recall"),
        F.try_divide(2 * F.col("c"), F.col("g") + F.col("d")).alias("f1"), F.try_divide("far", "m").alias("mean_distance"))
