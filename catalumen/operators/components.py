"""Connected components of records that share a value, and splits over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.functions import identity
from catalumen.operators.joins import MAX_HOT_KEYS, join_spread
from catalumen.session import cut_lineage

# Rounds grow with the logarithm of a component's size; this only stops a fault from looping for ever.
MAX_ROUNDS = 100
# Below this many edges one task can hold them all, so a hot node needs no salting.
ONE_TASK_EDGES = 1_000_000


def sharing_edges(references: DataFrame, record: str, item: str) -> DataFrame:
    """One edge per reference: each record to the smallest record with that item.

    A star per item instead of all its pairs, so an item shared by a third of
    the records adds as many edges as it has references.
    """
    refs = references.select(F.col(record).alias("u"), F.col(item).alias("__item")).dropna()
    owners = refs.groupBy("__item").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("__n"))
    # An item with a single reference connects nothing, and most have no more.
    shared = cut_lineage(owners.filter(F.col("__n") > 1), "shared-items")
    total = shared.agg(F.sum("__n")).scalar()
    hot = shared.filter(F.col("__n") * F.lit(MAX_HOT_KEYS) > total).select(
        "__item", F.ceil(F.col("__n") * F.lit(MAX_HOT_KEYS) / total).cast("int").alias("__salts"))
    return (
        join_spread(refs, shared.select("__item", "v"), ["__item"], "inner", hot=hot)
        .filter(F.col("u") != F.col("v")).select("u", "v").distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _look_up(edges: DataFrame, least: DataFrame, node: str, how: str, total: int) -> DataFrame:
    """Join the edges to one row per node, salted once they no longer fit one task.

    ``total`` is the number of edges, known from the last round.
    """
    if total <= ONE_TASK_EDGES:
        return edges.join(least, node, how)
    counts = edges.groupBy(node).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.filter(F.col("__n") * F.lit(MAX_HOT_KEYS) > F.lit(total)).select(
        node, F.ceil(F.col("__n") * F.lit(MAX_HOT_KEYS) / F.lit(total)).cast("int").alias("__salts"))
    return join_spread(edges, least, [node], how, hot=hot)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node around it.

    Edges point from the larger to the smaller end, so the smallest node around
    ``v`` is the least end of its own edges, or ``v`` itself.
    """
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    moved = _look_up(edges, least, "v", "left", total)
    return moved.select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect the smaller neighbours of a node, and the node, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _look_up(edges, least, "u", "inner", total)
    # The node's own edge to its least neighbour, and one edge per other neighbour.
    pair = F.when(F.col("v") == F.col("m"), F.struct("u", F.col("m").alias("v"))).otherwise(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.select(pair.alias("e")).select("e.u", "e.v").distinct()


def connected_components(
    records: DataFrame, references: DataFrame, record: str, item: str
) -> DataFrame:
    """``(record, component)``; the component is named by its smallest record.

    Alternates large-star and small-star until the edges stop changing. Rounds
    grow with the logarithm of the component size; each round is materialised
    in the shared checkpoint folder.
    """
    edges = cut_lineage(sharing_edges(references, record, item))
    seen = _fingerprint(edges)
    for _ in range(MAX_ROUNDS):
        edges = cut_lineage(_small_star(_large_star(edges, seen[0]), seen[0]))
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    labels = edges.select(F.col("u").alias(record), F.col("v").alias("component"))
    return records.select(record).distinct().join(labels, record, "left").withColumn(
        "component", F.coalesce("component", record))


def component_keys(members: DataFrame, record: str) -> DataFrame:
    """``(component, size, component_key)``; the key is a fingerprint of the member ids, whatever their number.

    It ignores their order and adds up, so no component is ever gathered in one row.
    """
    return members.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"),
        identity.set_fingerprint(F.sha2(F.col(record).cast("string"), 256)).alias("__print")
    ).select("component", "size", F.concat(F.lit("component|"), "__print").alias("component_key"))


def component_split(
    records: DataFrame, references: DataFrame, record: str, item: str,
    seed: str = identity.SPLIT_SEED,
) -> DataFrame:
    """``(record, component, size, split)``: records sharing an item share a split."""
    members = cut_lineage(connected_components(records, references, record, item))
    keyed = component_keys(members, record).select(
        "component", "size",
        identity.three_way_split(identity.bucket(F.col("component_key"), seed)).alias("split"))
    return join_spread(members, keyed, ["component"], "inner").select(
        record, "component", "size", "split")


def leaking_keys(df: DataFrame, key: Column | str, split: str = "split") -> DataFrame:
    """Per key: how many splits hold it and how often it repeats inside one split."""
    per_split = df.groupBy(F.col(key).alias("key") if isinstance(key, str) else key.alias("key"),
                           F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    return per_split.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_splits"),
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") - 1).alias("n_repeats_within"))


def split_overlap(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Shared keys for each pair of splits, all pairs from one grouping.

    A key lists the distinct splits that hold it, which are few by definition.
    """
    held = df.select(key, split).distinct().groupBy(key).agg(
        F.sort_array(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)
    pairs = F.flatten(F.transform(
        "splits", lambda a, i: F.transform(
            F.slice("splits", i + 2, F.size("splits")),
            lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return held.select(key, F.explode(pairs).alias("pair")).groupBy(
        "pair.split_a", "pair.split_b").agg(
        F.count(F.lit(1)).alias("shared_keys"), F.min(key).alias("first_example"))
