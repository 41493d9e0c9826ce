"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest pivots in order of nearness. Inverted
lists name the vectors near each pivot; two vectors are compared if they share
enough pivots, and a link is confirmed by the cosine in double precision. A list
that is longer than one task should hold is dealt into blocks, and each pair of
blocks is a task of its own. Tasks return counts and a forest of links instead
of pairs, and equal vectors take part as one with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.llm.base import query, small_batches, table, written
from catalumen.llm.stars import components

# A vector is put into the lists of its NEAR nearest pivots; compared are those that share SHARED or more.
NEAR = 12
SHARED = 2
# Pivots: about the root of the number of vectors, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 32, 2048
BLOCK = 2048


def usable(vector: str) -> Column:
    """True for a vector without null or non-finite components that is not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of length one in double precision."""
    rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def choose_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector size fixed random directions, the same on every run.

    Normal components make the products of two vectors with a pivot normal with
    their cosine as correlation, so which pivots two vectors share depends on
    their cosine alone. Pivots sampled from the vectors would crowd where the
    vectors do, and members of a dense group would each be near pivots of their own.
    """
    out = {}
    for r in classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").collect():
        count = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << math.ceil(math.log2(math.sqrt(r["n"])))))
        out[r["size"]] = np.random.Generator(np.random.PCG64(r["size"])).standard_normal((count, r["size"]))
    return out


def describe(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``classes`` with ``near``, the pivots nearest first; alone of its size, a vector has none."""

    def run(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            near: list = [[]] * batch.num_rows
            for size in np.unique(sizes):
                if size not in pivots:
                    continue
                where = np.flatnonzero(sizes == size)
                cosine = unit(batch.column("vector").take(pa.array(where)), int(size)) @ pivots[size].T
                order = np.argsort(-cosine, axis=1, kind="stable")[:, :NEAR]
                for i, row in zip(where.tolist(), order.astype(np.int32)):
                    near[i] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.list_(pa.int32()))], [*batch.schema.names, "near"])

    small_batches(classes.sparkSession)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{kinds}, near array<int>")


def roots(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name that each row reaches through the links of a symmetric matrix."""
    now = names.copy()
    while True:
        least = np.minimum(now, np.where(linked, now[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        # Jump to the root's root as well, so that long chains settle in few rounds.
        place = np.searchsorted(names, least)
        least = np.minimum(least, now[place])
        if (least == now).all():
            return now
        now = least


def compare(found: pa.Table, least: float) -> pa.Table:
    """Links of one cell of an inverted list: ``(rep, n, root)`` of each vector that has any.

    A pair that shares several pivots is counted in the list of the lowest one only.
    """
    size, pivot = found.column("size")[0].as_py(), found.column("pivot")[0].as_py()
    found = found.sort_by("rep")
    names, block = found.column("rep").to_numpy(), found.column("block").to_numpy()
    rows = unit(found.column("vector").combine_chunks(), size)
    linked = rows @ rows.T >= least
    np.fill_diagonal(linked, False)
    if block.min() != block.max():
        # A cell of two blocks is for the pairs between them.
        linked &= block[:, None] != block[None, :]
    some = np.flatnonzero(linked.any(1))
    linked, names = linked[np.ix_(some, some)], names[some]
    weight = found.column("weight").to_numpy()[some]
    if len(some):
        near = found.column("near").combine_chunks().flatten().to_numpy().reshape(len(block), -1)[some]
        used = np.unique(near)
        held = np.zeros((len(some), len(used)), np.float32)
        held[np.arange(len(some))[:, None], np.searchsorted(used, near)] = 1
        linked &= held @ held.T >= SHARED
        lower = held[:, :np.searchsorted(used, pivot)]
        linked &= lower @ lower.T == 0
    count = linked @ weight
    some = np.flatnonzero(count)
    names = names[some]
    return pa.table({"rep": names, "n": count[some].astype(np.int64), "root": roots(linked[np.ix_(some, some)], names)})


def near_vectors(rows: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(key, n_links, component)`` for every row.

    Rows with equal labels are linked if the cosine of their vectors is
    ``least`` or more; ``n_links`` counts the other rows linked directly and
    ``component`` is the smallest key that links lead to. Rows whose key, label
    or vector is null, whose vector is empty, zero or has a null or non-finite
    component, and vectors of different sizes are linked with nothing. Rows
    that share a key are rows of their own, each with its own links.
    """
    all_rows = rows.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    fit = all_rows.filter(F.col("key").isNotNull() & F.col("label").isNotNull() & usable("vector"))
    classes = written(fit.groupBy("label", "vector").agg(
        F.min("key").alias("least"), F.count(F.lit(1)).alias("weight")).withColumn("size", F.size("vector")).withColumn(
        # Numbers of their own, fixed by being written: a key may stand for two vectors.
        "rep", F.monotonically_increasing_id()), "classes")
    described = written(describe(classes, choose_pivots(classes)), "described")
    entries = described.withColumn("pivot", F.explode("near"))
    lists = entries.groupBy("label", "size", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = entries.join(lists, ["label", "size", "pivot"]).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = placed.withColumn("other", other).select(
        "label", "size", "pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "rep", "weight", "vector", "near")

    def run(found: pa.Table) -> pa.Table:
        return compare(found, least)

    links = written(cells.groupBy("label", "size", "pivot", "low", "high").applyInArrow(run, "rep long, n long, root long"), "links")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    named = components(links, "rep", "root").withColumnRenamed("node", "rep")
    joined = classes.select("rep", "least").join(named, "rep")
    lowest = joined.groupBy("component").agg(F.min("least").alias("lowest"))
    found = joined.join(lowest, "component").select("rep", "lowest")
    by_class = classes.join(counts, "rep", "left").join(found, "rep", "left").select(
        "label", "vector", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("lowest", "least").alias("component"))
    linked = fit.join(by_class, ["label", "vector"]).select("key", "n_links", "component")
    rest = all_rows.filter(~F.coalesce(F.col("key").isNotNull() & F.col("label").isNotNull() & usable("vector"), F.lit(False)))
    return linked.unionByName(rest.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))).select(
        F.col("key").alias(key), "n_links", "component")


SQL = """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a
"""


@query("op7_embedding_dup", SQL)
def op7_embedding_dup(spark, sf_dir):
    found = near_vectors(table(spark, sf_dir, "embeddings"), 0.93)
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"),
                        (F.col("vec_id") == F.col("component")).alias("kept"))
