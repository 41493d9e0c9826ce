"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are centred on their mean, which leaves distances as they are, and
brought to length one. In each table fast Hadamard pseudo-rotations (signs,
Hadamard transform, three times over) turn them, and the nearest signed axis is
the code; several rotations give several codes. A query looks into the cells
whose axes are nearest to it (multiprobe), and every row found is ranked by its
distance on the original vectors in double precision.

Cells are dealt into blocks of bounded size on both sides, and each pair of
blocks is a task of its own that returns the best rows of each query. Equal
vectors take part as one with their smallest ids, which is all a ranking needs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalumen.llm.base import query, small_batches, table, written
from catalumen.llm.embedding_dup import usable
from catalumen.operators.joins import lookup

TABLES = 8
# Codes are joined until a cell of an even table would hold about this many vectors.
PER_CELL = 64
# The number of probes is fitted on about this many vectors and this many queries among them, to find this share.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_QUERIES, SHARE = 8192, 1 << 25, 256, 0.97
MOST_PROBES = 2048
BLOCK = 4096


class Index(NamedTuple):
    """What an index knows of the vectors of one size."""

    centre: np.ndarray
    codes: int
    probes: int


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-rotation of each row: three times random signs and a Hadamard transform, padded to a power of two."""
    wide = 1 << max(0, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), wide))
    out[:, :x.shape[1]] = x
    random = np.random.Generator(np.random.PCG64(seed))
    for _ in range(3):
        out *= random.integers(0, 2, wide) * 2.0 - 1
        h = 1
        while h < wide:
            pair = out.reshape(len(x), -1, 2, h)
            out = np.concatenate([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], -1).reshape(len(x), wide)
            h *= 2
        out /= math.sqrt(wide)
    return out


def directions(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Centred rows of length one; a row at the centre stays zero."""
    x = vectors - centre
    x /= np.maximum(np.abs(x).max(1, keepdims=True, initial=0), np.finfo(float).tiny)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), np.finfo(float).tiny)


def axes(x: np.ndarray, table: int, codes: int) -> list[np.ndarray]:
    """For each code of a table the products with all signed axes."""
    turned = [rotate(x, 1_000 * table + c) for c in range(codes)]
    return [np.concatenate([t, -t], 1) for t in turned]


def code(x: np.ndarray, table: int, codes: int) -> np.ndarray:
    """Each row's cell in a table."""
    out = np.zeros(len(x), np.int64)
    for values in axes(x, table, codes):
        out = out * values.shape[1] + values.argmax(1)
    return out


def probe(x: np.ndarray, table: int, codes: int, probes: int) -> np.ndarray:
    """Each row's nearest cells in a table, nearest first: least sum of squared distances below the best axes."""
    cells = costs = None
    for values in axes(x, table, codes):
        many = min(values.shape[1], probes)
        near = np.argsort(-values, axis=1, kind="stable")[:, :many]
        top = np.take_along_axis(values, near, 1)
        short = (top[:, :1] - top) ** 2
        if cells is None:
            cells, costs = near.astype(np.int64), short
            continue
        cells = (cells[:, :, None] * values.shape[1] + near[:, None, :]).reshape(len(x), -1)
        costs = (costs[:, :, None] + short[:, None, :]).reshape(len(x), -1)
        order = np.argsort(costs, axis=1, kind="stable")[:, :probes]
        cells, costs = np.take_along_axis(cells, order, 1), np.take_along_axis(costs, order, 1)
    return cells


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def fit_probes(x: np.ndarray, rows: int, best: int) -> tuple[int, int]:
    """``(codes, probes)``: cells for so many rows, and probes that find ``SHARE`` of the ``best`` nearest in the sample ``x``.

    The sample is thinner than the table, so its neighbours are farther off
    and need no fewer probes than the table's own.
    """
    wide = 2 << max(0, (x.shape[1] - 1).bit_length())
    asked = x[:SAMPLE_QUERIES]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    top = np.argsort(-near, axis=1, kind="stable")[:, :min(best, len(x) - 1)]
    for codes in range(max(1, round(math.log(max(rows / PER_CELL, 1), wide))), 0, -1):
        most = min(MOST_PROBES, wide ** codes)
        needed = np.full(top.shape, most)
        for t in range(TABLES):
            held, cells = code(x, t, codes), probe(asked, t, codes, most)
            order = np.argsort(cells, axis=1)
            for i in range(len(asked)):
                at = np.searchsorted(cells[i], held[top[i]], sorter=order[i])
                at = order[i][np.minimum(at, cells.shape[1] - 1)]
                hit = cells[i][at] == held[top[i]]
                needed[i] = np.where(hit, np.minimum(needed[i], at), needed[i])
        ranks = np.sort(needed.ravel())
        enough = ranks[min(len(ranks) - 1, math.ceil(SHARE * len(ranks)) - 1)] + 1 if len(ranks) else 1
        if enough <= most:
            break
    return codes, int(min(enough, most))


def fit(classes: DataFrame, best: int) -> dict[int, Index]:
    """For each vector size the mean over all vectors and what a bounded sample says about probes."""
    out = {}
    sizes = classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
    for size, rows in ((r["size"], r["n"]) for r in sizes):
        own = classes.filter(F.col("size") == size)
        means = own.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
        centre = np.zeros(size)
        centre[[r["at"] for r in means]] = [r["m"] for r in means]
        wanted = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * size)))
        share = max(1, math.ceil(rows / wanted))
        sample = own.filter(F.pmod(F.xxhash64(F.lit(12), "vector"), F.lit(share)) == 0).select("vector").limit(2 * wanted).toArrow()
        x = directions(matrix(sample.column("vector"), size), centre) if sample.num_rows else np.zeros((1, size))
        out[size] = Index(centre, *fit_probes(x, rows, best))
    return out


def celled(rows: DataFrame, index: dict[int, Index], asking: bool) -> DataFrame:
    """``rows`` once for each of their cells in all tables, as ``tab`` and ``cell``; queries have several a table."""

    def run(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                where = np.flatnonzero(sizes == size)
                known = index[size]
                x = directions(matrix(batch.column("vector").take(pa.array(where)), size), known.centre)
                for t in range(TABLES):
                    cells = probe(x, t, known.codes, known.probes) if asking else code(x, t, known.codes)[:, None]
                    part = batch.take(pa.array(np.repeat(where, cells.shape[1])))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(part.num_rows, t, np.int32)), pa.array(cells.ravel())], [*part.schema.names, "tab", "cell"])

    small_batches(rows.sparkSession)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, tab int, cell long")


RANKED = "ask long, asktag long, vec long, tag long, score double"


def ranked(asked: pa.Table, held: pa.Table, best: int) -> pa.Table:
    """The ``best`` nearest rows of each query in one pair of blocks."""
    schema = pa.schema([("ask", pa.int64()), ("asktag", pa.int64()), ("vec", pa.int64()), ("tag", pa.int64()), ("score", pa.float64())])
    if not asked.num_rows or not held.num_rows:
        return schema.empty_table()
    size = held.column("size")[0].as_py()
    q, x = matrix(asked.column("vector"), size), matrix(held.column("vector"), size)
    ids = held.column("ids").combine_chunks()
    starts, flat, tags = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy(), held.column("tag").to_numpy()
    middle = x.mean(0)
    q0, x0 = q - middle, x - middle
    lengths = (x0 * x0).sum(1)
    parts = []
    for start in range(0, len(q), 512):
        part = q0[start:start + 512]
        own = (part * part).sum(1)[:, None]
        near = own + lengths - 2 * part @ x0.T
        # Products lose digits: all that might be among the best are measured exactly.
        slack = 1e-12 * size * (own[:, 0] + lengths.max())
        limit = np.partition(near, best - 1, 1)[:, best - 1] + slack if near.shape[1] > best else np.full(len(part), np.inf)
        row, col = np.nonzero(near <= limit[:, None])
        for some in np.array_split(np.arange(len(row)), len(row) // 65_536 + 1):
            i, j = row[some], col[some]
            score = np.sqrt(((q[start + i] - x[j]) ** 2).sum(1))
            many = starts[j + 1] - starts[j]
            at = np.repeat(starts[j], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            parts.append((np.repeat(start + i, many), flat[at], np.repeat(tags[j], many), np.repeat(score, many)))
    who, vec, tag, score = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((tag, vec, score, who))
    who = who[order]
    first = np.searchsorted(who, who)
    order = order[np.arange(len(order)) - first < best]
    who = np.concatenate([p[0] for p in parts])[order]
    return pa.table([asked.column("ask").to_numpy()[who], asked.column("asktag").to_numpy()[who], vec[order], tag[order], score[order]], schema=schema)


def blocked(rows: DataFrame, sizes: DataFrame, keys: list[str], own: str, other: str, name: list[str]) -> DataFrame:
    """``rows`` with the block they are in and, once for each block of the other side, that block."""
    placed = lookup(rows, sizes, keys)
    blocks = {c: F.coalesce(f"{c}s", F.lit(1)) for c in (own, other)}
    return placed.withColumn(own, F.pmod(F.xxhash64(*name), blocks[own]).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), blocks[other] - 1))).drop(f"{own}s", f"{other}s")


def search(asked: DataFrame, held: DataFrame, keys: list[str], best: int) -> DataFrame:
    """The ``best`` rows of ``held`` for each query among those that share its ``keys``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return ranked(left, right, best)

    # Hashing twice costs less than writing every vector once for each table.
    counts = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).join(
        asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("asks")), keys)
    # Cells of one block on both sides need no look-up.
    large = written(counts.select(*keys, *[F.ceil(F.col(c) / BLOCK).cast("int").alias(f"{b}s") for c, b in (("rows", "block"), ("asks", "part"))]).filter(
        "blocks > 1 or parts > 1"), "large")
    cells = [*keys, "block", "part"]
    left = blocked(asked, large, keys, "part", "block", ["ask", "asktag"])
    right = blocked(held, large, keys, "block", "part", ["rep", "tag"])
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(run, RANKED)


def nearest(rows: DataFrame, asks: Column, best: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, key, score)``: the ``best`` nearest other rows found for each row where ``asks`` holds.

    ``score`` is the Euclidean distance of the original vectors in double
    precision; equal distances are ranked by key. Every row is indexed, and a
    query for which the index finds fewer than ``best`` rows is compared with
    all rows, in blocks. Which cells a query looks into is fitted on a sample of
    about ``SAMPLE_ROWS`` vectors (``SAMPLE_BYTES`` at most) to find ``SHARE`` of the
    nearest there. Rows whose key or vector is null, whose vector is empty, zero or
    has a null or non-finite component take no part, and vectors of
    different sizes are not compared. Rows equal in key and vector count
    once; rows that share a key only are rows of their own.
    """
    fit_rows = rows.filter(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("vec"), F.transform(vector, lambda x: x.cast("double") + 0).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    # The smallest ids of equal vectors are all that a ranking can need: the query itself and ``best`` others.
    by_id = Window.partitionBy("vector").orderBy("vec")
    few = fit_rows.withColumn("nth", F.dense_rank().over(by_id)).filter(F.col("nth") <= best + 1)
    classes = written(few.groupBy("vector").agg(F.min("vec").alias("rep"), F.array_sort(F.collect_set("vec")).alias("ids")).select(
        "rep", F.xxhash64("vector").alias("tag"), "ids", "vector", F.size("vector").alias("size")), "classes")
    asking = fit_rows.filter("asks").select(F.col("vec").alias("own"), "vector").distinct()
    asked = written(asking.groupBy("vector").agg(F.min("own").alias("ask")).select(
        "ask", F.xxhash64("vector").alias("asktag"), "vector", F.size("vector").alias("size")), "asked")
    index = fit(classes, best)
    who = ["ask", "asktag"]
    found = search(celled(asked, index, True), celled(classes, index, False), ["size", "tab", "cell"], best + 1)
    found = written(found.groupBy(*who, "vec", "tag").agg(F.min("score").alias("score")), "found")
    short = asked.join(found.groupBy(*who).agg(F.count(F.lit(1)).alias("n")), who, "left").filter(F.coalesce("n", F.lit(0)) <= best).drop("n")
    rest = search(short, classes, ["size"], best + 1)
    every = found.unionByName(rest).groupBy(*who, "vec", "tag").agg(F.min("score").alias("score"))
    by_score = Window.partitionBy(*who).orderBy("score", "vec", "tag")
    top = every.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= best + 1).drop("rank")
    named = asking.join(asked.select("vector", *who), "vector").select("own", *who)
    others = named.join(top, who).filter(~((F.col("own") == F.col("vec")) & (F.col("asktag") == F.col("tag"))))
    own_order = Window.partitionBy("own", "asktag").orderBy("score", "vec", "tag")
    return others.withColumn("rank", F.row_number().over(own_order)).filter(F.col("rank") <= best).select(
        F.col("own").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec").alias(key), "score")


@query("op12_nearest")
def op12_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
