"""Near-duplicate documents: MinHash bands find candidates, signatures and full sets confirm them.

Documents with the same set of shingles form a class; only its smallest
document goes on. Bands of minima put similar documents into common buckets. A
bucket is split by set size, since similar sets are of similar size, and its
pairs are never listed: first every member is compared with the best of its
buckets' centres, the members that meet most others, as the original of many near
copies does; then, in buckets that are not yet one component, with all that the
signatures do not rule out, the nearest first. Pairs inside one component are left out, so near copies cost little whatever
their number, and no link between different components is lost. A pair that meets
in several buckets belongs to the first of them. Buckets are dealt into blocks,
each pair of blocks is a cell, and a cell's sets are compared where they meet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.llm.base import flat_bytes, query, row_slices, small_batches, table, written
from catalumen.llm.hashing import U, WordRun, mix, randoms
from catalumen.llm.stars import components
from catalumen.operators.joins import broadcast_if_small

ROWS = 6
# Chance that the bands miss a pair at the threshold, and distance in standard deviations below
# it at which the signature alone rejects a pair.
MISS = 1e-6
SIGMAS = 5.0
# Members of a bucket that one task compares with as many others.
BLOCK = 512


def n_bands(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one has none."""
    data, at = flat_bytes(texts)
    run = WordRun(data, at, lower=True)
    hashes, where = run.windows(words, seed=2)
    first = np.searchsorted(where, run.upto)
    count = np.diff(run.upto)
    short = randoms(words, 3)
    out = []
    for i, n in enumerate(count.tolist()):
        if n >= words:
            out.append(np.unique(hashes[first[i]:first[i + 1]]))
        elif n:
            own = run.hash[run.upto[i]:run.upto[i + 1]]
            out.append(mix((own * short[:n]).sum(keepdims=True, dtype=U) + U(n)))
        else:
            out.append(np.zeros(0, U))
    return out


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The least value of ``count`` universal hashes over each non-empty set."""
    out = np.empty((len(sets), count), U)
    factors, terms = randoms(count, 4), randoms(count, 5)
    first = 0
    while first < len(sets):
        # Some whole sets at a time, few enough to stay in the processor's cache.
        last, size = first + 1, len(sets[first])
        while last < len(sets) and size + len(sets[last]) <= 1 << 15:
            size += len(sets[last])
            last += 1
        values = np.concatenate(sets[first:last])
        starts = np.cumsum([0] + [len(s) for s in sets[first:last - 1]])
        room = np.empty_like(values)
        for k in range(count):
            np.multiply(values, factors[k], out=room)
            room += terms[k]
            out[first:last, k] = np.minimum.reduceat(room, starts)
        first = last
    return out


def signatures(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """``(key, n_shingles, digest, signature, bands)`` of ``docs(key, text)``; an empty text has no digest."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"), words)
                filled = [s for s in sets if len(s)]
                least = minima(filled, bands * ROWS)
                short = (least >> U(56)).astype(np.uint8)
                mixed = np.arange(bands, dtype=U) * U(0x9E3779B97F4A7C15)
                for r in range(ROWS):
                    mixed = mix(mixed ^ least[:, r::ROWS])
                digest, signature, band, i = [], [], [], 0
                for s in sets:
                    if len(s):
                        digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        signature.append(short[i].tobytes())
                        band.append(mixed[i].astype(np.int64))
                        i += 1
                    else:
                        digest.append(None)
                        signature.append(None)
                        band.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                     pa.array(signature, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
                    ["key", "n_shingles", "digest", "signature", "bands"])

    return docs.mapInArrow(run, "key long, n_shingles long, digest binary, signature binary, bands array<long>")


def least_agreement(similarity: float, count: int) -> float:
    """Signature places that two sets of the required similarity agree in, with room for chance."""
    chance = similarity + (1 - similarity) / 256
    return count * chance - SIGMAS * math.sqrt(count * chance * (1 - chance))


def likely(pairs: DataFrame, least: float) -> DataFrame:
    """``(a, b, agree)`` of the pairs whose signatures agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, _ = flat_bytes(batch.column("signature_a"))
            b, _ = flat_bytes(batch.column("signature_b"))
            agree = (a == b).reshape(batch.num_rows, -1).sum(1)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(agree, pa.int64())], ["a", "b", "agree"])
            yield out.filter(pa.array(agree >= least))

    return pairs.mapInArrow(run, "a long, b long, agree long")


def confirmed(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("set_a"), batch.column("set_b"))
            keep = [similar(*(np.frombuffer(x.as_buffer(), U) for x in ab), percent) for ab in sets]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def between(cell: dict[str, np.ndarray], least: float) -> np.ndarray:
    """Pairs of a cell's members in different components whose signatures agree, those that agree most first.

    The members of the cell's largest component need not ask; all others ask for
    themselves. Left out are pairs that meet in an earlier band, and in a band
    those that belong to another size class.
    """
    keys, component, block, own = cell["key"], cell["component"], cell["block"], cell["own"]
    names, times = np.unique(component, return_counts=True)
    out = []
    for i in np.flatnonzero(component != names[times.argmax()]).tolist():
        other = (component != component[i]) & (np.maximum(own, own[i]) == cell["level"][0])
        if cell["low"][0] != cell["high"][0]:
            other &= block != block[i]
        where = np.flatnonzero(other)
        where = where[(cell["bands"][where] == cell["bands"][i]).argmax(1) == cell["band"][0]]
        agree = (cell["signature"][where] == cell["signature"][i]).sum(1)
        good = np.flatnonzero(agree >= least)
        other = keys[where[good]]
        out.append(np.stack([np.minimum(other, keys[i]), np.maximum(other, keys[i]), -agree[good]], 1))
    if not out:
        return np.zeros((0, 2), np.int64)
    found = np.unique(np.concatenate(out), axis=0)
    return found[np.argsort(found[:, 2], kind="stable"), :2]


CELL = ["bucket", "low", "high"]


def by_cell(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str, *order: str) -> DataFrame:
    """``work`` on the rows of each cell; a task holds one cell at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            cell = [table.column(c).to_numpy() for c in CELL]
            turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1
            start = 0
            for stop in turns.tolist():
                if (out := work(table.slice(start, stop - start).combine_chunks())) is not None:
                    yield out
                start = stop
            # The last cell may go on in the next batch.
            held = table.slice(start)
        if held is not None and (out := work(held.combine_chunks())) is not None:
            yield out

    return rows.repartition(*CELL).sortWithinPartitions(*CELL, *order).mapInArrow(run, schema)


def open_pairs(placed: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """``(bucket, low, high, pairs, keys)`` for the cells of buckets with several components.

    ``pairs`` are the keys of all pairs to compare, in one row for each cell, and
    ``keys`` the members that take part.
    """
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    flat = ("low", "high", "block", "key", "component", "own", "level", "band")
    # Members are dealt out while their rows are narrow. Of a band's name four bytes tell it from the others.
    cells = dealt.withColumn("other", other).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *flat[2:]).join(
        reps.select("key", "signature", F.transform("bands", lambda b: b.bitwiseAND(0x7FFFFFFF).cast("int")).alias("bands")), "key")

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        cell = {c: rows.column(c).to_numpy() for c in flat}
        for c, kind in (("signature", np.uint8), ("bands", np.int32)):
            column = rows.column(c).combine_chunks()
            data = flat_bytes(column)[0] if kind is np.uint8 else column.flatten().to_numpy()
            cell[c] = data.reshape(len(rows), -1)
        found = between(cell, least)
        if not len(found):
            return None
        return pa.RecordBatch.from_arrays(
            [*(rows.column(c)[:1].combine_chunks() for c in CELL), pa.array([found.astype(np.int64).tobytes()], pa.binary()),
             pa.array([np.unique(found)], pa.list_(pa.int64()))], [*CELL, "pairs", "keys"])

    return by_cell(cells, work, "bucket long, low int, high int, pairs binary, keys array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def compared(lists: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links that connect all members of a cell that the links among its pairs connect."""
    percent = round(similarity * 100)
    needed = lists.select(*CELL, F.explode("keys").alias("key")).join(sets, "key").select(
        *CELL, "key", "set", F.lit(None).cast("binary").alias("pairs"))
    rows = lists.select(*CELL, F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("set"), "pairs")

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        pairs = np.frombuffer(rows.column("pairs")[0].as_py(), np.int64).reshape(-1, 2)
        held = {k.as_py(): np.frombuffer(s.as_py(), U) for k, s in zip(rows.column("key")[1:], rows.column("set")[1:])}
        root = {k: k for k in held}

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        links = []
        for a, b in pairs.tolist():
            x, y = find(a), find(b)
            # What is already connected needs no further link.
            if x != y and similar(held[a], held[b], percent):
                root[max(x, y)] = min(x, y)
                links.append((a, b))
        if not links:
            return None
        a, b = zip(*links)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return by_cell(rows.unionByName(needed), work, "a long, b long", "key")


def with_both(pairs: DataFrame, of_each: DataFrame, column: str) -> DataFrame:
    """``column`` of both ends; ``of_each`` has one row for each key."""
    for end in "ab":
        side = of_each.select(F.col("key").alias(end), F.col(column).alias(f"{column}_{end}"))
        pairs = pairs.join(side, end)
    return pairs


def full_sets(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """``(key, set)`` of the documents named in ``keys``, which are sent to all tasks while they are few."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", 1 << 20):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.binary())], ["key", "set"])

    wanted = docs.filter(F.col("text").isNotNull()).join(broadcast_if_small(keys), "key")
    return wanted.mapInArrow(run, "key long, set binary")


def merge(members: DataFrame, reps: DataFrame, sets: DataFrame, similarity: float, count: int) -> DataFrame | None:
    """Components ``(node, component)`` of the confirmed links among the members of all buckets."""
    least = least_agreement(similarity, count)
    centres = members.groupBy("bucket").agg(F.max_by("key", F.struct("weight", "key")).alias("b"))
    pairs = members.join(centres, "bucket").filter("key <> b").select(F.col("key").alias("a"), "b").distinct()
    best = likely(with_both(pairs, reps, "signature"), least).groupBy("a").agg(
        F.max_by("b", F.struct("agree", "b")).alias("b"))
    links = written(confirmed(with_both(best, sets, "set"), similarity), "links")
    found = None if links.isEmpty() else components(links, "a", "b")
    if found is None:
        placed = members.withColumn("component", F.col("key"))
    else:
        placed = members.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn(
            "component", F.coalesce("component", "key"))
    several = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    lists = written(open_pairs(written(placed.join(several, "bucket"), "open-buckets"), reps, least), "pairs")
    more = written(compared(lists, sets, similarity), "links")
    return found if more.isEmpty() else components(links.unionByName(more), "a", "b")


def by_size(members: DataFrame, similarity: float) -> DataFrame:
    """Members with their buckets split by set size: ``(bucket, band, own, level, key, weight)``.

    Sets of the required similarity are in the same size class or in neighbouring
    ones, so each member is put into its ``own`` class and into the next; ``level``
    is the class of the bucket. The weight counts all whom a member meets.
    """
    step = -math.log(similarity) * (1 + 1e-9)
    size_class = F.floor(F.log("n_shingles") / F.lit(step)).cast("int")
    split = members.withColumn("own", size_class).withColumn(
        "level", F.explode(F.array(F.col("own"), F.col("own") + 1))).select(
        F.xxhash64("bucket", "level").alias("bucket"), "band", "own", "level", "key")
    shared = split.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    kept = written(split.join(shared.select("bucket", "n"), "bucket"), "buckets")
    return kept.drop("n").join(kept.groupBy("key").agg(F.sum("n").alias("weight")), "key")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5,
                    similarity: float = 0.8) -> DataFrame:
    """``(key, n_shingles, component)`` for every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of
    ``words``-word shingles (A-Z in lower case) is at least ``similarity``, in
    whole hundredths. ``component`` is the smallest key that links lead to. A
    null or empty text is linked with nothing. Rows that share a key are each
    judged by their own text; rows without a key are linked with nothing and
    have no component. Other columns, whatever their names, are not read.
    """
    bands = n_bands(similarity)
    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = written(signatures(keyed, words, bands), "signatures")
    known = signed.filter(F.col("key").isNotNull() & F.col("digest").isNotNull())
    classes = known.groupBy("digest").agg(F.min("key").alias("rep"))
    # Joined on both columns, so that only the smallest rows of a class meet, however large it is.
    one_each = known.withColumnRenamed("key", "rep").join(classes, ["digest", "rep"]).select(
        F.col("rep").alias("key"), "digest", "n_shingles", "signature", "bands")
    reps = written(one_each.dropDuplicates(["key", "digest"]), "representatives")

    held = reps.select(F.posexplode("bands").alias("band", "bucket"), "key", "n_shingles")
    shared = held.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    members = written(by_size(held.join(shared.select("bucket"), "bucket").distinct(), similarity), "members")
    sets = written(full_sets(keyed, members.select("key").distinct(), words).distinct(), "sets")
    found = merge(members, reps.select("key", "signature", "bands"), sets, similarity, bands * ROWS)

    placed = signed.join(classes, "digest", "left").withColumn("rep", F.when(F.col("key").isNotNull(), F.coalesce("rep", "key")))
    if found is None:
        named = placed.withColumnRenamed("rep", "component")
    else:
        named = placed.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep"))
    return named.select(F.col("key").alias(key), "n_shingles", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5,
             similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but of each component only the document with the smallest key.

    Rows that share a key and rows without a key go together: all or none of them stay.
    """
    found = near_duplicates(docs, key, text, words, similarity)
    gone = written(found.filter(F.col(key) != F.col("component")).select(key).distinct(), "removed")
    return docs.join(broadcast_if_small(gone), key, "left_anti").select(*docs.columns)


@query("op5_near_dup")
def op5_near_dup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=0.85)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"),
                        (F.col("doc_id") == F.col("component")).alias("kept"))
