"""Hard negatives by exact integer products in a residue number system.

Components become integers. For a few small primes the matrices of their
residues are multiplied in float32: residues lie around zero and the primes are
small enough that no partial sum passes 2^24, so every product is exact. The
signed scores come back by Chinese remaindering, as balanced digits in the mixed
radix of the primes, whose number follows from the largest norm.

Anchors and rows are dealt into blocks and each pair of blocks is a task. A first
round returns each anchor's best rows of its own label in a block, a second one
the best rows of other labels within the window below each positive's score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalumen.llm.base import query, table, written

# At most about so many rows or anchors a block, and so many scores at once.
BLOCK = 65_536
SCORES = 1 << 22
# Components that are multiplied before sums are reduced.
STRIP = 1024


def finite(vector: str) -> Column:
    """True for a vector without null or non-finite components."""
    return F.col(vector).isNotNull() & F.coalesce(
        F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def basis(size: int, bound: int) -> list[int]:
    """Odd primes, largest first, whose products tell all integers from ``-bound`` to ``bound`` apart."""
    half = math.isqrt((1 << 24) // max(1, min(size, STRIP)))
    out, product = [], 1
    for p in range(2 * half - 1, 2, -2):
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
            if product > 2 * bound + 1:
                return out
    raise ValueError(f"no {len(out)} primes below {2 * half} reach {bound}")


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers in double precision as the nearest-to-zero residues modulo ``p``."""
    out = np.mod(values, p)
    return np.where(out > p // 2, out - p, out).astype(np.float32)


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    out = np.mod(x, p)
    return np.where(out > p // 2, out - p, out)


class Residues:
    """A matrix of whole numbers as one float32 matrix a prime."""

    def __init__(self, values: np.ndarray, primes: list[int]):
        self.primes, self.parts = primes, [residues(values, p) for p in primes]

    def products(self, other: Residues, some: slice) -> np.ndarray:
        """Exact inner products of some rows with all rows of the other matrix."""
        digits: list[np.ndarray] = []
        for i, p in enumerate(self.primes):
            mine, theirs = self.parts[i][some], other.parts[i]
            total = np.zeros((len(mine), len(theirs)), np.int64)
            for at in range(0, mine.shape[1], STRIP):
                # Exact in float32: at most STRIP terms of (p / 2)^2 each.
                total += balanced((mine[:, at:at + STRIP] @ theirs[:, at:at + STRIP].T).astype(np.int64), p)
            radix = 1
            for digit, q in zip(digits, self.primes):
                total -= digit * (radix % p)
                radix *= q
            digits.append(balanced(np.mod(total, p) * pow(radix, -1, p), p) if i else balanced(total, p))
        # Sums wrap around modulo 2^64, and the result lies within a signed long.
        out, radix = np.zeros_like(digits[0]), 1
        for digit, q in zip(digits, self.primes):
            out += digit * np.int64((radix + 2 ** 63) % 2 ** 64 - 2 ** 63)
            radix *= q
        return out


def whole(table: pa.Table, size: int, scale: float) -> np.ndarray:
    """The integers of all vectors, in double precision."""
    given = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, size)
    return np.floor(given.astype(np.float64) * scale)


def scored(anchors: pa.Table, rows: pa.Table, primes: list[int], scale: float):
    """``(start, scores, same label, same row)`` for runs of anchors against all rows of a block."""
    size = rows.column("size")[0].as_py()
    left, right = Residues(whole(anchors, size, scale), primes), Residues(whole(rows, size, scale), primes)
    labels = anchors.column("label").to_pylist() + rows.column("label").to_pylist()
    labels = np.unique(np.array(labels), return_inverse=True)[1]
    mine, theirs = labels[:anchors.num_rows], labels[anchors.num_rows:]
    name, tag = (anchors.column(c).to_numpy() for c in ("anchor", "atag"))
    vec, own = (rows.column(c).to_numpy() for c in ("vec", "tag"))
    step = max(1, SCORES // rows.num_rows)
    for start in range(0, anchors.num_rows, step):
        some = slice(start, start + step)
        yield (start, left.products(right, some), mine[some, None] == theirs, (name[some, None] == vec) & (tag[some, None] == own))


def first(who: np.ndarray, most: int) -> np.ndarray:
    """True for the first ``most`` entries of each run of equal values."""
    return np.arange(len(who)) - np.searchsorted(who, who) < most


POSITIVES = pa.schema([(c, pa.int64()) for c in ("anchor", "atag", "pos", "ptag", "pscore")])
NEGATIVES = pa.schema([*POSITIVES, *[pa.field(c, pa.int64()) for c in ("vec", "tag", "score")]])


def best_positives(anchors: pa.Table, rows: pa.Table, primes: list[int], scale: float, most: int) -> pa.Table:
    """Each anchor's ``most`` best other rows of its label in a block."""
    vec, tag = rows.column("vec").to_numpy(), rows.column("tag").to_numpy()
    parts = [np.zeros((0, 4), np.int64)]
    for start, scores, same, itself in scored(anchors, rows, primes, scale):
        scores = np.where(same & ~itself, scores, np.iinfo(np.int64).min)
        least = np.partition(scores, -most, 1)[:, -most] if scores.shape[1] > most else np.full(len(scores), np.iinfo(np.int64).min)
        who, at = np.nonzero((scores >= least[:, None]) & same & ~itself)
        order = np.lexsort((tag[at], vec[at], -scores[who, at], who))
        order = order[first(who[order], most)]
        who, at = who[order], at[order]
        parts.append(np.stack([start + who, vec[at], tag[at], scores[who, at]], 1))
    found = np.concatenate(parts)
    names = [anchors.column(c).to_numpy()[found[:, 0]] for c in ("anchor", "atag")]
    return pa.table([*names, *found[:, 1:].T], schema=POSITIVES)


def best_negatives(anchors: pa.Table, rows: pa.Table, primes: list[int], scale: float, most: int, share: tuple[int, int]) -> pa.Table:
    """For each anchor and positive the ``most`` best rows of other labels in a block within the positive's window."""
    vec, tag = rows.column("vec").to_numpy(), rows.column("tag").to_numpy()
    positives = anchors.column("positives").combine_chunks()
    upto = positives.offsets.to_numpy() - positives.offsets[0].as_py()
    flat = positives.flatten()
    high = flat.field("pscore").to_numpy()
    low = -(-share[0] * high // share[1])
    count = np.diff(upto)
    parts = [np.zeros((0, 4), np.int64)]
    for start, scores, same, _ in scored(anchors, rows, primes, scale):
        here = np.arange(start, start + len(scores))
        # One pass for all windows of an anchor, then each window on what it left.
        wide_low, wide_high = np.minimum.reduceat(low, upto[here]), np.maximum.reduceat(high, upto[here])
        who, at = np.nonzero(~same & (scores >= wide_low[:, None]) & (scores <= wide_high[:, None]))
        score = scores[who, at]
        order = np.lexsort((tag[at], vec[at], -score, who))
        who, at, score = who[order], at[order], score[order]
        for nth in range(count[here].max()):
            there = np.minimum(upto[here] + nth, len(high) - 1)[who]
            fits = np.flatnonzero((count[here][who] > nth) & (score >= low[there]) & (score <= high[there]))
            fits = fits[first(who[fits], most)]
            parts.append(np.stack([there[fits], vec[at[fits]], tag[at[fits]], score[fits]], 1))
    found = np.concatenate(parts)
    of = np.repeat(np.arange(len(count)), count)[found[:, 0]]
    names = [anchors.column(c).to_numpy()[of] for c in ("anchor", "atag")]
    pairs = [flat.field(c).to_numpy()[found[:, 0]] for c in ("pos", "ptag", "pscore")]
    return pa.table([*names, *pairs, *found[:, 1:].T], schema=NEGATIVES)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: float = 256,
                   key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A component x counts as ``floor(scale * x)`` and a score is the exact inner
    product of such integers; higher scores come first, then smaller
    keys. An anchor's positives are its first other rows of the same label;
    for each, the negatives are the first rows of another label whose score is no higher than the
    positive's and at least ``share[0] / share[1]`` of it. All rows are
    compared with all anchors, in blocks. Rows whose key, label or vector is null
    or whose vector has a null or non-finite component take no part; vectors of
    different sizes are not compared. Rows equal in key, label and vector count once, rows that share
    a key only are rows of their own. Scores must fit a long: a table whose largest
    sum of squares reaches 2^62 stops with a ValueError.
    """
    fit = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & finite(vector)).select(
        F.col(key).cast("long").alias("vec"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asks"))
    fit = written(fit.groupBy("vec", "label", "vector").agg(F.max("asks").alias("asks")).withColumn(
        "tag", F.xxhash64("label", "vector")).withColumn("size", F.size("vector")), "integers")
    square = F.aggregate(F.transform("vector", lambda x: F.pow(F.floor(x.cast("double") * scale).cast("double"), 2.0)), F.lit(0.0), lambda a, x: a + x)
    sizes = fit.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks"), F.max(square).alias("square")).collect()
    if not sizes:
        sizes = [{"size": 0, "n": 0, "asks": 0, "square": 0.0}]
    if max(r["square"] for r in sizes) >= 2.0 ** 62:
        raise ValueError("scores would not fit a long: the largest sum of squares is %g" % max(r["square"] for r in sizes))
    # No score is larger than the largest sum of squares; a little more for its own rounding.
    primes = {r["size"]: basis(r["size"], int(r["square"] * 1.001) + 1) for r in sizes}
    parts = max(1, math.ceil(max(r["asks"] for r in sizes) / BLOCK))
    tasks = int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(max(r["n"] for r in sizes) / BLOCK), math.ceil(2 * tasks / parts))
    cell = ["size", "part", "block"]

    def dealt(asked: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        return asked.withColumn("part", F.pmod(F.xxhash64("anchor", "atag"), F.lit(parts)).cast("int")).withColumn("block", every)

    held = fit.drop("asks").withColumn("block", F.pmod(F.xxhash64("vec", "tag"), F.lit(blocks)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(asked: DataFrame, best, schema: pa.Schema) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            return best(left, right, primes[left.column("size")[0].as_py()])

        return dealt(asked).groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(run, ", ".join(f"{c} long" for c in schema.names))

    asked = fit.filter("asks").select(F.col("vec").alias("anchor"), F.col("tag").alias("atag"), "label", "vector", "size")
    order = Window.partitionBy("anchor", "atag").orderBy(F.desc("pscore"), "pos", "ptag")
    paired = search(asked, lambda a, b, p: best_positives(a, b, p, scale, positives), POSITIVES).withColumn("nth", F.row_number().over(order)).filter(
        F.col("nth") <= positives).groupBy("anchor", "atag").agg(F.collect_list(F.struct("pos", "ptag", "pscore")).alias("positives"))
    paired = written(asked.join(paired, ["anchor", "atag"]), "positives")
    order = Window.partitionBy("anchor", "atag", "pos", "ptag").orderBy(F.desc("score"), "vec", "tag")
    return search(paired, lambda a, b, p: best_negatives(a, b, p, scale, negatives, share), NEGATIVES).withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= negatives).select(
            F.col("anchor").alias("anchor_id"), F.col("pos").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            F.col("vec").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score"))


SQL = """
WITH fit AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INT AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
