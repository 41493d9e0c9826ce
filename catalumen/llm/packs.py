"""Texts in packs, and the exchange by which packs learn which of their keys other packs have too.

A pack holds some megabytes of whole texts in one row. A pack sends each
distinct key once, whatever the number of its texts that have it, so that a key
that a third of all texts share arrives once from each pack; keys meet in
buckets by their leading bits, and each pack gets back one bit for each key. Both
ways, keys travel as sorted, compressed runs instead of as one row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.llm.base import flat_bytes, offsets, row_slices, small_batches
from catalumen.llm.hashing import U

PACK_BYTES = 4 << 20
# Keys that a bucket holds on average; each bucket is one task's work.
BUCKET_KEYS = 1 << 20
# A text without a key comes after all others.
NO_KEY = np.iinfo(np.int64).max


def packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(pack, keys, ends, data, size)``: rows of ``docs`` in packs; write it before use, so that numbers stay."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def pack(parts: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            data = b"".join(flat_bytes(p.column("text"))[0].tobytes() for p in parts)
            ends = np.cumsum(np.concatenate([np.diff(offsets(p.column("text"))) for p in parts]), dtype=np.int64)
            keys = [k for p in parts for k in p.column("key").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())),
                 pa.array([press.compress(data)], pa.binary()), pa.array([len(data)], pa.int64())],
                ["pack", "keys", "ends", "data", "size"])

        for batch in batches:
            for part in row_slices(batch, "text", PACK_BYTES):
                own = len(flat_bytes(part.column("text"))[0])
                if held and size + own > PACK_BYTES:
                    yield pack(held)
                    held, size = [], 0
                # A copy, so that the batch it came in can go.
                held.append(part.take(pa.array(np.arange(part.num_rows))))
                size += own
        if held:
            yield pack(held)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "pack long, keys array<long>, ends array<long>, data binary, size long")


class Pack:
    """One pack, opened: its number, the texts' keys (null and as numbers), all bytes and where each text starts."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        import zstandard

        self.number = batch.column("pack")[row].as_py()
        self.keys = batch.column("keys")[row].values
        self.order = self.keys.fill_null(NO_KEY).to_numpy(zero_copy_only=False)
        self.at = np.concatenate([[0], batch.column("ends")[row].values.to_numpy()]).astype(np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(
            batch.column("data")[row].as_py(), max_output_size=max(1, int(self.at[-1]))), np.uint8)


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed planes of the bytes of their differences."""
    import zstandard

    steps = np.diff(keys, prepend=U(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(8 * n, 1)), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(U).ravel(), dtype=U)


def n_buckets(packs: DataFrame, keys_per_byte: float) -> int:
    """A power of two, so that leading bits name the bucket, with about ``BUCKET_KEYS`` keys in each."""
    total = packs.agg(F.sum("size")).first()[0] or 0
    return 1 << max(6, math.ceil(math.log2(max(1.0, total * keys_per_byte / BUCKET_KEYS))))


def low_and_high(keys: np.ndarray, key_bits: int) -> bytes:
    """Sorted distinct numbers below ``2**key_bits`` in two bits each more than the logarithm of their mean distance.

    The low bits of all stand as they are; the high ones are steps in one bitmap.
    """
    n = len(keys)
    low = max(0, key_bits - max(0, n - 1).bit_length())
    parts = [(keys >> U(b)).astype(np.uint8).tobytes() for b in range(0, low - 7, 8)]
    parts += [np.packbits((keys >> U(b)).astype(np.uint8) & 1).tobytes() for b in range(low // 8 * 8, low)]
    steps = np.zeros(n + (1 << (key_bits - low)), np.uint8)
    steps[(keys >> U(low)).astype(np.int64) + np.arange(n)] = 1
    return b"".join([*parts, np.packbits(steps).tobytes()])


def from_low_and_high(data: bytes, n: int, key_bits: int) -> np.ndarray:
    low, at = max(0, key_bits - max(0, n - 1).bit_length()), 0
    out, flat, plane = np.zeros(n, np.int64), np.frombuffer(data, np.uint8), -(-n // 8)
    for b in range(0, low - 7, 8):
        out |= flat[at:at + n].astype(np.int64) << b
        at += n
    for b in range(low // 8 * 8, low):
        out |= np.unpackbits(flat[at:at + plane], count=n).astype(np.int64) << b
        at += plane
    return out | (np.flatnonzero(np.unpackbits(flat[at:])) - np.arange(n)) << low


def send(packs: DataFrame, keys_of: Callable, buckets: int, key_bits: int = 64, ranked: bool = False, pressed: Callable = squeeze) -> DataFrame:
    """``(bucket, pack, n, keys, ranks)`` from ``keys_of(pack, replies)``, which gives sorted distinct 64-bit keys.

    With ``ranked`` it gives a rank for each key as well. Of a key, its bucket
    and the ``key_bits`` behind that are sent; ``pressed`` makes bytes of a bucket's keys.
    """
    shift, width = U(64 - buckets.bit_length() + 1), buckets.bit_length() - 1
    drop = U(max(0, 64 - width - key_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = Pack(batch, row)
                keys, ranks = keys_of(own, replies_in(batch, row))
                edges = np.searchsorted(keys, np.arange(buckets, dtype=U) << shift).tolist() + [len(keys)]
                out = [(b, edges[b], edges[b + 1]) for b in range(buckets) if edges[b] < edges[b + 1]]
                sent = (keys & ((U(1) << shift) - U(1))) >> drop
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in out], pa.int32()), pa.array([own.number] * len(out), pa.int64()),
                     pa.array([j - i for _, i, j in out], pa.int32()), pa.array([pressed(sent[i:j]) for _, i, j in out], pa.binary()),
                     pa.array([ranks[i:j].tobytes() if ranked else None for _, i, j in out], pa.binary())],
                    ["bucket", "pack", "n", "keys", "ranks"])

    return packs.mapInArrow(run, "bucket int, pack long, n int, keys binary, ranks binary")


def answer(sent: DataFrame, name: str) -> DataFrame:
    """``(pack, name, bucket, n, marks)``: for each key sent, whether it came from another pack too.

    If ranks were sent, whether it came from another pack with a smaller rank.
    """

    def run(table: pa.Table) -> pa.Table:
        count = table.column("n").to_numpy()
        runs = [unsqueeze(k.as_py(), int(n)) for k, n in zip(table.column("keys"), count)]
        # A pack may send a key twice only if dropped bits made two keys one.
        if table.column("ranks").null_count:
            every = np.sort(np.concatenate([np.unique(r) for r in runs]))
            shared = every[1:][every[1:] == every[:-1]]
            marks = [is_in(r, shared) for r in runs]
        else:
            ranks = [np.frombuffer(r.as_py(), np.int64) for r in table.column("ranks")]
            every, rank = np.concatenate(runs), np.concatenate(ranks)
            order = np.argsort(every, kind="stable")
            every, rank = every[order], rank[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            least, every = np.minimum.reduceat(rank, first), every[first]
            marks = [least[np.searchsorted(every, r)] < own for r, own in zip(runs, ranks)]
        return pa.table({
            "pack": table.column("pack"), "name": pa.array([name] * len(runs)), "bucket": table.column("bucket"),
            "n": table.column("n"), "marks": pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "pack long, name string, bucket int, n int, marks binary")


def send_short(packs: DataFrame, keys_of: Callable, buckets: int, key_bits: int) -> DataFrame:
    """``send`` for keys that stay distinct when cut to the bucket and ``key_bits`` more."""
    return send(packs, keys_of, buckets, key_bits, pressed=lambda keys: low_and_high(keys, key_bits))


def answer_short(sent: DataFrame, name: str, key_bits: int) -> DataFrame:
    """``answer`` for ``send_short``: packs are counted, up to two, in a table with a place for each key a bucket can have."""

    def run(table: pa.Table) -> pa.Table:
        runs = [from_low_and_high(k.as_py(), n, key_bits) for k, n in zip(table.column("keys"), table.column("n").to_pylist())]
        seen = np.zeros(1 << key_bits, np.uint8)
        for r in runs:
            now = seen[r]
            now += now < 2
            seen[r] = now
        return pa.table({
            "pack": table.column("pack"), "name": pa.array([name] * len(runs)), "bucket": table.column("bucket"),
            "n": table.column("n"), "marks": pa.array([np.packbits(seen[r] > 1).tobytes() for r in runs], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "pack long, name string, bucket int, n int, marks binary")


def is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def with_replies(packs: DataFrame, *replies: DataFrame) -> DataFrame:
    """Packs with all that has come back for them; a pack has at most one reply of a name for each bucket."""
    every = replies[0]
    for more in replies[1:]:
        every = every.unionByName(more)
    own = every.groupBy("pack").agg(F.collect_list(F.struct("name", "bucket", "n", "marks")).alias("replies"))
    return packs.join(own, "pack", "left")


def replies_in(batch: pa.RecordBatch, row: int) -> dict[str, np.ndarray]:
    """By name, one mark for each key in the order in which the pack sent them."""
    if "replies" not in batch.schema.names or not batch.column("replies")[row].is_valid:
        return {}
    by_name: dict[str, list] = {}
    for r in batch.column("replies")[row].as_py():
        by_name.setdefault(r["name"], []).append((r["bucket"], np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=r["n"])))
    return {name: np.concatenate([m for _, m in sorted(rows, key=lambda x: x[0])]).astype(bool) for name, rows in by_name.items()}
