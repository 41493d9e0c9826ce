"""Deterministic ids, hash buckets, splits and order-free fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPLIT_SEED = "phase-a-split-v001"
BUCKETS = 100_000
TRAIN_BELOW = 80_000
VALIDATION_BELOW = 90_000
TWO_WAY_TRAIN_BELOW = 90_000
ID_HEX_DIGITS = 16


def record_id(prefix: str, *keys: Column) -> Column:
    """``prefix:`` and the first 16 hex digits of SHA-256 over the joined keys.

    A missing key counts as an empty string, so positions never shift.
    """
    parts = [F.coalesce(key.cast("string"), F.lit("")) for key in keys]
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit(f"{prefix}:"), F.substring(digest, 1, ID_HEX_DIGITS))


def record_id_is_well_formed(column: Column, prefix: str) -> Column:
    return column.rlike(rf"^{prefix}:[0-9a-f]{{{ID_HEX_DIGITS}}}$")


def bucket(key: Column, seed: str = SPLIT_SEED) -> Column:
    """Unsigned 64-bit head of SHA-256 over ``seed|key``, modulo 100000."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)
    # The 64 bits are taken as two halves, so the remainder stays within a long.
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return ((high * F.lit(2**32 % BUCKETS) + low) % F.lit(BUCKETS)).cast("int")


def three_way_split(bucket_column: Column) -> Column:
    return (
        F.when(bucket_column < TRAIN_BELOW, "train")
        .when(bucket_column < VALIDATION_BELOW, "validation")
        .otherwise("test")
    )


def two_way_split(bucket_column: Column) -> Column:
    return F.when(bucket_column < TWO_WAY_TRAIN_BELOW, "train").otherwise("validation")


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON with sorted keys and explicit nulls."""
    fields = [columns[name].alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def content_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def digest_lanes(digest: Column) -> list[Column]:
    """Two 60-bit integers from a 64-digit hex digest, as exact decimals."""
    return [
        F.conv(F.substring(digest, 1 + 15 * lane, 15), 16, 10).cast("decimal(28,0)")
        for lane in range(2)
    ]


def set_fingerprint(row_digest: Column) -> Column:
    """Aggregate: a fingerprint of a multiset of rows that ignores their order.

    Sums are combined map-side, so no group is ever gathered in one place.
    """
    sums = [F.sum(lane).cast("decimal(38,0)").cast("string") for lane in digest_lanes(row_digest)]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256)
