"""Stable hash placement of record ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugemill.settings import HASH_BUCKETS, INCOMING_EVAL_FRACTION, INCOMING_SPLIT_SALT


def salted_digest(record_id: Column, salt: Column | str) -> Column:
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.sha2(F.concat_ws(":", salt, record_id.cast("string")), 256)


def digest_mod(digest: Column, modulus: int) -> Column:
    """A 256-bit hex digest modulo ``modulus``: weighted sum of its eight 32-bit limbs."""
    total = None
    for limb in range(8):
        weight = pow(2, 32 * (7 - limb), modulus)
        value = F.conv(F.substring(digest, 8 * limb + 1, 8), 16, 10).cast("bigint") % modulus
        total = value * weight if total is None else total + value * weight
    return total % modulus


def hash_position(record_id: Column, salt: Column | str) -> Column:
    """Position of an id in [0, 1)."""
    return digest_mod(salted_digest(record_id, salt), HASH_BUCKETS) / F.lit(float(HASH_BUCKETS))


def is_holdout(
    record_id: Column,
    fraction: float = INCOMING_EVAL_FRACTION,
    salt: Column | str = INCOMING_SPLIT_SALT,
) -> Column:
    return hash_position(record_id, salt) < fraction


def ab_variant(record_id: Column, test_id: Column | str) -> Column:
    """A for an even digest, B for an odd one."""
    last = F.substring(salted_digest(record_id, test_id), -1, 1)
    return F.when(last.isin("0", "2", "4", "6", "8", "a", "c", "e"), "A").otherwise("B")
