"""Deterministic pseudo-random values from row keys.

md5 is available in every SQL engine, so a seeded split or bag can be reproduced
outside Spark, and a retried task draws the same values as the first attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HEX_DIGITS = 13  # 52 bits: exact in a DOUBLE


def key_digest(key: Column, seed: Column | int) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", key.cast("string"), seed.cast("string")))


def key_number(key: Column, seed: Column | int) -> Column:
    """An integer-valued DOUBLE in [0, 2**52) that orders like the md5 digest."""
    return F.conv(F.substring(key_digest(key, seed), 1, _HEX_DIGITS), 16, 10).cast("double")


def key_uniform(key: Column, seed: Column | int) -> Column:
    """A value in [0, 1)."""
    return key_number(key, seed) / F.lit(float(2**52))
