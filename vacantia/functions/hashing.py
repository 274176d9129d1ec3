"""A seeded, uniform, engine-independent order over a unique key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def uniform_key(key: Column, seed: int) -> Column:
    """60 uniform bits of the key as a non-negative BIGINT. Depends on nothing but the
    key and the seed, so a lost task or another partitioning gives the same value."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def whole_quotient(number: Column, divisor: int) -> Column:
    """The largest integer not above number / divisor, in integers: doubles are off from
    2^53 on."""
    below = number - F.pmod(number, F.lit(divisor))
    return F.call_function("div", below, F.lit(divisor))
