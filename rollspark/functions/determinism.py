"""Seeded randomness as plain hash expressions.

The same seed and key give the same value whatever the partitioning, after a
task retry, and in any SQL engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HEX_DIGITS = 13  # 52 bits: exact in a double
BLOCK_DIGITS = 4
BLOCKS = 16**BLOCK_DIGITS


def order_hash(seed, *keys: Column) -> Column:
    """Hex digest that orders rows pseudo-randomly for one seed."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    parts = [seed.cast("string"), *[k.cast("string") for k in keys]]
    return F.md5(F.concat_ws(":", *parts))


def uniform(seed, *keys: Column) -> Column:
    """Uniform double in [0, 1)."""
    digits = F.substring(order_hash(seed, *keys), 1, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_HEX_DIGITS))


def hash_block(digest: Column) -> Column:
    """Leading digits of an order hash as a number below ``BLOCKS``; keeps the hash order."""
    return F.conv(F.substring(digest, 1, BLOCK_DIGITS), 16, 10).cast("int")


def int_div(a: Column, b) -> Column:
    """Whole quotient of two non-negative integers, exact at any size."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))
