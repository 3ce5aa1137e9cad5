"""Counter-based random numbers.

A draw depends on its key alone, never on partitioning or on the order of evaluation,
so a stochastic step can be checked against SQL and rerun anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def uniform(*key) -> Column:
    """Uniform in [0, 1) from the first 32 bits of the MD5 of the key's parts joined by colons."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fast_uniform(*key) -> Column:
    """Uniform in [0, 1) from xxhash64; quicker, and without a twin in other SQL engines."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def normal(*key) -> Column:
    """Standard normal by Box and Muller from two uniform draws."""
    a, b = uniform(*key, "a"), uniform(*key, "b")
    return F.sqrt(F.lit(-2.0) * F.log(F.greatest(a, F.lit(1e-12)))) * F.cos(F.lit(2 * math.pi) * b)
