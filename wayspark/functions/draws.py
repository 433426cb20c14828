"""Seeded draws as a pure function of (seed, salt, key).

Every sample, mask and subset is ordered by a hash instead of a generator stream: the same rows
are drawn whatever the partitioning, after a retry, and in any engine with md5.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(16 ** 15)


def draw_hex(seed: int | Column, salt: str, *keys: Column) -> Column:
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed, F.lit(salt), *[k.cast("string") for k in keys]))


def draw_int(seed: int, salt: str, *keys: Column) -> Column:
    """Uniform integer in [0, 16^15)."""
    return F.conv(F.substring(draw_hex(seed, salt, *keys), 1, 15), 16, 10).cast("bigint")


def uniform(seed: int, salt: str, *keys: Column) -> Column:
    """Uniform double in [0, 1)."""
    return draw_int(seed, salt, *keys).cast("double") / _SPAN


def normal(seed: int, salt: str, *keys: Column) -> Column:
    """Standard normal by the Box-Muller transform of two draws."""
    u, v = uniform(seed, salt + ".u", *keys), uniform(seed, salt + ".v", *keys)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)


def poisson1(seed: int, salt: str, *keys: Column) -> Column:
    """Poisson(1) count by inversion of its distribution function."""
    u = uniform(seed, salt, *keys)
    cumulative, term, value = 0.0, math.exp(-1.0), F.lit(0)
    for k in range(1, 12):
        cumulative += term
        value = F.when(u >= cumulative, F.lit(k)).otherwise(value)
        term /= k
    return value.cast("double")
