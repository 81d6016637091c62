"""Deterministic draws: uniform numbers from a hash of a key, the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, salt: str) -> Column:
    """In [0, 1): the first 32 bits of an MD5, so that other engines can follow."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def categorical(u: Column, values: list, weights: list[float]) -> Column:
    """The value whose cumulated weight first exceeds ``u``."""
    total, out = 0.0, None
    for v, w in zip(values[:-1], weights[:-1], strict=True):
        total = round(total + w, 9)
        out = F.when(u < total, F.lit(v)) if out is None else out.when(u < total, F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def normal(key: Column, salt: str) -> Column:
    """Standard normal by Box and Muller from two uniforms."""
    a, b = uniform(key, salt + "-a"), uniform(key, salt + "-b")
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * 3.141592653589793 * b)
