"""Rounding of doubles by scaling, as other engines do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(x: Column) -> Column:
    """A million times ``x``, rounded half away from zero, over a million.

    Spark's ``round`` goes by the decimal digits of a double instead: some halves that are
    no exact double (41 / 640) part there, and it has no negative zero. Values that are
    not finite, or not when scaled, stay.
    """
    y = x * 1e6
    near = F.rint(F.abs(y))
    whole = F.when(F.abs(y) - near == 0.5, near + 1.0).otherwise(near)  # rint takes halves to the even side
    return F.when(F.abs(y) < float("inf"), F.signum(y) * whole / 1e6).otherwise(x)
