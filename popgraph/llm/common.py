"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the word separators of every operator here.
WORD = r"[^\x20\x09-\x0D]+"

#: Copies of one key that are dealt out together at most over so many keys.
SALTS = 64


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that Python objects of few rows are alive at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def free(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_group(rows: DataFrame, keys: list[str], spread: str, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Every row of ``rows`` with aggregates over the rows of equal ``keys``.

    ``aggs``: output name to (``count``, ``sum``, ``min`` or ``max``, column). The join back
    is on the keys and a salt drawn from column ``spread``, so that a key with a
    third of all rows is dealt over ``SALTS`` tasks; sums are made per salt before
    they meet. Keys must not be null.
    """
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    part = salted.groupBy(*keys, "_salt").agg(
        *[(F.count(F.lit(1)) if how == "count" else merge[how](c)).alias(name) for name, (how, c) in aggs.items()]
    )
    whole = part.groupBy(*keys).agg(*[merge[how](name).alias(name) for name, (how, _) in aggs.items()])
    whole = part.select(*keys, "_salt").join(whole, keys)
    return salted.join(whole, [*keys, "_salt"]).drop("_salt")
