"""Every registered query runs on the smallest tables; its rows equal those of its SQL twin."""

import glob
import math
import os

import duckdb
import pytest

from popgraph import registry

SF = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    if isinstance(x, list):
        return str([value(y) for y in x])
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        order = [df.columns.index(c) for c in sorted(df.columns)]
        other = [want.columns.index(c) for c in sorted(want.columns)]
        got = sorted(str([float(v) if isinstance(v := value(r[i]), int) else str(v) if not isinstance(v, float) else v for i in order]) for r in rows)
        assert got == sorted(str([float(v) if isinstance(v := value(r[i]), int) else str(v) if not isinstance(v, float) else v for i in other]) for r in want.fetchall())
