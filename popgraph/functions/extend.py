"""User extensions: rows to many rows, table functions for SQL, and aggregates with partial states."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def explode_with(df: DataFrame, fn: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Each row, as a dict, to the rows that ``fn`` returns for it."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for r in b.to_dict("records") for x in fn(r)], columns=names)

    return df.mapInPandas(run, schema)


def register_rows(spark: SparkSession, name: str, fn: Callable, schema: str) -> None:
    """Registers ``fn`` (values to a list of rows) as table function ``name`` with the columns ``schema``, for SQL with LATERAL."""

    class Rows:
        def eval(self, *args):
            yield from fn(*args)

    spark.udtf.register(name, udtf(Rows, returnType=schema))


class PatternRows:
    """Table function (text, pattern, columns): a row for each match, its groups as the columns "name type, ...".

    The columns are known when the query is analysed, from the constant third argument;
    types are those of ``READ``. A group that does not match, or that can't be read as its
    type, gives null; a null text gives no rows.
    """

    READ = {"long": (LongType, int), "double": (DoubleType, float), "string": (StringType, str)}

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        if not (columns.isConstantExpression and pattern.isConstantExpression):
            raise ValueError("the pattern and the columns must be constants")
        named = [c.split() for c in columns.value.split(",")]
        if wrong := [c for c in named if len(c) != 2 or c[1] not in PatternRows.READ]:
            raise ValueError(f"not a name and one of {sorted(PatternRows.READ)}: {wrong}")
        if len(named) != re.compile(pattern.value).groups:
            raise ValueError(f"{len(named)} columns for {re.compile(pattern.value).groups} groups")
        schema = StructType()
        for name, kind in named:
            schema = schema.add(name, PatternRows.READ[kind][0]())
        return AnalyzeResult(schema=schema)

    def eval(self, text: str, pattern: str, columns: str):
        kinds = [self.READ[c.split()[1]][1] for c in columns.split(",")]
        for m in re.finditer(pattern, text or ""):
            row = []
            for kind, said in zip(kinds, m.groups(), strict=True):
                try:
                    row.append(None if said is None else kind(said))
                except ValueError:
                    row.append(None)
            yield tuple(row)


def register_pattern_rows(spark: SparkSession, name: str = "pattern_rows") -> None:
    spark.udtf.register(name, udtf(PatternRows))


def aggregate_with(
    df: DataFrame,
    keys: list[str],
    state: str,
    fold: Callable[[object, pd.DataFrame], object],
    merge: Callable[[object, object], object],
    finish: Callable[[object], float],
    name: str = "metric",
    held: int = 10_000,
    fan_in: int = 64,
) -> DataFrame:
    """(keys, ``name``): an aggregate of each group with partial states, so that no group need fit a task.

    ``fold`` takes a state (None at first) and rows of one group to a state of type
    ``state`` (DDL), ``merge`` two states to one, ``finish`` a state to a number. Every
    task folds its rows, with at most ``held`` groups open at once; the states of a group
    meet in ``fan_in`` tasks and then in one. The order of rows and states is not fixed, so
    ``merge`` has to be associative and commutative. A null in a key is a group of its own.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    partial = f"{kinds}, _salt int, _state {state}"

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        plain = lambda k: tuple(None if pd.isna(x) else x for x in k)

        def out() -> pd.DataFrame:
            # the salt differs between the states of one group, since it counts what a task gives
            return pd.DataFrame([(*k, hash((id(states), i)) % fan_in, v) for i, (k, v) in enumerate(states.items())], columns=[*keys, "_salt", "_state"])

        for b in batches:
            for k, rows in b.groupby(keys, dropna=False, sort=False):
                k = plain(k)
                states[k] = fold(states.get(k), rows)
            if len(states) > held:
                yield out()
                states = {}
        if states:
            yield out()

    def united(rows: pd.DataFrame) -> object:
        total = rows["_state"].iloc[0]
        for s in rows["_state"].iloc[1:]:
            total = merge(total, s)
        return total

    def met(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, united(rows))], columns=[*keys, "_salt", "_state"])

    def last(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, float(finish(united(rows))))], columns=[*keys, name])

    part = df.mapInPandas(folded, partial).groupBy(*keys, "_salt").applyInPandas(met, partial)
    return part.groupBy(*keys).applyInPandas(last, f"{kinds}, {name} double")
