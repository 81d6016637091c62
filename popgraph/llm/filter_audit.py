"""How the filters of a chain interact, for every order of them, by decision diagrams.

Every document gets a mask of the filters that it fails. Documents are counted by part
and mask, so at most 2^filters rows are left of a part. These counts make a decision
diagram: one variable a level, one node for every different function of the variables
below, each weighted with the documents under it. Neighbouring levels are swapped until
every order of the variables has been seen; in each order the path on which all filters
pass has the documents kept after every step, and the branches that leave it have those
removed there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgraph.llm.common import WORD, with_group

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
MARKS = "[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Node:
    """A test of one variable; a leaf has counts alone. ``None`` stands for a branch without documents."""

    __slots__ = ("fails", "passes", "weight")

    def __init__(self, passes: Node | None, fails: Node | None, weight: tuple[int, ...]):
        self.passes, self.fails, self.weight = passes, fails, weight


class Diagram:
    """Count-weighted decision diagram of ``counts``: mask of failures to a tuple of counts. ``order[k]`` is the variable of level k."""

    def __init__(self, variables: int, counts: dict[int, tuple[int, ...]]):
        self.order = list(range(variables))
        self.zero = (0,) * len(next(iter(counts.values())))
        self.levels: list[dict] = [{} for _ in self.order]
        self._leaves: dict[tuple[int, ...], Node] = {}
        self.root = self._build(0, counts)

    def _build(self, level: int, counts: dict[int, tuple[int, ...]]) -> Node | None:
        if not counts:
            return None
        if level == len(self.order):
            return self._leaves.setdefault(counts[0], Node(None, None, counts[0]))
        passes = {m >> 1: c for m, c in counts.items() if not m & 1}
        fails = {m >> 1: c for m, c in counts.items() if m & 1}
        return self._node(level, self._build(level + 1, passes), self._build(level + 1, fails))

    def _node(self, level: int, passes: Node | None, fails: Node | None) -> Node | None:
        if passes is None and fails is None:
            return None
        key = (id(passes), id(fails))
        if key not in self.levels[level]:
            self.levels[level][key] = Node(passes, fails, tuple(map(sum, zip(self.weight(passes), self.weight(fails), strict=True))))
        return self.levels[level][key]

    def weight(self, node: Node | None) -> tuple[int, ...]:
        return self.zero if node is None else node.weight

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the next; nodes of ``level`` keep their function and place."""
        upper, self.levels[level + 1] = list(self.levels[level].values()), {}
        both = lambda n: (None, None) if n is None else (n.passes, n.fails)
        for node in upper:
            (pp, pf), (fp, ff) = both(node.passes), both(node.fails)
            node.passes, node.fails = self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)
        self.levels[level] = {(id(n.passes), id(n.fails)): n for n in upper}
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(variable, counts kept, counts removed) along the path on which all pass."""
        out, node = [], self.root
        for variable in self.order:
            fails, node = (None, None) if node is None else (node.fails, node.passes)
            out.append((variable, self.weight(node), self.weight(fails)))
        return out

    def failing_only(self) -> list[tuple[int, ...]]:
        """By variable, the counts that fail it and pass all others."""
        out = [self.zero] * len(self.order)
        for at, variable in enumerate(self.order):
            node = self.root
            for level in range(len(self.order)):
                node = None if node is None else node.fails if level == at else node.passes
            out[variable] = self.weight(node)
        return out


def plain_changes(n: int) -> Iterator[int]:
    """Places of swaps of neighbours that lead through all orders of ``n`` things."""
    if n > 1:
        inner = plain_changes(n - 1)
        while True:
            yield from range(n - 2, -1, -1)
            if (at := next(inner, None)) is None:
                return
            yield at + 1
            yield from range(n - 1)
            if (at := next(inner, None)) is None:
                return
            yield at


def orders_of(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """Rows of ``STEPS`` without their part; ``counts``: mask to (documents, good ones, toxic ones)."""
    diagram = Diagram(len(filters), counts)
    only = diagram.failing_only()
    seen = {tuple(diagram.order): diagram.steps()}
    for at in plain_changes(len(filters)):
        diagram.swap(at)
        seen[tuple(diagram.order)] = diagram.steps()
    failing = {steps[0][0]: steps[0][2][0] for steps in seen.values()}  # what the first filter removes is all that fails it
    shapley = dict.fromkeys(range(len(filters)), 0)
    for steps in seen.values():
        for variable, _, removed in steps:
            shapley[variable] += removed[0]
    return [
        ("".join(filters[v] for v in order), k + 1, kept[0], removed[0], failing[v] - removed[0], only[v][0], removed[1], removed[2], shapley[v])
        for order, steps in seen.items()
        for k, (v, kept, removed) in enumerate(steps)
    ]


def _audit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """At most one row for each mask comes in."""
    counts = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples()}
    names = [f.split()[0] for f in STEPS.split(", ")]
    return pd.DataFrame([(key[0], *r) for r in orders_of(counts)], columns=names)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask), one row per row of ``docs``; bit k of ``mask`` is set if filter k of ``FILTERS`` fails.

    A null text is empty and a null part is the empty string. The last filter fails a row
    whose text some smaller id has as well: of rows that repeat an id none is smaller than
    the others, and a null id is neither smaller nor larger than any. Texts count as
    identical if their SHA-256 are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    told = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    words, n = F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), F.length("t")
    upper = n - F.length(F.translate("t", UPPER, ""))
    told = told.select("doc_id", "part", F.sha2("t", 256).alias("sha"), words.alias("w"), n.alias("n"), upper.alias("upper"), F.col("t").rlike(MARKS).alias("marks"))
    failing: list[Column] = [
        F.size("w") < MIN_WORDS,
        100 * F.size(F.array_distinct("w")) < MIN_DISTINCT_PERCENT * F.size("w"),
        100 * F.col("upper").cast("long") > MAX_UPPER_PERCENT * F.col("n").cast("long"),
        F.col("marks"),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failing)), F.lit(0))
    told = told.select("doc_id", "part", "sha", mask.alias("mask"))
    told = with_group(told, ["sha"], "doc_id", {"least": ("min", "doc_id")})
    copy = F.when(F.col("doc_id") > F.col("least"), 1 << len(failing)).otherwise(0)
    return told.select("doc_id", "part", (F.col("mask") + copy).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows of ``STEPS``: for each part, each order of the filters and each step of it.

    ``labels`` (id, quality, toxic) may lack documents, hold nulls and repeat ids: a
    document is good or toxic if any row of its id says so. Rows of ``docs`` that repeat
    an id count one by one. An empty table has no parts and gives no rows. Other columns
    are not looked at.
    """
    said = labels.groupBy(F.col(id_col).alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = failures(docs, id_col, text_col, part_col).join(said, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return counts.groupBy("part").applyInPandas(_audit, STEPS)
