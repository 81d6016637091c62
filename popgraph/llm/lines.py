"""Line deduplication by pairwise alignment.

Documents that share a run of ``min_lines`` lines are paired, however many hold it: each
document with the earliest one that holds the run. A pair is aligned by patience diff, and
blocks of aligned lines go from the later document. A shared run that this alignment
leaves out, since it has moved or is repeated, is aligned on its own. So a block goes
whenever an earlier document has it, and the earliest one stands for all others that do:
pairs grow with the lines, not with the squares of those that share them. Rare single
lines are no keys: blocks of frequent lines would be lost, and what has a rare line in
common without a common run has no block to delete.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgraph.llm.common import slices
from popgraph.plans.stage import stage

MIN_LINES = 2


def split_lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def line_hashes(text: str | None) -> list[int]:
    """Hashes of the lines without outer white space; 0 for a blank line."""
    digest = xxhash.xxh3_64_intdigest
    return [(digest(s.encode("utf-8", "surrogatepass")) >> 1) | 1 if (s := x.strip()) else 0 for x in split_lines(text)]


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            lines = [line_hashes(t) for t in b.column(2).to_pylist()]
            same = [xxhash.xxh3_64_intdigest(np.array([x for x in h if x], "<u8").tobytes()) >> 1 if any(h) else None for h in lines]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lines, pa.list_(pa.int64())), pa.array(same, pa.int64())], ["doc_id", "key", "lines", "same"]
            )


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines: lines unique to both sides in longest increasing order, grown, then between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: j for j, x in enumerate(b[b0:b1], b0) if cb[x] == 1 and ca.get(x) == 1}
        pairs = [(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if x in at]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            p = bisect_left(tails, j)
            back.append(ends[p - 1] if p else -1)
            tails[p : p + 1] = [j]
            ends[p : p + 1] = [k]
        k = ends[-1] if ends else -1
        chain = []
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        s, t = a0, b0
        for i, j in reversed(chain):
            todo.append((s, i, t, j))
            out.append((i, j))
            s, t = i + 1, j + 1
        if chain:
            todo.append((s, a1, t, b1))
    return sorted(out)


def common_blocks(earlier: list[int], later: list[int], min_lines: int) -> list[int]:
    """Lines of ``later`` in common blocks of at least ``min_lines`` lines, blank lines aside: aligned ones, then those that have moved or are repeated."""
    ea, at = [x for x in earlier if x], [i for i, x in enumerate(later) if x]
    la = [later[i] for i in at]
    out: set[int] = set()
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(ea, la), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if len(block) >= min_lines:
                out.update(block)
            block = []
        block.append(j)
        before = (i, j)
    left = [j for j in range(len(la) - min_lines + 1) if any(k not in out for k in range(j, j + min_lines))]
    if left:
        runs = {tuple(ea[i : i + min_lines]) for i in range(len(ea) - min_lines + 1)}
        for j in left:
            if tuple(la[j : j + min_lines]) in runs:
                out.update(range(j, j + min_lines))
    return sorted(at[j] for j in out)


def _align(min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 128):
                gone = [common_blocks(e, x, min_lines) for e, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            total, removed, kept = [], [], []
            for t, gone, copy in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                lines = split_lines(t)
                out = {i for i, x in enumerate(lines) if x.strip()} if copy else set(gone or ())
                total.append(len(lines))
                removed.append(len(out))
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in out]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_removed", "kept_text"],
            )


def _runs(min_lines: int) -> Column:
    """Hashes of a document's distinct runs of ``min_lines`` lines, blank ones aside."""
    full = F.filter("lines", lambda x: x != 0)
    starts = F.when(F.size(full) >= min_lines, F.sequence(F.lit(1), F.size(full) - (min_lines - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(full, i, min_lines))))


def remove_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text), one row per row of ``docs``.

    The earlier of two documents has the smaller id. A document whose lines are all
    those of an earlier one, in order, loses all but its blank lines. Lines compare
    without outer white space; blank lines stay and do not part a block. Rows of equal
    id and text are one document and get equal results. A null text has no lines, null
    ids come first, an empty table gives an empty result; columns but the id and the
    text are not looked at.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("key", F.xxhash64("doc_id", "text"))
    hashed = source.select("doc_id", "key", "text").mapInArrow(_hashes, "doc_id long, key long, lines array<long>, same long")
    rows = stage(hashed.where("same is not null"), "lines-rows")
    rank = F.struct(F.col("doc_id"), F.col("key"))
    first = stage(rows.groupBy("same").agg(F.min(rank).alias("first")), "lines-first")
    firsts = stage(first.select(F.col("first.key").alias("key")).distinct(), "lines-firsts")
    # of rows that are one document any will do
    own = stage(rows.join(firsts, "key", "left_semi").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("lines").alias("lines")), "lines-own")
    copies = rows.select("key").distinct().join(firsts, "key", "left_anti").select("key", F.lit(True).alias("copy"))

    held = own.select("doc_id", "key", F.explode(_runs(min_lines)).alias("run"))
    shared = held.groupBy("run").agg(F.count(F.lit(1)).alias("df"), F.min(rank).alias("holder")).where("df > 1")
    shared = stage(shared.select("run", F.col("holder.key").alias("earlier")), "lines-shared")
    pairs = stage(held.select("key", "run").join(shared, "run").where("key <> earlier").select("key", "earlier").distinct(), "lines-pairs")
    sides = stage(own.select("key", "lines"), "lines-sides")
    left = pairs.join(sides.select(F.col("key").alias("earlier"), F.col("lines").alias("before")), "earlier")
    both = left.join(sides, "key").select("key", "before", "lines")
    aligned = both.mapInArrow(_align(min_lines), "key long, gone array<int>").where(F.size("gone") > 0)
    gone = aligned.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    change = stage(gone.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("gone", F.lit(None).cast("array<int>"))), "lines-change")
    # what changes grows with the corpus, so the texts are joined by one plan at every size
    joined = source.join(change.hint("merge"), "key", "left").select("doc_id", "text", "gone", "copy")
    return joined.mapInArrow(_cut, "doc_id long, n_lines long, n_removed long, kept_text string")
