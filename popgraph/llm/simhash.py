"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a covering code: nine Hamming(7,4) blocks and the last bit
as it is, 2^37 anchors with covering radius nine. Of two fingerprints that differ in at
most two bits, some point lies within one bit of both, and the anchor that covers that
point is the same from either side. So a fingerprint goes to the anchors that cover the
points within one bit of it (about 25 of the anchors within covering radius plus
threshold), and every link meets in at least one anchor, where distances are compared.
Anchors that receive more than ``HEAVY`` fingerprints give their rows to the finest
code, where every point is an anchor: at most 65 fingerprints share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgraph.llm.common import slices
from popgraph.plans.components import connected_components
from popgraph.plans.stage import stage

SHINGLE = 3
SEED = 42
#: Fingerprints that are compared with each other within one anchor.
HEAVY = 512

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of the whole text: majority of the bits of its shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    n = max(len(words) - shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    by_byte = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    if n < 400:
        ones = np.unpackbits(by_byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            f = np.array([simhash(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """(doc_id, fp), a row per row of ``docs``; fp holds the 64 bits as a signed long. ``mark`` goes along."""
    more = [] if mark is None else [mark.alias("mark")]
    kinds = [f", mark {docs.select(m).schema['mark'].dataType.simpleString()}" for m in more]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return source.mapInArrow(_fingerprints, "doc_id long, fp long" + "".join(kinds))


def _code() -> tuple[np.ndarray, np.ndarray]:
    """For 7 bits: the codeword that covers a point; for a point, those of its neighbours."""
    checks = np.array([0b1010101, 0b1100110, 0b1111000], np.uint8)
    points = np.arange(128, dtype=np.uint8)
    syndrome = sum((np.bitwise_count(points & c) & 1).astype(np.int64) << k for k, c in enumerate(checks))
    nearest = np.where(syndrome > 0, points ^ (1 << np.maximum(syndrome - 1, 0)), points).astype(np.uint64)
    return nearest, np.stack([nearest[points ^ (1 << k)] for k in range(7)], axis=1)


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) pairs for uint64 fingerprints, each pair once."""
    nearest, around = _code()
    blocks = [(fp >> np.uint64(7 * k)) & np.uint64(127) for k in range(9)]
    own = fp & np.uint64(1 << 63)
    for k, x in enumerate(blocks):
        own = own | (nearest[x] << np.uint64(7 * k))
    every = [own, own ^ np.uint64(1 << 63)]
    for k, x in enumerate(blocks):
        rest = own & ~np.uint64(127 << (7 * k))
        every += [rest | (around[x][:, j] << np.uint64(7 * k)) for j in range(7)]
    table = np.sort(np.stack(every, axis=1), axis=1)
    fresh = np.ones(table.shape, bool)
    fresh[:, 1:] = table[:, 1:] != table[:, :-1]
    rows, _ = np.nonzero(fresh)
    return rows, table[fresh]


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, 4096):
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows, anchor = anchors_of(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[rows].view(np.int64))], ["anchor", "fp"])


def _forest(fp: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that connect what distances of at most ``threshold`` connect, no cycles."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= threshold
    left = np.ones(len(fp), bool)
    links = []
    for root in range(len(fp)):
        todo = [root] if left[root] else []
        left[root] = False
        while todo:
            at = todo.pop()
            found = np.nonzero(near[at] & left)[0]
            left[found] = False
            links += [(int(fp[root]), int(fp[x])) for x in found]
            todo += found.tolist()
    return links


def _compare(threshold: int, heavy: int):
    """Rows sorted by anchor to links; a run longer than ``heavy`` is passed on row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, pairs: np.ndarray) -> pa.RecordBatch:
            p = pairs.astype(np.uint64).view(np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(p), kind, np.int32)), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["kind", "a", "b"]
            )

        held, at, over = np.empty(0, np.uint64), None, False
        flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
        fine = lambda f: np.stack([(f[:, None] ^ flips).ravel(), np.repeat(f, 65)], axis=1)
        for b in batches:
            anchor = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.nonzero(np.diff(anchor))[0] + 1).tolist(), len(anchor)]
            links: list[tuple[int, int]] = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if anchor[s] != at:
                    if len(held) > 1:
                        links += _forest(np.unique(held), threshold)
                    held, at, over = np.empty(0, np.uint64), anchor[s], False
                held = np.concatenate((held, fp[s:e]))
                if over or len(held) > heavy:
                    over = True
                    for k in range(0, len(held), 1024):
                        yield out(1, fine(held[k : k + 1024]))
                    held = held[:0]
            if links:
                yield out(0, np.array(links, np.uint64))
        if len(held) > 1 and (links := _forest(np.unique(held), threshold)):
            yield out(0, np.array(links, np.uint64))

    return run


def links(distinct: DataFrame, threshold: int = 2, heavy: int = HEAVY) -> DataFrame:
    """(a, b) links that connect distinct fingerprints (column fp) at most two bits apart.

    The links span each component; the pairs of a component are not spelled out.
    """
    if threshold > 2:
        raise ValueError("the anchors cover differences of at most two bits")
    anchored = distinct.select("fp").mapInArrow(_to_anchors, "anchor long, fp long")
    dealt = anchored.repartition("anchor").sortWithinPartitions("anchor")
    met = stage(dealt.mapInArrow(_compare(threshold, heavy), "kind int, a long, b long"), "simhash-met")
    light = met.where("kind = 0").select("a", "b")
    # a fine anchor joins all who share it: they are within one bit of it, two of each other
    fine = met.where("kind = 1").distinct()
    first = fine.groupBy("a").agg(F.min("b").alias("a0"), F.sort_array(F.collect_list("b")).alias("all"))
    rest = first.select(F.col("a0").alias("a"), F.explode("all").alias("b")).where("a <> b")
    if threshold < 2:
        rest = rest.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return light.unionByName(rest)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, heavy: int = HEAVY, mark: Column | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; a null or wordless text
    has fingerprint zero. ``component_id`` is the smallest id in reach over links, the
    row's own included; null ids link but are never the smallest. Repeated rows and
    equal texts share a fingerprint. An empty table gives an empty result. Only the id
    and the text are looked at. Given ``mark``, a column of ``docs``, rows have it too, and
    ``component``, which differs between components that have one smallest id.
    """
    rows = stage(fingerprints(docs, id_col, text_col, mark), "simhash-rows")
    own = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-own")
    comp = connected_components(links(own, threshold, heavy), "a", "b")
    placed = own.join(comp, own["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("comp"))
    placed = stage(placed, "simhash-placed")
    least = stage(placed.groupBy("comp").agg(F.min("least").alias("component_id")), "simhash-least")
    more = [] if mark is None else [F.col("comp").alias("component")]
    ids = stage(placed.join(least, "comp").select("fp", "component_id", *more), "simhash-ids")
    more = [] if mark is None else ["component", "mark"]
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *more)
