"""Removal of byte strings that occur earlier, with suffix arrays of reference shards.

Every window of ``length`` bytes has an anchor, the ``gram`` bytes of lowest hash in it
(the first of equals), so equal windows have equal anchors at equal places; windows of
one anchor in a row are a segment. An anchor that occurs once repeats nothing, and its
segment goes no further. All equal segments of an anchor but the first are removed with
all their windows. Where the segments of an anchor differ, each goes once, as it first
occurs, to a shard with all others of that anchor. What surely has no window in common
with another is left out there; the suffix array of the rest, built by Lyndon grouping,
brings equal windows together, and all but the earliest are removed.
Shards hold whole anchors and are dealt by a shuffle. An anchor with over ``heavy``
different segments is never held: its windows are compared by hashes over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.llm.common import slices
from popgraph.llm.suffix_array import suffix_array
from popgraph.plans.stage import stage

LENGTH = 100
GRAM = 40
#: Different segments of an anchor that one shard holds at most, about 150 bytes each.
HEAVY = 4096
#: Bytes at which a shard is full and its suffix array is built.
SHARD = 1 << 17
#: Windows of a text that are looked at together; 20 bits of a key are a place.
_BLOCK = (1 << 20) - (1 << 12)
_PLACE = np.uint64((1 << 20) - 1)
#: Stands between the segments of a shard; no byte of UTF-8.
_BETWEEN = b"\xff"

#: Places of the anchor in a window that are looked at together when segments are compared first.
PLACES = 8

ROWS = "anchor long, seg long, doc_id long, key long, at long, windows long, into long"
HELD = "anchor long, window long, doc_id long, key long, at long, into long, segment binary"
MARKS = "key long, at long, windows long"

_mul = lambda x, k: x * np.uint64(k)


def data_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of every ``gram`` bytes in a row, doubled up from single bytes."""
    h = _mul(data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    got, covered, width = None, 0, 1
    while True:
        if gram & width:
            n = len(data) - covered - width + 1
            got = h[:n].copy() if got is None else _mul(got[:n], 0xD6E8FEB86659FD93) + h[covered : covered + n]
            covered += width
        if covered == gram:
            break
        n = len(h) - width
        h = _mul(h[:n], 0xBF58476D1CE4E5B9) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    got = _mul(got, 0x94D049BB133111EB)
    return got ^ (got >> np.uint64(31))


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first window, windows, place of the anchor behind the first window's start) of the segments of a text, by blocks of windows."""
    for begin in range(0, len(data) - length + 1, _BLOCK):
        part = np.frombuffer(data, np.uint8)[begin : begin + _BLOCK + length - 1]
        m = len(part) - length + 1
        h = gram_hashes(part, gram)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        spread, width = length - gram + 1, 1
        while 2 * width <= spread:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:m], low[spread - width : spread - width + m])
        place = (low & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.nonzero(np.diff(place))[0] + 1))
        yield h[place[first]], first + begin, np.diff(np.append(first, m)), place[first] - first


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                got = [a for t in b.column(0).to_pylist() for a, _, _, _ in segments(data_of(t), length, gram)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], ["anchor"])

    return run


def _rows(length: int, gram: int):
    names = [f.split()[0] for f in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                anchor, seg, doc, key, at, windows, into = [], [], [], [], [], [], []
                for i, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = data_of(t)
                    for a, first, n, inner in segments(data, length, gram):
                        anchor.append(a)
                        at.append(first)
                        windows.append(n)
                        into.append(inner)
                        seg += [xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)]
                        doc += [i] * len(a)
                        key += [k] * len(a)
                if anchor:
                    cat = lambda c: pa.array(np.concatenate(c).astype(np.int64))
                    columns = [pa.array(np.concatenate(anchor).view(np.int64)), pa.array(np.array(seg, np.uint64).view(np.int64)), pa.array(doc, pa.int64()), pa.array(key, pa.int64()), cat(at), cat(windows), cat(into)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in shape.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _fetch(length: int):
    """The segments wanted of a text, or of crowded anchors the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 64):
                out = []
                for i, k, t, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = data_of(t)
                    for w in wanted:
                        s, n = w["at"], w["windows"]
                        if w["crowded"]:
                            hashes = np.array([xxhash.xxh3_64_intdigest(data[s + x : s + x + length]) for x in range(n)], np.uint64).view(np.int64)
                            out += [(w["anchor"], h, i, k, s + x, None, None) for x, h in enumerate(hashes.tolist())]
                        else:
                            out.append((w["anchor"], None, i, k, s, w["into"], data[s : s + n + length - 1]))
                if out:
                    yield _batch(out, HELD)

    return run


def alike(group: list[tuple], length: int, places: int = PLACES) -> list[tuple]:
    """What of the segments (doc_id, key, at, into, bytes) of one anchor can have a window in common with another of them.

    Equal windows have the anchor at one place, and those with the anchor at ``places``
    neighbouring places all hold the same bytes around it. Where no other segment has
    these bytes, no window is shared. Gives (doc_id, key, at, bytes) of the rest.
    """
    cores: list[list[tuple[int, bytes]]] = []
    met: dict[tuple[int, bytes], int] = {}
    for *_, into, data in group:
        last = into - (len(data) - length)  # the anchor's place in the last window
        own = []
        for b in range(last // places, into // places + 1):
            low = b * places
            core = (b, data[into - low : into - low - places + 1 + length])
            own.append(core)
            met[core] = met.get(core, 0) + 1
        cores.append(own)
    out = []
    for (i, k, at, into, data), own in zip(group, cores, strict=True):
        blocks = [b for b, core in own if met[b, core] > 1]
        if blocks:
            high, low = min(into, (blocks[-1] + 1) * places - 1), max(into - (len(data) - length), blocks[0] * places)
            out.append((i, k, at + into - high, data[into - high : into - low + length]))
    return out


def later_windows(held: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """(key, at, windows) of the runs of windows that occur earlier.

    ``held``: segments with their first places, (doc_id, key, at, bytes); a null id comes first.
    """
    text = _BETWEEN.join(s for *_, s in held)
    sizes = np.array([len(s) for *_, s in held])
    begins = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    owner = np.full(len(text), -1, np.int64)
    for no, (b, n) in enumerate(zip(begins.tolist(), sizes.tolist(), strict=True)):
        owner[b : b + n - length + 1] = no  # where a whole window starts
    order = np.array(suffix_array(text), np.int64)
    order = order[owner[order] >= 0]
    window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)
    fresh = np.ones(len(order), bool)
    for s in range(1, len(order), 1 << 16):
        e = min(s + (1 << 16), len(order))
        fresh[s:e] = (window[order[s:e]] != window[order[s - 1 : e - 1]]).any(axis=1)
    same = np.cumsum(fresh)
    own = owner[order]
    ids = np.array([-1 if i is None else i for i, *_ in held], np.int64)[own]
    null = np.array([i is None for i, *_ in held])[own]
    keys = np.array([k for _, k, _, _ in held], np.int64)[own]
    at = np.array([a for _, _, a, _ in held], np.int64)[own] + order - begins[own]
    by = np.lexsort((at, keys, ids, ~null, same))
    later = by[1:][same[by][1:] == same[by][:-1]]
    # put windows in a row together again
    later = later[np.lexsort((at[later], own[later]))]
    if not len(later):
        return []
    starts = np.concatenate(([0], np.nonzero((np.diff(at[later]) != 1) | (np.diff(own[later]) != 0))[0] + 1))
    counts = np.diff(np.append(starts, len(later)))
    return list(zip(keys[later][starts].tolist(), at[later][starts].tolist(), counts.tolist(), strict=True))


def _shards(length: int, full: int):
    """Rows sorted by anchor and place to marks; a shard takes whole anchors until it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size, last = [], [], 0, (None, None, None)
        for whole in batches:
            for b in slices(whole):
                for a, i, k, at, into, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if last == (a, k, at):
                        continue  # of a row that repeats another
                    if a != last[0]:
                        held += alike(group, length)
                        size += sum(len(x[-1]) for x in group)
                        group = []
                        if size >= full:
                            if held and (marks := later_windows(held, length)):
                                yield _batch(marks, MARKS)
                            held, size = [], 0
                    last = (a, k, at)
                    group.append((i, k, at, into, s))
        held += alike(group, length)
        if held and (marks := later_windows(held, length)):
            yield _batch(marks, MARKS)

    return run


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 128):
                total, gone, spans, kept = [], [], [], []
                for t, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    data = data_of(t)
                    total.append(len(data))
                    out, end, n = [], 0, 0  # end: of what is removed so far
                    for at, windows in sorted((m["at"], m["windows"]) for m in marks or ()):
                        if at > end or not n:
                            out.append(data[end:at])
                            n += 1
                        end = max(end, at + windows + length - 1)
                    out.append(data[end:])
                    kept.append(b"".join(out))
                    gone.append(len(data) - len(kept[-1]))
                    spans.append(n)
                kinds = [pa.array(c, pa.int64()) for c in (total, gone, spans)]
                yield pa.RecordBatch.from_arrays([b.column(0), *kinds, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_earlier(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY, shard: int = SHARD
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row per row of ``docs``.

    A byte of the UTF-8 text goes if ``length`` bytes over it also start earlier: in a row
    of smaller id (null is the smallest), or before in the same row. Strings are judged on
    the input; they never cross rows. Of rows with one id the order is that of a hash of
    their text; rows that repeat id and text count as one document and are cut alike.
    ``n_spans`` counts the removed runs and ``kept`` has the bytes that stay, which need
    not be whole characters. Null texts are empty; an empty table gives an empty result;
    columns but the id and the text are not looked at. Equal segments, and windows of
    crowded anchors, are told by two 64-bit hashes, that of the anchor and their own.
    """
    if not 0 < gram <= length:
        raise ValueError("an anchor is part of a window")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    many = source.select("text").mapInArrow(_anchors(length, gram), "anchor long")
    many = stage(many.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "suffix-anchors")
    # the segments are made a second time, which is cheaper than to write all of them
    met = stage(source.mapInArrow(_rows(length, gram), ROWS).join(many, "anchor"), "suffix-met")

    place = F.struct("doc_id", "key", "at")
    first = met.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "at", "windows", "into")).alias("first"))
    first = stage(first, "suffix-first")
    repeated = first.where("n > 1").select("anchor", "seg", F.struct("first.doc_id", "first.key", "first.at").alias("place"))
    whole = met.join(repeated, ["anchor", "seg"]).where(~place.eqNullSafe(F.col("place"))).select("key", "at", "windows")

    differ = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    differ = differ.select("anchor", (F.col("c") > heavy).alias("crowded"))
    wanted = first.join(differ, "anchor").select(F.col("first.key").alias("key"), F.struct("anchor", "crowded", "first.at", "first.windows", "first.into").alias("w"))
    wanted = wanted.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    # rows that repeat id and text send a segment twice, from one and the same place
    held = stage(source.join(wanted, "key").select("doc_id", "key", "text", "wanted").mapInArrow(_fetch(length), HELD), "suffix-held")
    dealt = held.where("segment is not null").select("anchor", "doc_id", "key", "at", "into", "segment").repartition("anchor").sortWithinPartitions("anchor", "key", "at")
    part = dealt.mapInArrow(_shards(length, shard), MARKS)
    crowd = held.where("segment is null").select("anchor", "window", "doc_id", "key", "at")
    least = crowd.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")).where("n > 1").drop("n")
    crowd = crowd.join(least, ["anchor", "window"]).where(~place.eqNullSafe(F.col("place"))).select("key", "at", F.lit(1).cast("long").alias("windows"))

    marks = whole.unionByName(part).unionByName(crowd).groupBy("key").agg(F.collect_list(F.struct("at", "windows")).alias("marks"))
    joined = source.join(marks, "key", "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_strip(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
