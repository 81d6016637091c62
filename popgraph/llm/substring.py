"""Exact substring deduplication by suffix automata of reference shards.

Text that repeats is found in two steps. Every window of ``length`` words has one anchor,
the word k-gram of lowest hash in it, so equal windows have equal anchors; windows of one
anchor in a row are a segment. An anchor that occurs once repeats nothing. All segments
of one anchor meet: if they are one and the same, all their windows repeat. If not, the
different segments, each once with its number of occurrences, are a reference shard: a
suffix automaton is built from them, the segments are streamed through it for matching
statistics, and a window repeats if the state that it ends in is longer than the threshold
and occurs twice or more. The shards go to the tasks by a shuffle on the anchor, not by
broadcast: the corpus is its own reference and has no size bound, and a broadcast of each
shard to all documents would be quadratic. A shard of more than ``heavy`` different
segments is never held; its windows are counted by their hashes over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.llm.common import SALTS, slices, with_group
from popgraph.plans.stage import stage

LENGTH = 35
GRAM = 8
HEAVY = 400
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))


def span_hashes(wh: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of word spans, from prefix sums."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(wh * _powers(_BASE, len(wh))[:-1], dtype=np.uint64)))
    return _mix((sums[stops] - sums[starts]) * _powers(_BASE_INVERSE, len(wh))[starts])


def segments(wh: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, segment hash, first window, windows) of a text's word hashes."""
    m = len(wh) - length + 1
    if m < 1:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    at = np.arange(len(wh) - gram + 1)
    kg = span_hashes(wh, at, at + gram)
    spread = length - gram + 1
    low = np.lib.stride_tricks.sliding_window_view(kg, spread).argmin(axis=1) + np.arange(m)
    first = np.concatenate(([0], np.nonzero(np.diff(low))[0] + 1))
    count = np.diff(np.append(first, m))
    own = span_hashes(wh, first, first + count + length - 1)
    shape = (count.astype(np.uint64) << np.uint64(16)) + (low[first] - first).astype(np.uint64)
    return kg[low[first]], _mix(own + shape * np.uint64(0x94D049BB133111EB)), first, count


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                keys, got = [], []
                for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = segments(word_hashes(words_of(t)), length, gram)
                    if len(x[0]):
                        keys.append(np.full(len(x[0]), key, np.int64))
                        got.append(x)
                if got:
                    anchor, seg, first, count = (np.concatenate(c) for c in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(first * 64 + count)],
                        ["key", "anchor", "seg", "at"],
                    )

    return run


def _words(length: int):
    """Segments wanted of a text, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 128):
                out = []
                for t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    wh = word_hashes(words_of(t)).astype("<u8")
                    for w in wanted:
                        s, c = divmod(w["at"], 64)
                        out.append((w["anchor"], w["salt"], w["seg"], w["n"], wh[s : s + c + length - 1].tobytes()))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "salt", "seg", "n", "words"]
                    )

    return run


class SuffixAutomaton:
    """Suffix automaton of several sequences with occurrence counts."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], times: int) -> None:
        last, nxt, length, link = 0, self.next, self.length, self.link
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
            else:
                p, last = last, self._state(length[last] + 1, 0, {})
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = last
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[last] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            self.count[last] += times

    def close(self) -> None:
        """Counts of occurrences of every state, from the longest to the shortest."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def repeats(self, sequence: list[int], threshold: int) -> list[int]:
        """Starts of the windows of ``threshold`` symbols that occur at least twice."""
        v = matched = 0
        found, nxt, link, length = [], self.next, self.link, self.length
        for i, c in enumerate(sequence):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c in nxt[v]:
                v, matched = nxt[v][c], matched + 1
            if matched >= threshold:
                while length[link[v]] >= threshold:
                    v = link[v]
                    matched = length[v]
                if self.count[v] >= 2:
                    found.append(i - threshold + 1)
        return found


def _shards(length: int, heavy: int):
    """Rows sorted by anchor to (anchor, seg, windows that repeat as bits), or for heavy anchors to windows."""

    def resolve(anchor: int, held: list[tuple[int, int, bytes]]) -> list[tuple]:
        sequences = [np.frombuffer(w, "<u8").tolist() for _, _, w in held]
        shard = SuffixAutomaton()
        for (_, n, _), s in zip(held, sequences, strict=True):
            shard.add(s, n)
        shard.close()
        return [(0, anchor, seg, sum(1 << k for k in shard.repeats(s, length)), 0, 0) for (seg, _, _), s in zip(held, sequences, strict=True)]

    def windows(anchor: int, held: list[tuple[int, int, bytes]]) -> list[tuple]:
        out = []
        for seg, n, w in held:
            wh = np.frombuffer(w, "<u8").astype(np.uint64)
            at = np.arange(len(wh) - length + 1)
            out += [(1, anchor, seg, k, h, n) for k, h in enumerate(span_hashes(wh, at, at + length).view(np.int64).tolist())]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["kind", "anchor", "seg", "bits", "window", "n"])

        anchor, held, over, out = None, [], False, []
        for whole in batches:
            for b in slices(whole):
                for a, salt, seg, n, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if a != anchor:
                        if held:
                            out += (windows if over else resolve)(anchor, held)
                        anchor, held, over = a, [], salt >= 0
                    held.append((seg, n, w))
                    if over or len(held) > heavy:
                        out += windows(a, held)
                        over, held = True, []
                if out:
                    yield made(out)
                    out = []
        if held:
            out += (windows if over else resolve)(anchor, held)
        if out:
            yield made(out)

    return run


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 256):
                total, gone, kept = [], [], []
                for t, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    words = words_of(t)
                    text = b" ".join(words)
                    removed = 0
                    if marks:
                        edge = np.zeros(len(words) + 1, np.int32)
                        for m in marks:
                            for k in range(m["bits"].bit_length()):
                                if m["bits"] >> k & 1:
                                    edge[m["first"] + k] += 1
                                    edge[m["first"] + k + length] -= 1
                        stays = np.cumsum(edge)[:-1] == 0
                        removed = len(words) - int(stays.sum())
                        text = b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s])
                    total.append(len(words))
                    gone.append(removed)
                    kept.append(text.decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"]
                )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row per row of ``docs``.

    Words are runs without ASCII white space. A word goes if a window of ``length``
    words over it starts at another place too, in this row or any other; windows are
    judged on the input. Kept words are joined by one space. Null texts have no words;
    rows that repeat each other lose all windows; an empty table gives an empty result;
    columns but the id and the text are not looked at. Words count as equal if their
    64-bit hashes are.
    """
    if not gram < length <= gram + 61:
        raise ValueError("a segment holds at most 62 windows")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("key", F.xxhash64("doc_id", "text"))
    rows = stage(source.select("key", "text").mapInArrow(_segments(length, gram), "key long, anchor long, seg long, at long"), "sub-rows")
    stat = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("s0"), F.max("seg").alias("s1"))
    stat = stage(stat.where("n > 1").select("anchor", (F.col("s0") != F.col("s1")).alias("mixed")), "sub-anchors")
    met = stage(rows.join(stat, "anchor"), "sub-met")

    one = met.where("mixed").groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("one"))
    one = stage(one, "sub-one")
    crowded = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > heavy)
    crowded = stage(crowded.select("anchor", F.lit(True).alias("crowded")), "sub-crowded")
    # the segments of a crowded anchor are counted window by window, so they may be dealt apart
    salt = F.when(F.col("crowded"), F.pmod("seg", F.lit(SALTS))).otherwise(F.lit(-1)).cast("long").alias("salt")
    one = one.join(crowded, "anchor", "left").select("anchor", salt, "seg", "n", F.col("one.key").alias("key"), F.col("one.at").alias("at"))
    wanted = one.groupBy("key").agg(F.collect_list(F.struct("anchor", "salt", "seg", "n", "at")).alias("wanted"))
    # rows of equal id and text send a segment twice, whose windows repeat anyway
    held = source.select("key", "text").join(wanted, "key").select("text", "wanted").mapInArrow(_words(length), "anchor long, salt long, seg long, n long, words binary")
    dealt = held.repartition("anchor", "salt").sortWithinPartitions("anchor")
    told = stage(dealt.mapInArrow(_shards(length, heavy), "kind long, anchor long, seg long, bits long, window long, n long"), "sub-told")
    large = with_group(told.where("kind = 1"), ["anchor", "window"], "seg", {"total": ("sum", "n")}).where("total > 1")
    large = large.groupBy("anchor", "seg").agg(F.expr("bit_or(shiftleft(1L, cast(bits as int)))").alias("bits"))
    masks = stage(told.where("kind = 0").select("anchor", "seg", "bits").unionByName(large), "sub-masks")

    every = F.expr("shiftleft(1L, cast(at % 64 as int)) - 1")
    whole = met.where("not mixed").select("key", "at", every.alias("bits"))
    part = met.where("mixed").join(masks, ["anchor", "seg"]).where("bits <> 0").select("key", "at", "bits")
    spans = whole.unionByName(part).select("key", F.expr("cast(at div 64 as int)").alias("first"), "bits")
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("first", "bits")).alias("marks"))
    joined = source.join(spans, "key", "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_strip(length), "doc_id long, n_words long, n_removed long, kept_text string")
