"""Vector codes by product quantisation with active-entry Lloyd rounds.

Components become integers, vectors are cut into equal parts and every part position has
a codebook of its own. All distances are exact integers. The state of a round (parts,
assigned entries and their distances) is a written table. In the next round a part whose
entry did not move keeps its stored distance, which is still exact, and is compared with
the moved entries alone: it already lies nearest among those that stayed. A part whose
entry moved is compared with all entries. Only sums per entry go to the driver, whose
number depends on the width of the vectors and not on the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from popgraph.llm.common import with_group
from popgraph.plans.stage import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Bits of a squared distance; a component is bounded so that no distance has more.
_BITS = 62


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest of ``entries`` for each row of integers, the lower index of equals."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:  # then products of doubles are exact
        a, b = x.astype(np.float64), entries.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    else:
        d = np.zeros((len(x), len(entries)), np.int64)
        for k in range(x.shape[1]):
            d += (x[:, k, None] - entries[None, :, k]) ** 2
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def reassign(x: np.ndarray, code: np.ndarray, dist: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Assignment of the parts ``x`` of one position to ``new`` entries, from the one to ``old`` entries."""
    moved = (old != new).any(axis=1)
    code, dist = code.copy(), dist.copy()
    which = np.nonzero(moved)[0]
    if not len(which):
        return code, dist
    active = moved[code]
    code[active], dist[active] = nearest(x[active], new)
    still = np.nonzero(~active)[0]
    if len(still):
        c, d = nearest(x[still], new[which])
        c = which[c]
        closer = (d < dist[still]) | ((d == dist[still]) & (c < code[still]))
        code[still[closer]], dist[still[closer]] = c[closer], d[closer]
    return code, dist


def quantised(values: np.ndarray, width: int) -> np.ndarray:
    """Components as integers; ``width``: components of a part."""
    scaled, bound = np.floor(SCALE * values), int(((1 << _BITS) / (4 * width)) ** 0.5)
    if np.abs(scaled).max(initial=0) >= bound:
        raise ValueError(f"a component times {SCALE} is at or beyond {bound}: distances would not fit in 64 bits")
    return scaled.astype(np.int64)


def _pack(parts: np.ndarray) -> pa.Array:
    """Rows of integers as binary, two bytes each where they fit and four elsewhere."""
    flat = parts.reshape(len(parts), -1)
    small = flat.astype("<i2" if np.abs(flat).max(initial=0) < 1 << 15 else "<i4")
    return pa.array([r.tobytes() for r in small], pa.binary())


def _unpack(column: pa.Array, parts: int, width: int) -> np.ndarray:
    rows = [np.frombuffer(r, "<i2" if len(r) == 2 * parts * width else "<i4") for r in column.to_pylist()]
    return np.array(rows, np.int64).reshape(len(rows), parts, width)


def _state(ids: pa.Array, labels: pa.Array, x: np.ndarray, code: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    packed = [pa.array([r.tobytes() for r in c], pa.binary()) for c in (code.astype(np.uint8), dist.astype("<i8"))]
    return pa.RecordBatch.from_arrays([ids, labels, _pack(x), *packed], ["vec_id", "label", "x", "code", "dist"])


def _first(books: np.ndarray):
    """Quantise and assign to the first codebooks."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = quantised(b.column(2).flatten().to_numpy(zero_copy_only=False), width).reshape(b.num_rows, parts, width)
                got = [nearest(x[:, p], books[p]) for p in range(parts)]
                yield _state(b.column(0), b.column(1), x, *(np.stack(c, axis=1) for c in zip(*got, strict=True)))

    return run


def _next(old: np.ndarray, new: np.ndarray, last: bool):
    """Assign again after the codebooks changed; the last time, codes and errors come out."""
    parts, _, width = old.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _unpack(b.column(2), parts, width)
            code = np.array([np.frombuffer(r, np.uint8) for r in b.column(3).to_pylist()], np.int64)
            dist = np.array([np.frombuffer(r, "<i8") for r in b.column(4).to_pylist()], np.int64)
            got = [reassign(x[:, p], code[:, p], dist[:, p], old[p], new[p]) for p in range(parts)]
            code, dist = (np.stack(c, axis=1) for c in zip(*got, strict=True))
            if last:
                names = pa.array([r.tobytes().hex() for r in code.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), names, pa.array(dist.sum(axis=1))], ["vec_id", "label", "code", "error"])
            else:
                yield _state(b.column(0), b.column(1), x, code, dist)

    return run


def _sums(parts: int, entries: int, width: int):
    """Per task, the members of each entry (slot ``width`` of its row) and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x = _unpack(b.column(0), parts, width)
                code = np.array([np.frombuffer(r, np.uint8) for r in b.column(1).to_pylist()], np.int64)
                for p in range(parts):
                    np.add.at(total[p, :, :width], code[:, p], x[:, p])
                    total[p, :, width] += np.bincount(code[:, p], minlength=entries)
        flat = total.ravel()
        at = np.nonzero(flat)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["slot", "total"])

    return run


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of floored means of the assigned parts; an entry without parts stays."""
    parts, entries, width = books.shape
    sums = state.select("x", "code").mapInArrow(_sums(parts, entries, width), "slot long, total long")
    # one row for each entry and component, whatever the size of the table
    got = sums.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = np.zeros(parts * entries * (width + 1), object)
    for slot, value in got:
        total[slot] = int(value)
    total = total.reshape(parts, entries, width + 1)
    new = books.copy()
    for p, e in zip(*np.nonzero(total[:, :, width]), strict=True):
        new[p, e] = [int(s // total[p, e, width]) for s in total[p, e, :width]]
    return new


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train_and_encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    width: int | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error), codebooks[part, entry, position]) of the kept rows.

    Rows whose vector is null, empty or holds null or non-finite components are dropped.
    Vectors have ``width`` components (by default as many as the vector of the smallest
    kept id); rows of another width are dropped, and a width that ``parts`` does not divide
    raises. The first entries are the parts of the smallest ids, of equal ids the smallest
    vectors, null ids last; fewer rows than ``entries`` give fewer entries, and an empty
    table gives no rows and empty codebooks. Rows that repeat an id are coded one by one.
    Labels may be null; rows of a null label share one sum. Other columns are not looked at.
    A component so large that distances leave 64 bits raises.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    x = F.col(vector_col).cast("array<double>")
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    source = source.where(sound)
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    if width is None:
        head = source.orderBy(*order).select(F.size("v")).first()
        width = head[0] if head else parts
    if width % parts:
        raise ValueError(f"{width} components can not be cut into {parts} equal parts")
    source = source.where(F.size("v") == width)
    head = [r.v for r in source.orderBy(*order).limit(entries).collect()]
    each = width // parts
    books = quantised(np.array(head, np.float64), each).reshape(len(head), parts, each).transpose(1, 0, 2).copy()
    kinds = {f.name: f for f in source.schema}
    shape = StructType([kinds["vec_id"], kinds["label"]])
    told = StructType([*shape.fields]).add("code", "string").add("error", "long")
    if not head:
        empty = vectors.sparkSession.createDataFrame([], StructType([*told.fields]).add("label_error", "long"))
        return empty, books
    state_shape = StructType([*shape.fields]).add("x", "binary").add("code", "binary").add("dist", "binary")
    state = stage(source.mapInArrow(_first(books), state_shape), "codes")
    for k in range(rounds):
        new = moved_books(state, books)
        last = k == rounds - 1
        state = stage(state.mapInArrow(_next(books, new, last), told if last else state_shape), "codes")
        books = new
    keyed = state.withColumn("_null", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    summed = with_group(keyed, ["_null", "_label"], "vec_id", {"label_error": ("sum", "error")})
    return summed.select("vec_id", "label", "code", "error", "label_error"), books
