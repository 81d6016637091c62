"""Exact deduplication with composable polynomial fingerprints.

A text is its UTF-8 bytes with A-Z lower-cased. It is cut into chunks, each chunk is
hashed on its own as a polynomial, and the chunk hashes combine to the fingerprint of
the text: the hash of a chunk is multiplied by the base to the power of the bytes that
follow it, and the products are summed. So the chunks of a huge text are dealt to many
tasks and combined by an aggregate; those of other texts are combined where they are
read. Rows of equal fingerprint and length form a group; then their chunks are compared
themselves, chunk by chunk, and only a group whose chunks all agree stays one group. A
group that doesn't is divided by its SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.llm.common import slices, with_group
from popgraph.plans.stage import stage

#: Two prime moduli below 2^31 and their bases: products fit in 64 bits.
MODULI = (2147483647, 2147483629)
BASES = (1000003, 69069069)
CHUNK = 1 << 16
#: Texts of more bytes are huge: their chunks go to many tasks.
HUGE = 1 << 22
#: Bits of the map of duplicated fingerprints that goes to the tasks (128 KB, fixed).
MAP_BITS = 1 << 20

ROWS = "doc_id long, n_bytes long, fp long, fp2 long, text_sha256 string"
CHUNKS = "n_bytes long, fp long, fp2 long, chunk_no long, chunk binary"


def _powers(base: int, mod: int) -> np.ndarray:
    p = np.ones(CHUNK, np.uint64)
    n = 1
    while n < CHUNK:
        p[n : 2 * n] = p[:n] * np.uint64(pow(base, n, mod)) % np.uint64(mod)
        n *= 2
    return p[::-1].copy()


class Polynomials:
    """Fingerprints for a pair of moduli."""

    def __init__(self, moduli: tuple[int, ...] = MODULI):
        self.moduli, self._tables = moduli, None

    def __getstate__(self):
        return {"moduli": self.moduli, "_tables": None}

    def chunk_hash(self, chunk: bytes) -> tuple[int, ...]:
        """Polynomials of one chunk, highest power first, each byte raised by one."""
        if self._tables is None:
            self._tables = [_powers(b, m) for b, m in zip(BASES, self.moduli, strict=True)]
        v = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
        return tuple(int((v * p[CHUNK - len(v) :]).sum() % np.uint64(m)) for p, m in zip(self._tables, self.moduli, strict=True))

    def shifted(self, part: tuple[int, ...], after: int) -> tuple[int, ...]:
        """What a part with ``after`` bytes behind it adds to the hash of the whole."""
        return tuple(a * pow(b, after, m) % m for a, b, m in zip(part, BASES, self.moduli, strict=True))

    def combine(self, left: tuple[int, ...], right: tuple[int, ...], right_bytes: int) -> tuple[int, ...]:
        """Hash of a concatenation from the hashes of its two parts."""
        return tuple((a + c) % m for a, c, m in zip(self.shifted(left, right_bytes), right, self.moduli, strict=True))

    def fingerprint(self, data: bytes) -> tuple[int, ...]:
        got: tuple[int, ...] = (0,) * len(self.moduli)
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK]
            got = self.combine(got, self.chunk_hash(part), len(part))
        return got


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _rows(poly: Polynomials):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                out = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    data = _normal(t)
                    out.append((i, len(data), *poly.fingerprint(data), hashlib.sha256(data).hexdigest()))
                yield _batch(out, ROWS)

    return run


def _shares(poly: Polynomials):
    """Of each chunk of a huge text, what it adds to the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 64):
                rows = zip(*[b.column(c).to_pylist() for c in ("row_no", "n_bytes", "chunk_no", "chunk")], strict=True)
                yield _batch([(r, *poly.shifted(poly.chunk_hash(c.lower()), n - k * CHUNK - len(c))) for r, n, k, c in rows], "row_no long, fp long, fp2 long")

    return run


def _chunks_of(poly: Polynomials, bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        for whole in batches:
            for b in slices(whole):
                out: list[tuple] = []
                for t in b.column(1).to_pylist():
                    data = _normal(t)
                    p = poly.fingerprint(data)
                    if marked[p[0] % MAP_BITS]:
                        out += [(len(data), *p, at // CHUNK, data[at : at + CHUNK]) for at in range(0, max(len(data), 1), CHUNK)]
                if out:
                    yield _batch(out, CHUNKS)

    return run


def _huge_chunks(huge: DataFrame) -> DataFrame:
    """(row_no, doc_id, n_bytes, text_sha256 with the first chunk, chunk_no, chunk) of the rows of ``huge``, a table of its own."""
    n = F.octet_length("text").cast("long")
    cut = huge.withColumn("row_no", F.monotonically_increasing_id()).withColumn("n_bytes", n)
    cut = cut.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / CHUNK).cast("long"))))
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sha = F.when(F.col("chunk_no") == 0, F.sha2(folded, 256)).alias("text_sha256")
    chunk = F.substring(F.col("text").cast("binary"), (F.col("chunk_no") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("chunk")
    return stage(cut.select("row_no", "doc_id", "n_bytes", sha, "chunk_no", chunk), "exact-huge")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moduli: tuple[int, int] = MODULI, huge: int = HUGE) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_bytes), one row per row of ``docs``.

    Texts that differ only in the case of A-Z are equal; a null text equals an empty
    one. ``keep_id`` is the largest id of the group; of rows that repeat one id, each
    has the same ``kept``. A null id is the smallest; a group of null ids alone keeps
    them. An empty table gives an empty result. Other columns are not looked at.
    ``moduli``: of the fingerprints, below 2^31; small ones collide and cost time, no
    correctness. ``huge``: bytes beyond which chunks of a text are hashed apart.
    """
    poly = Polynomials(moduli)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    is_huge = F.coalesce(F.octet_length("text"), F.lit(0)) > huge
    usual = source.where(~is_huge)
    cut = _huge_chunks(source.where(is_huge))
    shares = cut.select("row_no", "n_bytes", "chunk_no", "chunk").repartition("row_no", "chunk_no").mapInArrow(_shares(poly), "row_no long, fp long, fp2 long")
    of_huge = shares.groupBy("row_no").agg(*[F.pmod(F.sum(c), F.lit(m)).alias(c) for c, m in zip(("fp", "fp2"), moduli, strict=True)])
    of_huge = stage(cut.where("chunk_no = 0").select("row_no", "doc_id", "n_bytes", "text_sha256").join(of_huge, "row_no"), "exact-of-huge")
    small = usual.mapInArrow(_rows(poly), ROWS)
    rows = stage(small.unionByName(of_huge.drop("row_no")), "exact-rows")
    same = ["n_bytes", "fp", "fp2"]
    more = stage(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "exact-more")

    # which texts are read again: a fixed map of bits, set for every duplicated fingerprint
    bits = np.zeros(MAP_BITS, np.uint8)
    for (bit,) in more.select(F.pmod("fp", F.lit(MAP_BITS))).distinct().collect():  # at most MAP_BITS rows
        bits[bit] = 1
    packed = np.packbits(bits, bitorder="little").tobytes()
    chunks = usual.mapInArrow(_chunks_of(poly, packed), CHUNKS)
    lower = F.translate(F.decode("chunk", "ISO-8859-1"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    again = of_huge.join(more, same, "left_semi").select("row_no", *same)
    again = cut.select("row_no", "chunk_no", F.encode(lower, "ISO-8859-1").alias("chunk")).join(again, "row_no").select(*same, "chunk_no", "chunk")
    compared = chunks.unionByName(again).groupBy(*same, "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    differ = stage(compared.where("least <> most").select(*same).distinct(), "exact-differ")

    if differ.isEmpty():
        keyed = rows.withColumn("within", F.lit(""))
    else:
        marks = differ.withColumn("hit", F.lit(True))
        keyed = rows.join(marks, same, "left").withColumn("within", F.when(F.col("hit"), F.col("text_sha256")).otherwise(""))
        keyed = keyed.drop("hit")
    grouped = with_group(keyed, [*same, "within"], "doc_id", {"keep_id": ("max", "doc_id"), "group_size": ("count", "doc_id")})
    return grouped.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes"
    )
